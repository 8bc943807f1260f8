"""A training corpus in five stages, each on all that the one before has kept; see STAGES.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which returns the
packed pieces. Null texts fail the first stage; extra columns pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nodewell.llm import common, decontam, nearcopies, packing, quality, secrets
from nodewell.llm.queries import table, tokenizer_path

#: Of pack: few, as its workers stand beside a JVM that the stages before have filled.
REMEMBERED_BYTES = 32 << 20


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are depleted go; lines above the limits go from the others."""
    return _counted(quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more, that with the smallest id stays; of its repeated rows, one."""
    found = nearcopies.near_copies(docs)
    stays = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("n")
    ids = common.materialise(found.groupBy("doc_id").agg(stays).where("n <> 1"), "ids-that-go")
    kept = _without(docs, ids.where("n = 0").select("doc_id"))
    return kept if ids.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return _without(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those with an id of ids, null being an id like any other."""
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"))
    name = common.fresh(docs, "_nw_id")
    few = common.materialise(ids.select(key.alias(name)), "ids")
    return common.join_few(docs.withColumn(name, key), few, [name], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), remembered=REMEMBERED_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]
#: Stages two, four and five have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
