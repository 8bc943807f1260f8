"""Run records, ground truth and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nodewell import schemas


def _spark_glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(s.getPath().toString()) for s in (found or [])]


def input_files(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files of all patterns, each once, in the order first met; an error if there is none."""
    files = list(dict.fromkeys(f for p in patterns for f in _spark_glob(spark, p)))
    if not files:
        raise FileNotFoundError(f"no input matches {patterns}")
    return files


def read_runs(spark: SparkSession, paths: str | list[str], schema: str = schemas.RUN) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped. Adds file, the path that each record came from."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def tag_runs(spark: SparkSession, specs: list[str], schema: str = schemas.RUN) -> DataFrame:
    """Records of MODEL:DEVICE:PATH specs, with model and device as the spec says."""
    parts = []
    for spec in specs:
        model, device, path = spec.split(":", 2)
        parts.append(read_runs(spark, path, schema).withColumns({"model": F.lit(model), "device": F.lit(device)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_runs(*frames: DataFrame) -> DataFrame:
    """Frames with differing columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def identified(runs: DataFrame) -> DataFrame:
    """Runs with image_id as a long, and the alias columns of model and device folded into one each."""
    model = F.coalesce("model", "model_name", "model_tag")
    device = F.coalesce("device", "device_name")
    return runs.withColumns({"image_id": F.expr("try_cast(image_id as bigint)"), "model": model, "device": device})


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, category, n) of JSON documents of categories and annotations; documents that name equal categories share them."""
    doc = spark.read.schema(schemas.ANNOTATIONS).option("multiLine", True).json(path)
    names = doc.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category")).distinct()
    each = doc.select(F.inline("annotations")).select("image_id", "category_id")
    return each.join(F.broadcast(names), "category_id").groupBy("image_id", "category").agg(F.count("*").alias("n"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, caption_no, caption), numbered in file order."""
    doc = spark.read.schema(schemas.ANNOTATIONS).option("multiLine", True).json(path)
    each = doc.select(F.posexplode("annotations").alias("caption_no", "a"))
    return each.select("a.image_id", "caption_no", "a.caption").where("caption is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path) of a list of paths; file stems that are no integer are dropped."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return rows.select(F.expr("try_cast(regexp_extract(path, '([^/]*?)(?:\\\\.[^./]*)?$', 1) as bigint)").alias("image_id"), "path").where("image_id is not null")


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TESTSET).option("multiLine", True).json(path)


def enriched_path(path: str, stage: str) -> str:
    """Where a stage's output goes: the suffix of the stage before is replaced, else added (enriched, rescored, clipscored)."""
    stem, dot, ending = path.rpartition(".")
    for before in ("_enriched", "_rescored", "_clipscored"):
        stem = stem.removesuffix(before)
    return f"{stem}_{stage}{dot}{ending}"


def write_enriched(df: DataFrame, path: str, overwrite: bool = False, kind: str = "json") -> None:
    """Written in parts by model and device; an output that is there stays unless overwrite."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("model", "device").format(kind).save(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table by JDBC, where the database's driver is at hand; see sources.sqlite for SQLite files, which need none."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
