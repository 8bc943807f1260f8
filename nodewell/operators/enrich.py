"""Outputs of runs: exploding, filters, ground truth, similarity to references, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nodewell.functions import captions, vectors


def explode_outputs(runs: DataFrame, outputs: str = "outputs") -> DataFrame:
    """One row per output with its position; a record without outputs stays as one row with nulls."""
    return runs.select("*", F.posexplode_outer(outputs).alias("pos", "o")).drop(outputs)


def valid_outputs(exploded: DataFrame) -> DataFrame:
    """Outputs without error and with an embedding, under either name."""
    vector = F.coalesce("o.embedding", "o.text_embedding")
    return exploded.where((F.coalesce("o.error", F.lit("")) == "") & (F.size(vector) > 0))


def usable_latencies(outputs: DataFrame, variant: str = "strict") -> DataFrame:
    """Outputs (model, device, task, text, latency) that count for latencies. strict: blank texts and latencies of zero or
    less go. lenient: empty texts and null latencies go; null task is caption, null model or device is unknown."""
    if variant == "strict":
        return outputs.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("latency") > 0))
    named = {"task": F.coalesce("task", F.lit("caption")), "model": F.coalesce("model", F.lit("unknown")), "device": F.coalesce("device", F.lit("unknown"))}
    return outputs.where((F.coalesce("text", F.lit("")) != "") & F.col("latency").isNotNull()).withColumns(named)


def attach_ground_truth(runs: DataFrame, counts: DataFrame, key: str = "image_id", small: bool = False) -> DataFrame:
    """runs with expected_entities (sorted) and expected_counts of their image, empty where there are none. counts: (key, category, n).
    small: counts are known to fit every task's memory and are broadcast."""
    grouped = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("category", F.col("n").cast("int").alias("n")))).alias("_c"))
    joined = runs.join(F.broadcast(grouped) if small else grouped, key, "left")
    c = F.coalesce("_c", F.array().cast("array<struct<category: string, n: int>>"))
    return joined.withColumns({"expected_entities": F.transform(c, lambda x: x["category"]), "expected_counts": F.map_from_entries(c)}).drop("_c")


def quality_of_text(outputs: DataFrame, text: str = "text", task: str = "task") -> DataFrame:
    """outputs with entity_recall, and count_accuracy for the task objects_and_counts."""
    counts = F.when(F.col(task) == "objects_and_counts", captions.count_accuracy(F.col(text), F.col("expected_counts")))
    return outputs.withColumns({"entity_recall": captions.entity_recall(F.col(text), F.col("expected_entities")), "count_accuracy": counts})


def caption_similarity(outputs: DataFrame, references: DataFrame, key: str = "image_id", vector: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """outputs with the largest and the mean cosine to their image's reference vectors; null where either is missing. A vector with a
    null component, or of another width, has no cosine: the largest leaves it out, the mean is null.

    Equal vectors of an image meet once. Images with more than block_rows outputs or references, of which there are few by that bound,
    are cut into blocks by the hash of the vector, and any two of its blocks are one group; the others are dealt to groups of some
    block_rows rows by the hash of the image. A group is one matrix product an image (vectors.cosines). The sizes of images are a job.
    """
    kind = outputs.select(key).union(references.select(key)).schema[key].dataType
    sides = [df.where(F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("_k"), F.col(vector).alias("_v")).where("_k is not null") for df in (outputs, references)]
    counted = [df.groupBy("_k").agg(F.count("*").alias(n)) for df, n in zip(sides, ("_nq", "_nc"), strict=True)]
    sizes = counted[0].join(counted[1], "_k", "full").fillna(0, ["_nq", "_nc"])
    short = (F.col("_nq") <= block_rows) & (F.col("_nc") <= block_rows)
    groups = -(-(sizes.where(short).agg(F.sum(F.col("_nq") + F.col("_nc"))).first()[0] or 1) // block_rows)
    blocks = [F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1)).cast("int").alias(n) for n in ("_nq", "_nc")]
    long = F.broadcast(sizes.where(~short).select(F.col("_k").alias("_long"), *blocks))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        cut = df.join(long, F.col("_k") == F.col("_long"), "left")
        one, others = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        group = F.when(F.col("_long").isNull(), F.pmod(F.xxhash64("_k"), F.lit(groups))).otherwise(F.xxhash64("_k"))
        block = F.pmod(F.xxhash64("_v"), one).cast("int")
        return cut.select(*df.columns, group.alias("_g"), block.alias(f"_b{own}"), F.explode(F.sequence(F.lit(0), others - 1)).alias(f"_b{other}"))

    whole = F.forall("_v", lambda x: x.isNotNull())
    q = dealt(sides[0].where(whole).distinct(), "_nq", "_nc")
    c = dealt(sides[1].groupBy("_k", "_v").agg(F.count("*").alias("_n")).withColumn("_whole", whole), "_nc", "_nq")
    by = ["_g", "_b_nq", "_b_nc"]
    types = [sides[0].schema[n].dataType.simpleString() for n in ("_k", "_v")]
    met = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(vectors.cosines, f"_k {types[0]}, _v {types[1]}, _max double, _sum double, _n bigint, _odd bigint")
    found = met.groupBy("_k", "_v").agg(*[f(n).alias(n) for f, n in ((F.max, "_max"), (F.sum, "_sum"), (F.sum, "_n"), (F.sum, "_odd"))])
    joined = outputs.join(found, (outputs[key].cast(kind) == found["_k"]) & (outputs[vector] == found["_v"]), "left")
    mean = F.when(F.col("_odd") == 0, F.col("_sum") / F.col("_n"))
    return joined.select(outputs[key], *[outputs[n] for n in outputs.columns if n != key], F.col("_max").alias("caption_similarity_max"), mean.alias("caption_similarity_mean"))


def clip_scores(outputs: DataFrame, images: DataFrame, key: str = "image_id", vector: str = "embedding") -> DataFrame:
    """outputs with clipscore_cos and clipscore against their image's vector; null for errors, empty texts and missing vectors."""
    from nodewell.functions.scalars import clip_score

    joined = outputs.join(images.select(key, F.col(vector).alias("_image")), key, "left")
    usable = (F.coalesce("error", F.lit("")) == "") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    cosine = F.when(usable, vectors.cosine_similarity(F.col(vector), F.col("_image")))
    return joined.withColumn("clipscore_cos", cosine).withColumn("clipscore", F.when(F.col("clipscore_cos").isNotNull(), clip_score(F.col("clipscore_cos")))).drop("_image")


def pending_work(images: DataFrame, tasks: list[str], done: DataFrame, key: str = "image_id", task: str = "task") -> DataFrame:
    """(key, task) pairs that done does not have. The tasks are a short list."""
    every = images.select(key).distinct().select(key, F.explode(F.array(*[F.lit(t) for t in tasks])).alias(task))
    return every.join(done.select(key, task).distinct(), [key, task], "left_anti")


def completed_images(done: DataFrame, tasks: list[str], key: str = "image_id", task: str = "task") -> DataFrame:
    """Images that have every task."""
    own = done.where(F.col(task).isin(tasks)).groupBy(key).agg(F.count_distinct(task).alias("n"))
    return own.where(F.col("n") == len(set(tasks))).select(key)


def missing_codes(references: DataFrame, hypotheses: DataFrame, code: str = "code") -> DataFrame:
    """Codes that only one side has, with the side that lacks them."""
    left = references.join(hypotheses, code, "left_anti").select(code, F.lit("hypothesis").alias("missing"))
    return left.union(hypotheses.join(references, code, "left_anti").select(code, F.lit("reference").alias("missing")))
