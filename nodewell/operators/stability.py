"""Agreement of repeats within a record and between devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from nodewell.functions import vectors
from nodewell.operators.stats import with_percentiles


def repeat_stability(runs: DataFrame) -> DataFrame:
    """(model, device, image_id, task, repeats, stability, texts) of nested records with two valid repeats or more; texts are
    those of the valid repeats. Works inside each record, in closed form; see vectors.mean_pair_cosine."""
    vector = lambda o: F.coalesce(o["embedding"], o["text_embedding"])
    valid = F.filter("outputs", lambda o: (F.coalesce(o["error"], F.lit("")) == "") & (F.size(vector(o)) > 0))
    texts = F.transform(valid, lambda o: F.coalesce(o["text"], F.lit("")))
    rows = runs.select("model", "device", "image_id", "task", F.transform(valid, vector).alias("_v"), texts.alias("texts"))
    return rows.where(F.size("_v") >= 2).select("model", "device", "image_id", "task", F.size("_v").alias("repeats"), vectors.mean_pair_cosine(F.col("_v")).alias("stability"), "texts")


def stability_summary(stability: DataFrame, keys: tuple[str, ...] = ("model", "device"), map_rows: int = 1_000_000) -> DataFrame:
    s = F.col("stability")
    shares = [F.avg((s < x / 100).cast("int")).alias(f"share_below_{x}") for x in (85, 90, 95)]
    g = stability.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.min(s).alias("min"), *shares)
    wanted = {"median": ("stability", 50.0), "p5": ("stability", 5.0), "p10": ("stability", 10.0)}
    g = with_percentiles(g, stability.select(*keys, "stability"), list(keys), wanted, map_rows=map_rows)
    return g.select(*keys, "n", "mean", *wanted, "min", *[f"share_below_{x}" for x in (85, 90, 95)])


def least_stable_examples(stability: DataFrame, below: float = 0.85, per_group: int = 10) -> DataFrame:
    """The least stable images of each model and device, with their texts if they have some, then all by stability."""
    order = W.partitionBy("model", "device").orderBy("stability", "image_id", "task")
    ranked = stability.where(F.col("stability") < below).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= per_group).orderBy("stability", "model", "device", "image_id", "task")


def cross_device_pairs(outputs: DataFrame, mode: str = "first") -> DataFrame:
    """(model, image_id, task, device_a, device_b, text_a, text_b, cosine) for all pairs of devices. outputs: one row per output with
    pos, text, error, embedding. first: repeat 0 of each device, which is left out if that failed; mean: the mean of its
    vectors. Texts are cut to 200 characters. A group holds as many rows as there are devices."""
    keys = ["model", "image_id", "task"]
    ok = outputs.where("coalesce(error, '') = '' and size(embedding) > 0")
    if mode == "first":
        own = ok.where("pos = 0").select(*keys, "device", F.substring("text", 1, 200).alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    else:
        own = ok.groupBy(*keys, "device").agg(F.substring(F.min_by("text", "pos"), 1, 200).alias("text"), F.collect_list("embedding").alias("_v"))
        total = vectors.sum_vectors(F.col("_v"), F.size(F.col("_v")[0]))
        own = own.withColumn("v", F.transform(total, lambda x: x / F.size("_v"))).drop("_v")
    g = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("device", "text", "v"))).alias("d")).where("size(d) > 1")
    pairs = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = g.select(*keys, F.explode(pairs).alias("p"))
    sides = [F.col(f"p.{s}.{n}").alias(f"{n}_{s}") for n in ("device", "text") for s in ("a", "b")]
    return each.select(*keys, *sides, vectors.cosine_similarity(F.col("p.a.v"), F.col("p.b.v")).alias("cosine"))


def cross_device_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("model").agg(F.avg("cosine").alias("mean"), F.min("cosine").alias("min"), F.stddev_pop("cosine").alias("std"), F.count("*").alias("n_pairs"))


def semantic_duplicates(df: DataFrame, group: list[str], key: str, vector: str = "embedding", limit: float = 0.95, block_rows: int = 2000) -> DataFrame:
    """(group, key, links, total) of every row that has duplicates: the number of rows of its group whose cosine with it is limit
    or more, and the sum of these cosines. A group is cut into blocks of about block_rows vectors by hash and each pair of blocks
    is one task, so a large group is spread and never held as a whole, and a task gives a row per vector, not its pairs."""
    import numpy as np
    import pandas as pd

    sizes = df.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("_n"))
    own = df.where(F.col(vector).isNotNull()).join(sizes, group).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    # Block pair (i, j), i <= j: a block goes to every pair that it is part of.
    left = own.select(*group, key, vector, F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_j"))
    right = own.select(*group, key, vector, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    keys = [*group, "_i", "_j"]
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*group, key]}
    names = [*group, key, "links", "total"]

    def search(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: np.array([], dtype=object) for c in names})
        b = b.rename(columns=lambda c: c[:-1])
        unit = [np.stack(x[vector].to_numpy()).astype(float) for x in (a, b)]
        x, y = (u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300) for u in unit)
        c = x @ y.T
        near = c >= limit
        if k[-1] == k[-2]:
            near &= a[key].to_numpy()[:, None] != b[key].to_numpy()[None, :]
        parts = [(a, near.sum(axis=1), np.where(near, c, 0).sum(axis=1))]
        if k[-1] != k[-2]:
            parts.append((b, near.sum(axis=0), np.where(near, c, 0).sum(axis=0)))
        found = [np.concatenate(c) for c in zip(*[(d[key].to_numpy()[n > 0], n[n > 0], t[n > 0]) for d, n, t in parts], strict=True)]
        own = {g: np.array([v] * len(found[0]), dtype=object) for g, v in zip(group, k, strict=False)}
        return pd.DataFrame({**own, **dict(zip(names[len(group) :], found, strict=True))})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*group, key]], "links bigint, total double"])
    right = right.toDF(*[f"{c}_" for c in right.columns])
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_" for c in keys])).applyInPandas(search, schema)
    return found.groupBy(*group, key).agg(F.sum("links").alias("links"), F.sum("total").alias("total"))
