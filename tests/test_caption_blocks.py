"""caption_similarity by blocks against every pair by itself."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodewell.operators import enrich

OUT, REF = "vec_id long, image_id int, embedding array<float>", "image_id bigint, embedding array<float>"


def plain(v, refs):
    """Largest and mean cosine; a pair of other widths or with a null has none."""
    if v is None or not refs:
        return None, None
    one = lambda a, b: None if len(a) != len(b) or None in [*a, *b] else float(np.dot(a, b)) / ((math.sqrt(np.dot(a, a)) + 1e-12) * (math.sqrt(np.dot(b, b)) + 1e-12))
    all_of = [one(v, r) for r in refs]
    known = [c for c in all_of if c is not None]
    largest = None if not known else math.nan if any(map(math.isnan, known)) else max(known)
    return largest, sum(known) / len(known) if len(known) == len(all_of) else None


@pytest.mark.parametrize("block_rows", [4096, 40, 3])
def test_blocks_equal_all_pairs(spark, block_rows):
    rng = random.Random(5)
    some = lambda w=4: [float(np.float32(rng.gauss(0, 1))) for _ in range(w)]
    odd = [None, [0.0] * 4, [-0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, 2.0], [], [math.nan, 1.0, 1.0, 1.0]]
    vectors = {1: [some() for _ in range(150)] + [[3.0, 1.0, 0.0, 0.0]] * 60, 2: [*odd, some(), some()], 3: [some()], 4: [some(2), some(2), [0.0, 0.0]], 5: [some() for _ in range(90)], 6: [some()], None: [some()]}
    known = {1: [some() for _ in range(70)] + [[1.0, 1.0, 1.0, 0.0]] * 50, 2: [some(), some(), [0.0] * 4], 4: [some(2), some(3), [None, 1.0], None], 6: [[math.nan] * 4, some()], 7: [some()] * 90, None: [some()]}
    rows = [(k, v) for k, own in vectors.items() for v in own]
    rows = [(n, k, v) for n, (k, v) in enumerate(rows)]
    refs = spark.createDataFrame([(k, v) for k, own in known.items() for v in own], REF)
    found = enrich.caption_similarity(spark.createDataFrame(rows, OUT), refs, block_rows=block_rows)
    assert found.columns == ["image_id", "vec_id", "embedding", "caption_similarity_max", "caption_similarity_mean"]
    got = {r.vec_id: (r.caption_similarity_max, r.caption_similarity_mean) for r in found.collect()}
    assert sorted(got) == [n for n, _, _ in rows]
    for n, k, v in rows:
        expected = plain(v, [r for r in known.get(k, []) if r is not None] if k is not None else [])
        assert got[n] == pytest.approx(expected, abs=1e-9, nan_ok=True), (k, v)


def test_an_image_with_most_vectors_meets_by_blocks(spark):
    """18 million pairs of 64 components, at a rate that pair by pair does not reach."""
    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i).cast("float"))
    outputs = spark.range(1, 6001).select("id", F.lit(1).alias("image_id"), v.alias("embedding"))
    started = time.time()
    found = enrich.caption_similarity(outputs, outputs.where("id % 2 = 0").drop("id")).agg(F.count_if(F.abs(F.col("caption_similarity_max") - 1) < 1e-6).alias("own"), F.count("*").alias("n")).first()
    assert time.time() - started < 30
    assert found.own >= 3000 and found.n == 6000


def test_without_references(spark):
    outputs = spark.createDataFrame([(1, 1, [1.0])], OUT)
    got = enrich.caption_similarity(outputs, spark.createDataFrame([], REF)).collect()
    assert [(r.caption_similarity_max, r.caption_similarity_mean) for r in got] == [(None, None)]
    assert enrich.caption_similarity(outputs.limit(0), spark.createDataFrame([(1, [1.0])], REF)).collect() == []
