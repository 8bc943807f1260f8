"""Hard negatives: exact products by residues, and the whole job against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodewell.llm import negatives, queries as q

SCHEMA = "vec_id bigint, embedding array<float>, label int, a int, found int, rank int"


@pytest.mark.parametrize("width, largest", [(1, 1), (3, 0), (64, 160), (64, 2**20), (7, 2**29), (1024, 40_000), (1, 2**30)])
def test_products_are_exact(width, largest):
    rng = np.random.default_rng(width)
    primes = negatives.primes_for(width, largest)
    assert len(set(primes)) == len(primes) and 2 * width * largest**2 < math.prod(primes) < 2**63
    x, y = rng.integers(-largest, largest + 1, (20, width)), rng.integers(-largest, largest + 1, (30, width))
    x[0], y[0], y[1] = largest, largest, -largest
    got = negatives.products([negatives.residues(x, p) for p in primes], [negatives.residues(y, p) for p in primes], primes)
    assert (got == x.astype(object) @ y.T.astype(object)).all()


def test_scores_that_may_not_fit_are_refused():
    for width, largest in ((64, 2**28), (2**22, 5), (1, 2**31)):
        with pytest.raises(ValueError):
            negatives.primes_for(width, largest)


def plain(rows, k=5, m=10, low=30, high=90, every=100):
    rows = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l, *_ in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in rows if r != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            hard = [x for x in scored if x[2] != a[1] and -30 * s <= -100 * x[0] <= -90 * s]
            out += [(a[0], p, r, n, -s, -t) for r, (t, n, _) in enumerate(hard[:m], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_every_case_against_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    rng = random.Random(block)
    vector = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(rng.choice([4, 4, 4, 3, 0]))]
    rows = [(rng.randrange(-3, 8) * 100 if i % 4 == 0 else i, vector(), rng.choice([0, 1, 1, None]), 1, 2, 3) for i in range(260)]
    rows += rows[:40] + [(5, None, 1, 1, 2, 3), (None, [1.0] * 4, 1, 1, 2, 3), (6, [None, 1.0], 1, 1, 2, 3), (7, [float("nan")], 0, 1, 2, 3), (8, [float("-inf")], 0, 1, 2, 3)]
    expected = plain(rows)
    assert len(expected) > 500 and mined(spark, rows) == expected


def test_large_components_and_small_tables(spark):
    rows = [(i * 50, [float(x) * 1000 for x in (i, 3 - i, 7)], i % 2, 0, 0, 0) for i in range(12)]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, rows[:1]) == mined(spark, []) == []


def test_op12_on_the_whole_table(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in q.table(spark, sf, "embeddings").collect()]
        if len(rows) < 1000:
            assert sorted(map(tuple, q.op12_negatives(spark, sf).collect())) == plain(rows)
        else:
            x = np.floor(256 * np.array([v for _, v, _ in rows], dtype=float)).astype(np.int64)
            score = {(r[0], s[0]): int(v) for r, own in zip(rows, x @ x.T) if r[0] % 100 == 0 for s, v in zip(rows, own)}
            got = q.op12_negatives(spark, sf).collect()
            assert len(got) > 900 and all(r.positive_score == score[r.anchor_id, r.positive_id] and r.negative_score == score[r.anchor_id, r.negative_id] for r in got)
