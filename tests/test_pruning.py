"""Searches that leave out what cannot matter: pairs of cells by their bounds, days of an archive by their folders."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodewell.functions import scalars, vectors
from nodewell.sources import logs


def plain(queries, corpus, k):
    out = []
    for qi, x in queries:
        d = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), ci) for ci, y in corpus)
        out += [(qi, r, ci, d_) for r, (d_, ci) in enumerate(d[:k], 1)]
    return out


@pytest.mark.parametrize("kind, block_rows", [("clusters", 40), ("clusters", 7), ("noise", 60), ("ties", 30), ("clusters", 10_000)])
def test_cells_give_the_same_neighbours(spark, kind, block_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 20
    make = {"clusters": lambda n: centres[rng.integers(0, 8, n)] + rng.normal(size=(n, 6)), "noise": lambda n: rng.normal(size=(n, 6)), "ties": lambda n: rng.integers(0, 2, (n, 6)).astype(float)}[kind]
    corpus, queries = list(enumerate(make(400).tolist())), list(enumerate(make(90).tolist()))
    c = spark.createDataFrame([*corpus, (999, None)], "corpus_id int, embedding array<double>")
    q = spark.createDataFrame([*queries, (999, None)], "query_id int, embedding array<double>")
    for k in (1, 5, 500):
        told = {}
        got = sorted(map(tuple, vectors.topk_l2(q, c, k, block_rows=block_rows, told=told).collect()))
        expected = sorted(plain(queries, corpus, k))
        assert [g[:3] for g in got] == [e[:3] for e in expected] and np.allclose([g[3] for g in got], [e[3] for e in expected])
        assert told["met"] <= told["pairs"]
        if kind == "clusters" and block_rows < 1000 and k == 1:
            assert told["met"] < 0.5 * told["pairs"]
    assert vectors.topk_l2(q.limit(0), c, 3, block_rows=block_rows).count() == vectors.topk_l2(q, c.limit(0), 3, block_rows=block_rows).count() == 0


def test_a_range_of_one_day_lists_one_day(spark, tmp_path):
    for folder in ("2024/01/05/10", "2024/01/06/00", "2024-01-05", "2024-01-07", "other"):
        (tmp_path / folder).mkdir(parents=True)
        day = folder.replace("/", "-")[:10] if folder != "other" else "2024-01-05"
        (tmp_path / folder / f"top_{day}_10-00-00.jpg").write_bytes(b"x")
        (tmp_path / folder / "notes.txt").write_bytes(b"x")
    found = logs.index_images(spark, str(tmp_path), date(2024, 1, 5), date(2024, 1, 5))
    assert len(found.inputFiles()) == 2 and all("01/05/" in f or "01-05/" in f for f in found.inputFiles())
    assert found.select(F.to_date(scalars.image_timestamp(F.col("path"))).alias("d")).distinct().collect()[0].d == date(2024, 1, 5)
    assert logs.index_images(spark, str(tmp_path), date(2024, 1, 5), date(2024, 1, 7)).count() == 4
    assert logs.index_images(spark, str(tmp_path), date(2025, 1, 1), date(2025, 1, 2)).count() == 0 and logs.index_images(spark, str(tmp_path)).count() == 5
