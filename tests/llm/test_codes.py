"""Vector codes: against plain scans of every entry, the bounds, and the whole query."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from nodewell.llm import codes, queries as q

SCHEMA = "vec_id bigint, embedding array<double>, label int, error int, code string, _l int, _n int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = max([1, *(-(-len(v) // parts) for _, v, _ in kept)])
    cut = [[(v + [0] * (w * parts))[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min((dist(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x in cut:
                own[nearest(p, x[p])[1]].append(x[p])
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for (i, _, l), x in zip(kept, cut):
        best = [nearest(p, x[p]) for p in range(parts)]
        out.append((i, l, bytes(k for _, k in best), sum(d for d, _ in best)))
    return out, books


def compare(spark, rows, **options):
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA), **options)
    expected, plain_books = plain(rows, **{k: v for k, v in options.items()})
    assert books.entries.tolist() == plain_books or not expected
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[3])
    got = found.collect()
    assert sorted([(r[0], r[1], bytes(r[2]), r[3]) for r in got], key=key) == sorted(expected, key=key)
    return got, books


def made(n, seed, width=8, values=None, **_):
    rng = random.Random(seed)
    one = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0, 0.125))
    return [(i, [one() for _ in range(width)], rng.choice([None, 1, 2]), 1, "c", 1, 1) for i in range(n)]


@pytest.mark.parametrize("seed, options", [(1, dict(parts=4, entries=8, rounds=5)), (2, dict(parts=2, entries=16, rounds=3)), (3, dict(parts=8, entries=1, rounds=2)), (4, dict(parts=3, entries=5, rounds=4))])
def test_codes_equal_plain_scans(spark, monkeypatch, seed, options):
    monkeypatch.setattr(codes, "BATCH", 50)
    compare(spark, made(300, seed), **options)
    compare(spark, made(200, seed, values=[0.0, 0.004, -0.004, 0.25]), **options)  # many ties and equal entries
    compare(spark, made(60, seed, values=[1e5, -1e5, 3e4]), **options)  # beyond float64


def test_odd_rows(spark):
    rows = made(90, 7, 7) + made(20, 7, 7) + [(300 + i, *r) for i, *r in made(5, 8, 3)]
    rows += [(200, None, 1, 1, "c", 1, 1), (201, [None] * 7, 1, 1, "c", 1, 1), (202, [float("nan")] * 7, None, 1, "c", 1, 1), (203, [float("inf")], 1, 1, "c", 1, 1), (None, [0.5] * 7, None, 1, "c", 1, 1), (-4, [], 3, 1, "c", 1, 1)]
    compare(spark, rows, parts=4, entries=6)
    compare(spark, rows[:3], parts=4, entries=6)
    compare(spark, [], parts=4, entries=6)
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1e12], 1, 1, "c", 1, 1)], SCHEMA))


def test_an_entry_that_came_back_has_not_moved():
    a, b = np.array([[[0, 0], [9, 0]]]), np.array([[[3, 4], [9, 1]]])
    books = codes.Codebooks([a, b, a])
    own, others = books.moves(2, 0)
    assert not own.any() and not others.any()  # its steps add up to 10
    own, others = books.moves(2, 1)
    assert own.tolist() == [[5, 1]] and others.tolist() == [[1, 5]]


def test_bounds_spare_scans_and_never_change_a_code():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (4, 12, 4))
    x = (centres[np.arange(4), rng.integers(0, 12, (5000, 4))] + rng.integers(-6, 7, (5000, 4, 4))).astype(float)
    books, state = codes.Codebooks([x[:12].astype(np.int64).transpose(1, 0, 2)]), codes.State.unseen((5000, 4))
    for now in range(8):
        codes.advance(x, state, books, now)
        squares = ((x[:, :, None, :] - books.entries.astype(float)) ** 2).sum(axis=3)
        assert (state.code == squares.argmin(axis=2)).all()
        entries = books.entries.copy()
        for p in range(4):
            for e in range(12):
                own = x[state.code[:, p] == e, p]
                if len(own):
                    entries[p, e] = np.floor(own.sum(axis=0) / len(own))
        books.history.append(entries)
    assert state.scans.mean() < 4  # of eight


def test_codes_stand_for_near_vectors(spark):
    rows = made(400, 9)
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=32)
    given = {i: v for i, v, *_ in rows}
    off = [np.square(np.array(r.vector) - given[r.vec_id]).sum() for r in codes.restored(found, books).collect()]
    assert np.mean(off) < 0.5 * np.mean([np.square(v).sum() for v in given.values()])


def test_label_errors_of_hot_rare_and_null_labels(spark):
    labels = [None] * 700 + [5] * 900 + list(range(100, 1500))
    df = spark.createDataFrame([(i, l, i % 13) for i, l in enumerate(labels)], "vec_id int, label int, error bigint")
    total = defaultdict(int)
    for i, l in enumerate(labels):
        total[l] += i % 13
    got = codes.with_label_error(df).collect()
    assert len(got) == len(labels) and all(r.label_error == total[r.label] for r in got)
    assert codes.with_label_error(df.limit(0)).count() == 0


def test_op13_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in q.table(spark, sf, "embeddings").collect()]
    expected, books = plain(rows)
    total = defaultdict(int)
    for _, l, _, e in expected:
        total[l] += e
    sha = hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()
    got = q.op13_codes(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted((i, c.hex(), e, total[l], sha) for i, l, c, e in expected)
