"""Ordered scans: chunks against plain windows, whatever the keys' sizes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from nodewell.operators import archive, ordered, speech, traffic

def scans():
    v = F.col("v")
    return {"total": ordered.running_total(v), "last": ordered.latest(v), "next": ordered.coming(v), "before": ordered.previous(v), "after": ordered.following(v), "start": ordered.first(v)}


def rows_of(n=3000, seed=1):
    """One key with most rows, ties, nulls in keys, places and values."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40), *range(200, 210)]) if i % 3 else 5, i, rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [None, 700, 50, 1])
def test_chunks_equal_whole_windows(spark, chunk_rows):
    df = spark.createDataFrame(rows_of(), "k string, at int, i int, v int")
    up = W.partitionBy("k").orderBy("at", "i")
    down = W.partitionBy("k").orderBy(F.desc("at"), "i")
    to = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    plain = df.select(
        "i", F.sum(F.coalesce("v", F.lit(0))).over(to(up)).alias("total"), F.last("v", ignorenulls=True).over(to(up)).alias("last"), F.last("v", ignorenulls=True).over(to(down)).alias("next"),
        F.lag("v").over(up).alias("before"), F.lead("v").over(up).alias("after"), F.first("v").over(up).alias("start"),
    )
    line = ordered.timeline(df, ("k",), "at", ("i",), chunk_rows)
    chunks = line.df.groupBy("k").agg(F.count_distinct("_chunk").alias("n")).collect()
    assert line.cut == (chunk_rows is not None) and (chunk_rows != 1 or min(r.n for r in chunks) > 20)
    assert line.df.groupBy("k", "at").agg(F.count_distinct("_chunk").alias("n")).where("n > 1").isEmpty()
    got = line.scan(**scans()).rows().select(plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_without_keys_and_by_times(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(seconds=k * k % 997), k) for k in range(500)], "at timestamp_ntz, v int")
    got = ordered.timeline(df, (), "at", ("v",), 20).scan(total=ordered.running_total(F.col("v")), next=ordered.following(F.col("v"))).rows()
    assert got.columns == ["at", "v", "total", "next"]
    expected = sorted((r.at, r.v) for r in df.collect())
    assert [(r.v, r.next) for r in sorted(got.collect(), key=lambda r: (r.at, r.v))] == [(v, n) for (_, v), (_, n) in zip(expected, [*expected[1:], (None, None)])]


def test_a_text_order_is_not_cut(spark):
    df = spark.createDataFrame([("k", str(n), n) for n in range(50)], "k string, at string, v int")
    assert not ordered.timeline(df, ("k",), "at", (), 5).cut


def plain_nearest(request, frames, before=15, after=30, days=30):
    """By the stages as they are told."""
    if request is None:
        return None, None, None
    minutes = lambda f: (f[0] - request).total_seconds() / 60
    stages = [[f for f in frames if -before <= minutes(f) <= after], [f for f in frames if f[0].date() == request.date()]]
    near = sorted({f[0].date() for f in frames if abs((f[0].date() - request.date()).days) <= days}, key=lambda d: (abs((d - request.date()).days), -(d - request.date()).days))
    stages.append([f for f in frames if near and f[0].date() == near[0]])
    for stage, found in enumerate(stages, 1):
        if found:
            return (stage, *min(found, key=lambda f: (abs(f[0] - request), f[0], f[1])))
    return None, None, None


@pytest.mark.parametrize("chunk_rows", [None, 10])
def test_nearest_frame_equals_its_stages(spark, chunk_rows):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    at = lambda days: start + timedelta(days=rng.randrange(days), minutes=rng.randrange(0, 1440, 5))
    frames = [(at(200) if rng.random() < 0.3 else at(9), f"p{k:03}") for k in range(150)]
    frames += frames[:20] + [(t, "a" + p) for t, p in frames[:20]] + [(None, "none")]
    asked = [(k, at(260) if k % 2 else at(12)) for k in range(400)] + [(1000, None), (3, start)]
    asked += [(2000 + k, t) for k, (t, _) in enumerate(frames[:30])]
    got = archive.nearest_frame(spark.createDataFrame(asked, "request_id int, at timestamp_ntz"), spark.createDataFrame(frames, "ts timestamp_ntz, path string"), chunk_rows=chunk_rows)
    known = [f for f in frames if f[0] is not None]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(k, t, *plain_nearest(t, known)) for k, t in asked], key=key)
    none = spark.createDataFrame([], "ts timestamp_ntz, path string")
    assert {r.stage for r in archive.nearest_frame(spark.createDataFrame(asked, "request_id int, at timestamp_ntz"), none, chunk_rows=chunk_rows).collect()} == {None}


def test_jobs_on_one_long_key_equal_uncut_ones(spark):
    rng = random.Random(4)
    events = spark.createDataFrame([("s", k // 3, k, rng.choice(["Left", "Right", None])) for k in range(600)], "source string, ts int, event_id int, direction string")
    samples = spark.createDataFrame([("s", 7 * k, float(k)) for k in range(60)], "source string, ts int, CPU_usage double")
    points = spark.createDataFrame([("s", 1, rng.randrange(5000)) for _ in range(500)], "source string, track_id int, frame_idx int")
    times = spark.createDataFrame([(1, rng.randrange(3000)) for _ in range(500)], "audio_id int, t bigint")
    mapping = spark.createDataFrame([(1, rng.randrange(200, 2800), rng.randrange(9000)) for _ in range(70)], "audio_id int, processed_time bigint, original_time bigint")
    segments = times.selectExpr("audio_id", "row_number() over (order by t) seg_no", "t t0", "t + 40 t1")
    sound = spark.range(4000).selectExpr("1 audio_id", "id * 100 i", "cast(id % 7 as double) left", "cast(id % 5 as double) right")
    frames = spark.createDataFrame([("top", k // 2, f"p{k}") for k in range(300)], "camera string, ts int, path string")
    jobs = [
        lambda n: traffic.running_counts(events, order=("ts", "event_id"), chunk_rows=n), lambda n: traffic.attach_telemetry(events, samples, columns=("CPU_usage",), chunk_rows=n),
        lambda n: traffic.track_sessions(points, 3, chunk_rows=n), lambda n: speech.map_time(times, mapping, chunk_rows=n), lambda n: speech.segment_energy(segments, sound, chunk_rows=n),
        lambda n: archive.playback_sequence(frames, "full", chunk_rows=n), lambda n: archive.playback_sequence(frames, "none", chunk_rows=n),
    ]
    for job in jobs:
        assert sorted(map(str, job(40).collect())) == sorted(map(str, job(None).collect()))


def sequential(x, alpha):
    y = []
    for k, v in enumerate(x):
        y.append(v if k == 0 else alpha * (y[-1] + v - x[k - 1]))
    return y


@pytest.mark.parametrize("textbook, chunk_rows", [(False, None), (True, None), (True, 100), (False, 100), (True, 1)])
def test_high_pass_equals_the_sequential_form(spark, textbook, chunk_rows):
    rng = random.Random(6)
    sizes = {0: 3000, 1: 1, 2: 127, 3: 128, 4: 129}
    rows = [(a, 3 * i, rng.gauss(0, 1) + 5, "x") for a, n in sizes.items() for i in range(n)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {(r.audio_id, r.i): r.value for r in speech.high_pass(spark.createDataFrame(shuffled, "audio_id int, i int, value double, tag string"), 400.0, 16_000, textbook, chunk_rows).collect()}
    rc, dt = 1 / (2 * 3.141592653589793 * 400.0), 1 / 16_000
    alpha = (rc if textbook else dt) / (rc + dt)
    for a in sizes:
        expected = sequential([v for b, _, v, _ in rows if b == a], alpha)
        assert all(abs(got[a, 3 * i] - y) < 1e-9 for i, y in enumerate(expected))
    assert len(got) == len(rows)


def test_a_million_samples_of_one_audio():
    import numpy as np

    x = np.random.default_rng(1).normal(size=1_000_000)
    alpha = 0.97
    got = speech.filtered(x, alpha, x[0] * (1 - alpha) / alpha)
    assert np.abs(got - np.array(sequential(x.tolist(), alpha))).max() < 1e-9
