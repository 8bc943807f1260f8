"""Tracks whose states share buckets: the same verdicts as the batch form, and a state a bucket instead of one a track."""

import random
from datetime import datetime, timedelta

import pytest

from nodewell.operators import traffic
from nodewell.streaming import streams

T0 = datetime(2024, 1, 1)
SCHEMA = "source string, track_id long, frame_idx long, ts timestamp, cx long"


def at(frame):
    return T0 + timedelta(milliseconds=33 * frame)


def written(spark, tmp_path, rows, parts):
    path = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def collected(stream, tmp_path):
    out = []
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(240)
    q.stop()
    return out


def keys(rows):
    return sorted((r.source, str(r.track_id), r.session, r.points, r.x_start, r.x_end, r.last_frame, r.dx, str(r.direction)) for r in rows)


def left(spark, tmp_path, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / "cp")).count()


@pytest.mark.parametrize("buckets, history", [(1, 120), (3, 7)])
def test_tracks_of_one_bucket_give_the_batch_form(spark, tmp_path, buckets, history):
    rng = random.Random(8)
    rows = []
    for source in ("a", "b"):
        for track in (1, 2, 2**60 + 1, -5, None):
            start = rng.randrange(200)
            for _ in range(5):
                rows += [(source, track, start + f, at(start + f), rng.choice([-9, 9, 1]) * f) for f in range(rng.choice([1, 14, 15, rng.randrange(5, 160)]))]
                start += 160 + rng.choice([0, 120, 121, 122, rng.randrange(400)])
    rows = [*sorted(rows, key=lambda r: r[2] + rng.randrange(300)), ("a", 99, 9999, at(9999), 0), ("b", 99, 9999, at(9999), 0)]  # up to ten seconds out of order
    batch, stream = written(spark, tmp_path, rows, 7)
    found = collected(streams.stream_track_direction(stream, late="20 seconds", history=history, least=4, buckets=buckets), tmp_path)
    expected = keys(traffic.track_direction(batch, history=history, least=4).collect())
    assert len(expected) > 20 and keys(found) == expected


def test_state_is_kept_by_bucket(spark, tmp_path):
    """3,000 tracks that have left, each remembered for a day."""
    rows = [("s", track, f, at(f), (f if track % 2 else -f)) for track in range(3000) for f in (0, 60, 120)] + [("s", -1, 9999, at(9999), 0)]
    batch, stream = written(spark, tmp_path, rows, 1)
    found = collected(streams.stream_track_direction(stream, late="0 seconds", least=3), tmp_path)
    assert len(found) == 3000 and keys(found) == keys(traffic.track_direction(batch, least=3).collect())
    assert left(spark, tmp_path, "session") <= 256 and left(spark, tmp_path, "waiting") == 0


def test_tracks_of_one_bucket_are_forgotten_one_by_one(spark, tmp_path):
    lone = lambda frame: ("s", 9, frame, at(frame), 0)
    rows = [("s", t, f, at(f), f) for t in (1, 2) for f in range(20)] + [lone(1000), ("s", 2, 1500, at(1500), 0), lone(2500), lone(4000)]
    rows += [("s", t, f, at(f), f) for t in (1, 2) for f in range(4100, 4120)] + [lone(6000), lone(9000)]
    cuts = [40, 41, 42, 43, 44, 84, 85, 86]
    path = str(tmp_path / "in")
    for a, b in zip([0, *cuts], cuts, strict=False):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = collected(streams.stream_track_direction(stream, late="0 seconds", forget_s=60, buckets=1), tmp_path)
    assert sorted((r.track_id, r.session, r.points, r.last_frame) for r in out) == [(1, 0, 20, 19), (1, 0, 20, 4119), (2, 0, 20, 19), (2, 2, 20, 4119)]
    assert left(spark, tmp_path, "session") == 1
