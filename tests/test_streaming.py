"""Streams give what the batch form gives on the same rows, and drop what is later than the watermark."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from nodewell.operators import traffic
from nodewell.streaming import streams

T0 = datetime(2024, 1, 1)


def written(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, stream, tmp_path, mode="append"):
    out, name = [], {"q": stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))}
    q = name["q"].foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return out


MOVE = "ts timestamp, Direction string, CPU_usage double, GPU_usage double, mem_usage double, CPU_temp double, GPU_temp double"


def test_minute_rollup_and_upsert(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=17 * i), ("Right", "Left", None)[i % 3], float(i % 7) - 1, 1.0, 2.0, 3.0, -1.0) for i in range(60)]
    batch, stream = written(spark, tmp_path, rows, MOVE)
    path = str(tmp_path / "minutes")
    q = streams.start_minute_upsert(streams.stream_minute_rollup(stream), path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    named = batch.withColumns({"Date": F.date_format("ts", "yyyy-MM-dd"), "Time": F.date_format("ts", "HH:mm:ss")})
    expected = traffic.minute_rollup(named)
    got = traffic.read_minutes(spark, path).select(*expected.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, expected.collect()))


def test_late_rows_are_dropped_by_the_stream_alone(spark, tmp_path):
    rows = [(T0 + timedelta(hours=h), "Right", 1.0, 1.0, 1.0, 1.0, 1.0) for h in (0, 5, 6, 6, 0, 7)]  # Spark filters by the watermark of the batch before
    batch, stream = written(spark, tmp_path, rows, MOVE)
    out = collected(spark, streams.stream_minute_rollup(stream), tmp_path, "update")
    assert sum(r.direction_right for r in out if r.Time == "00:00") == 1
    assert batch.where(F.hour("ts") == 0).count() == 2


def test_track_direction(spark, tmp_path):
    rows = []
    for t, frames in ((1, range(30)), (2, [*range(20), *range(160, 190)]), (3, range(10)), (9, range(0, 2000, 50))):
        rows += [("s", t, f, T0 + timedelta(milliseconds=33 * f), 20 * f if t != 2 else -20 * f) for f in frames]
    rows.sort(key=lambda r: r[2])
    schema = "source string, track_id long, frame_idx long, ts timestamp, cx long"
    batch, stream = written(spark, tmp_path, rows, schema)
    found = {(r.track_id, r.session, r.points, r.x_start, r.x_end, r.direction) for r in collected(spark, streams.stream_track_direction(stream), tmp_path)}
    expected = {(r.track_id, r.session, r.points, r.x_start, r.x_end, r.direction) for r in traffic.track_direction(batch).collect()}
    assert expected == found and {e[0] for e in expected} == {1, 2}


def test_points_that_come_a_batch_late_are_sorted_in(spark, tmp_path):
    frames = [*range(0, 20, 2), *range(1, 20, 2), *range(20, 30), 2000]
    rows = [("s", 1, f, T0 + timedelta(milliseconds=33 * f), 20 * f) for f in frames]
    schema = "source string, track_id long, frame_idx long, ts timestamp, cx long"
    batch, stream = written(spark, tmp_path, rows, schema)
    found = collected(spark, streams.stream_track_direction(stream), tmp_path)
    assert [(r.points, r.x_start, r.x_end) for r in found] == [(30, 0, 580)]


def test_any_order_of_arrival_gives_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for track in range(6):
        at = 0
        for _ in range(4):
            rows += [("s", track, at + f, T0 + timedelta(milliseconds=33 * (at + f)), rng.choice([-9, 9, 1]) * f) for f in range(rng.randrange(5, 160))]
            at += 160 + rng.randrange(10, 300)
    schema = "source string, track_id long, frame_idx long, ts timestamp, cx long"
    rows = [*sorted(rows, key=lambda r: r[2] + rng.randrange(300)), ("s", 99, 9999, T0 + timedelta(seconds=9999), 0)]  # up to ten seconds out of order
    batch, stream = written(spark, tmp_path, rows, schema, 6)
    keys = lambda rs: sorted((r.track_id, r.session, r.points, r.x_start, r.x_end, r.last_frame, str(r.direction)) for r in rs)
    expected = keys(traffic.track_direction(batch).collect())
    assert len(expected) > 12 and keys(collected(spark, streams.stream_track_direction(stream, late="20 seconds"), tmp_path)) == expected


def left(spark, tmp_path, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / "cp")).count()


def test_tracks_are_forgotten(spark, tmp_path):
    at = lambda f: T0 + timedelta(milliseconds=33 * f)
    rows = [("s", 1, f, at(f), f) for f in range(20)] + [("s", 2, 200_000, at(200_000), 1)] * 20 + [("s", 2, 400_000, at(400_000), 1)] * 20
    _, stream = written(spark, tmp_path, rows, "source string, track_id long, frame_idx long, ts timestamp, cx long")
    out = collected(spark, streams.stream_track_direction(stream, forget_s=60), tmp_path)
    assert [(r.track_id, r.points) for r in out][:1] == [(1, 20)]
    assert left(spark, tmp_path, "session") <= 1 and left(spark, tmp_path, "open") == 0


def test_change_feed(spark, tmp_path):
    batch, stream = written(spark, tmp_path, [("k", 1, 1), ("k", 1, 2), ("k", 2, 9), ("k", 3, 4), ("k", 3, 5), ("k", 5, 3)], "key string, v long, n long")
    timed = stream.withColumn("at", F.timestamp_seconds("n"))
    assert [r.v for r in collected(spark, streams.stream_change_feed(timed, "key", ["v"], ["n"], "at"), tmp_path)] == [1, 2, 3]


def test_change_feed_by_the_clock(spark, tmp_path):
    _, stream = written(spark, tmp_path, [("k", 1), ("k", 2), ("k", 2)], "key string, v long")
    out = []
    q = streams.stream_change_feed(stream, "key", ["v"]).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    for _ in range(300):  # by the clock there is always another batch, so none is the last
        if len(out) >= 2 or not q.isActive:
            break
        time.sleep(0.2)
    q.stop()
    assert [r.v for r in out] == [1, 2]


def test_the_change_feed_forgets_keys(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("k", 1, at(0)), ("k", 1, at(1)), ("z", 1, at(30)), ("z", 1, at(31)), ("k", 1, at(40)), ("k", None, at(43)), ("k", None, at(44))]
    _, stream = written(spark, tmp_path, rows, "key string, v int, ts timestamp", 7)
    out = collected(spark, streams.stream_change_feed(stream, "key", ["v"], ["ts"], "ts", ttl_s=36_000), tmp_path)
    assert [(r.key, r.v) for r in out] == [("k", 1), ("z", 1), ("k", 1), ("k", None)]  # k is forgotten and sent again
    assert left(spark, tmp_path, "sent") == 1  # z, whose time is over, has gone


def test_history_keeps_the_last_days(spark, tmp_path):
    rows = [("2024-01-01", "10:00", 1), ("2024-02-20", "10:00", 2), ("2024-02-20", "10:00", 3)]
    _, stream = written(spark, tmp_path, rows, "Date string, Time string, n int")
    q = streams.start_history_merge(stream, str(tmp_path / "m"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = [(str(r.Date), r.n) for r in traffic.read_minutes(spark, str(tmp_path / "m-recent")).collect()]
    assert kept == [("2024-02-20", 3)] and traffic.read_minutes(spark, str(tmp_path / "m")).count() == 2


def test_windows_and_power(spark, tmp_path):
    rows = [("r", T0 + timedelta(seconds=20 * i), f"VIN {1000 * (i + 1)}mW/1mW") for i in range(6)]
    batch, stream = written(spark, tmp_path, rows, "run string, ts timestamp, value string")
    out = collected(spark, streams.stream_power(stream), tmp_path, "update")
    last = {r.start: r for r in out}
    first = last[T0]
    assert (first.watts_avg, first.watts_peak, first.samples, first.energy_joules) == (2.0, 3.0, 3, 120.0)
    s = streams.viewer_sessions(batch, user="run", idle="10 seconds")
    assert s.count() == 6 and streams.viewer_sessions(batch, user="run").count() == 1
    assert streams.sliding_chunks(batch, "60 seconds", "20 seconds", keys=("run",)).count() == 8
