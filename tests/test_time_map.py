"""The query map_time against its SQL where doubles, nulls, repeated rows and early times tell."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nodewell.operators import speech

T0 = datetime(2024, 1, 1)
KIND = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def long_gaps():
    """Users with two clicks of one k days apart, and a view between them whose product passes 2^53."""
    out = []
    for span in range(150_000_001, 150_000_400):
        t = 134_000_003
        if int(float(t * span) / span) != t:
            out.append((span, t))
    return out[:5]


def test_the_query_equals_its_sql_beyond_whole_doubles(spark, tmp_path):
    centis = lambda n: T0 + timedelta(microseconds=10_000 * n)
    gaps, rows = long_gaps(), []
    for user, (span, t) in enumerate(gaps):
        rows += [(centis(at), user, kind) for at, kind in ((0, "click"), (t, "view"), (span, "click"))]
    rows += [(T0 - timedelta(microseconds=n), 50, kind) for n, kind in ((123_456, "click"), (77_777, "view"), (5_001, "click"))]
    rows += [(centis(5), None, "view"), (centis(9), None, "click"), (None, 0, "view"), (None, 60, "click"), (centis(3), 60, "view")]
    rows = [(n, ts, user, kind, 1.0, '{"k": 8}') for n, (ts, user, kind) in enumerate(rows)]
    rows += [rows[1], rows[1]]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    database = duckdb.connect()
    database.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    order = lambda r: (r[0], str(r[1]))
    expected = sorted(database.execute(entry.oracle_sql()["map_time"]).fetchall(), key=order)
    got = sorted(((r.seg_no, r.original_time) for r in entry.queries()["map_time"](spark, str(tmp_path)).collect()), key=order)
    assert len(gaps) == 5 and got == expected


@pytest.mark.parametrize("chunk_rows", [None, 2])
def test_the_job_divides_whole_numbers(spark, chunk_rows):
    gaps = long_gaps()
    points = spark.createDataFrame([(a, at, at + 7) for a, (span, _) in enumerate(gaps) for at in (0, span)] + [(0, None, 3), (None, 1, 2)], "audio_id int, processed_time long, original_time long")
    times = spark.createDataFrame([(a, t) for a, (_, t) in enumerate(gaps)] + [(0, None), (None, 5)], "audio_id int, t long")
    got = {(r.audio_id, r.t): r.original_time for r in speech.map_time(times, points, chunk_rows=chunk_rows).collect()}
    assert got == {**{(a, t): t + 7 for a, (_, t) in enumerate(gaps)}, (0, None): None, (None, 5): 5}
    doubles = speech.map_time(times, points, chunk_rows=chunk_rows, whole=False).where(F.col("audio_id").isNotNull() & F.col("t").isNotNull()).collect()
    assert {(r.audio_id, r.original_time) for r in doubles} == {(a, int(float(t * span) / span) + 7) for a, (span, t) in enumerate(gaps)}
