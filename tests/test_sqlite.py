"""SQLite tables: types, ranges of rows, filters, many files, and files that appear whole."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from nodewell.sources import sqlite


def database(path, said, rows, marks):
    c = sqlite3.connect(path)
    c.execute(said)
    c.executemany(f"insert into {said.split()[2]} values ({marks})", rows)
    c.commit()
    c.close()
    return str(path)


def test_minutes_are_read_by_several_tasks(spark, tmp_path):
    said = "create table directional_data (date TEXT, minute TEXT, direction_left INTEGER, direction_right INTEGER, cpu REAL)"
    rows = [(f"2024-01-{d:02}", f"{m // 60:02}:{m % 60:02}", m % 7, m % 5, m / 4) for d in range(1, 8) for m in range(0, 1440, 10)]
    df = sqlite.read_sqlite(spark, database(tmp_path / "a.db", said, rows, "?,?,?,?,?"), "directional_data")
    assert df.dtypes == [("date", "string"), ("minute", "string"), ("direction_left", "bigint"), ("direction_right", "bigint"), ("cpu", "double")]
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    some = df.where("date = '2024-01-03' and direction_left > 5 and minute in ('00:00', '10:00', '22:10')")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] == "2024-01-03" and r[2] > 5 and r[1] in ("00:00", "10:00", "22:10"))
    few = sqlite.read_sqlite(spark, str(tmp_path / "a.db"), "directional_data", ["minute", "cpu"], 3)
    assert few.columns == ["minute", "cpu"] and few.agg(F.sum("cpu")).first()[0] == sum(r[4] for r in rows)


def test_filters_reach_the_database():
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import StructType

    reader = sqlite.Reader(StructType.fromDDL("n bigint, t string, b binary"), {"table": "x"})
    given = [ds.GreaterThan(("n",), 4), ds.EqualTo(("t",), "a"), ds.IsNull(("n",)), ds.EqualTo(("b",), b"x"), ds.In(("n",), (1, 2)), ds.EqualTo(("n",), "4")]
    assert list(reader.pushFilters(given)) == given
    assert reader.where == ['"n" collate binary > ?', sqlite.said("t", "string") + " collate binary = ?", '"n" collate binary in (?, ?)'] and reader.values == [4, "a", 1, 2]


def test_values_of_other_types_and_odd_names(spark, tmp_path):
    said = 'create table photos ("file name" VARCHAR(20) collate nocase, n INT, x FLOAT, "se""t" BLOB, any)'
    rows = [("b", 1, 1, b"\x00", 5), ("B", "x", "y", "text", "z"), (None, 2.5, None, None, None), (7, 2.0, 2.5, b"", b"\x01"), ("é", -9, 1e300, b"q", 1.5)]
    df = sqlite.read_sqlite(spark, database(tmp_path / "o'dd #1.db", said, rows, "?,?,?,?,?"), "photos")
    assert [c for c, _ in df.dtypes] == ["file name", "n", "x", 'se"t', "any"]
    expected = [("b", 1, 1.0, b"\x00", "5"), ("B", None, None, b"text", "z"), (None, None, None, None, None), ("7", 2, 2.5, b"", None), ("é", -9, 1e300, b"q", "1.5")]
    plain = lambda r: tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)
    assert sorted(map(plain, df.collect()), key=str) == sorted(expected, key=str)
    for said, wanted in (("`file name` = 'b'", 1), ("`file name` < 'a'", 2), ("n is null", 2), ("n < 2", 2), ("n >= 2", 1), ("x > 2", 2), ("any = '5'", 1)):
        assert df.where(said).count() == wanted, said


def test_tables_without_rowids_views_and_faults(spark, tmp_path):
    path = database(tmp_path / "w.db", "create table w (k TEXT primary key, v INTEGER) without rowid", [("a", 1), ("b", 2)], "?,?")
    c = sqlite3.connect(path)
    c.execute("create view seen as select v * 2 as d from w")
    c.execute("create table empty_one (v INTEGER)")
    c.commit()
    c.close()
    assert sqlite.read_sqlite(spark, path, "w").count() == 2 and sqlite.read_sqlite(spark, path, "empty_one").count() == 0
    assert sorted(int(float(r.d)) for r in sqlite.read_sqlite(spark, path, "seen").collect()) == [2, 4]
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, path, "absent").count()
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite.read_sqlite(spark, str(tmp_path / "none*.db"), "w").count()
    with pytest.raises(ValueError):
        sqlite.local_path("hdfs://x/y")


def test_round_trip_as_many_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as int) k", "concat('t', id) t", "id / 8 x", "timestamp_ntz'2024-01-01 00:00:00' at", "if(id % 2 = 0, null, true) b").repartition(5)
    path = str(tmp_path / "many")
    sqlite.write_sqlite(df, path, "rows")
    assert len(os.listdir(path)) == 5 and not [f for f in os.listdir(path) if f.startswith(".")]
    back = sqlite.read_sqlite(spark, "file:" + path, "rows", partitions=20)
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() == 20
    told = df.selectExpr("id", "cast(k as bigint) k", "t", "x", "cast(at as string) at", "cast(b as bigint) b")
    assert back.exceptAll(told).isEmpty() and told.exceptAll(back).isEmpty()
    sqlite.write_sqlite(df.limit(10), path, "rows")
    assert sqlite.read_sqlite(spark, path, "rows").count() == 1010
    sqlite.write_sqlite(df.limit(7), path, "rows", overwrite=True)
    assert sqlite.read_sqlite(spark, path, "rows").count() == 7


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "failed")
    sqlite.write_sqlite(spark.range(5), path, "rows")
    with pytest.raises(Exception):
        sqlite.write_sqlite(spark.range(100).selectExpr("if(id = 77, raise_error('no'), id) id"), path, "rows")
    assert len(os.listdir(path)) == len([f for f in os.listdir(path) if f.startswith("part-")]) and sqlite.read_sqlite(spark, path, "rows").count() == 5
