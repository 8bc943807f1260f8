"""Snapshots: versions, failures before the manifest, replays, and two writers."""

import pytest

from nodewell.sources.snapshots import Conflict, Snapshots

SCHEMA = "Date string, Time string, n int, m int"
KEYS = ("Date", "Time")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "t"))


def test_versions_stay_as_they_were(spark, tmp_path):
    t = table(spark, tmp_path)
    put = lambda *r: t.upsert(spark.createDataFrame(r, SCHEMA), KEYS, "Date")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert put(("a", "1", 1, 1), ("a", "2", 2, 2), ("b/:%", "1", 3, 3)) == 0
    assert put(("a", "2", 20, None), ("c", "1", 4, 4), (None, None, 5, 5)) == 1
    assert put((None, None, 6, 6), ("a", "2", 7, 1), ("a", "2", 7, 2)) == 2  # of equal keys the greatest
    assert put() == 3
    assert rows(t.read(0)) == [("a", "1", 1, 1), ("a", "2", 2, 2), ("b/:%", "1", 3, 3)]
    assert rows(t.read()) == rows(t.read(2)) == sorted([("a", "1", 1, 1), ("a", "2", 7, 2), ("b/:%", "1", 3, 3), ("c", "1", 4, 4), (None, None, 6, 6)], key=str)
    assert t.manifest(1).parts["b/:%"] == t.manifest(0).parts["b/:%"]  # untouched dates are not written again
    assert t.vacuum(keep=1, older_than_s=1e9) == 0 and t.vacuum(keep=1, older_than_s=0) > 0
    assert t.versions() == [3] and len(rows(t.read())) == 5


def test_a_failure_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", "1", 1, 1)], SCHEMA), KEYS, "Date")
    new = spark.createDataFrame([("a", "1", 2, 2), ("b", "1", 3, 3)], SCHEMA)

    def lost(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lost)
        with pytest.raises(RuntimeError, match="lost"):
            t.upsert(new, KEYS, "Date", ("s", 0))
    assert rows(t.read()) == [("a", "1", 1, 1)]
    assert t.upsert(new, KEYS, "Date", ("s", 0)) == 1 and rows(t.read()) == [("a", "1", 2, 2), ("b", "1", 3, 3)]


def test_a_replayed_batch_is_merged_once(spark, tmp_path):
    t = table(spark, tmp_path)
    put = lambda n, b: t.upsert(spark.createDataFrame([("a", "1", n, n)], SCHEMA), KEYS, "Date", b)
    assert [put(1, ("s", 0)), put(2, ("s", 1)), put(1, ("s", 0)), put(9, ("other", 0)), put(2, ("s", 1))] == [0, 1, 1, 2, 2]
    assert rows(t.read()) == [("a", "1", 9, 9)]
    assert t.replace(t.read(), "Date", ("other", 0)) == 2


@pytest.mark.parametrize("date", ["a", "z"])
def test_of_two_writers_none_loses_rows(spark, tmp_path, monkeypatch, date):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", "1", 1, 1), ("z", "1", 1, 1)], SCHEMA), KEYS, "Date")
    publish, writes, met = Snapshots._publish, [], []

    def interrupted(self, manifest):
        if not met:
            met.append(1)
            Snapshots(spark, t.path).upsert(spark.createDataFrame([(date, "2", 2, 2)], SCHEMA), KEYS, "Date")
        publish(self, manifest)

    write = Snapshots._write
    monkeypatch.setattr(Snapshots, "_publish", interrupted)
    monkeypatch.setattr(Snapshots, "_write", lambda self, *x: (writes.append(1), write(self, *x))[1])
    assert t.upsert(spark.createDataFrame([("a", "3", 3, 3)], SCHEMA), KEYS, "Date") == 2
    assert rows(t.read()) == sorted([("a", "1", 1, 1), ("z", "1", 1, 1), (date, "2", 2, 2), ("a", "3", 3, 3)])
    assert len(writes) == (3 if date == "a" else 2)  # merged again only if it touched the same date


def test_a_taken_number_is_refused(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", "1", 1, 1)], SCHEMA), KEYS, "Date")
    with pytest.raises(Conflict):
        t._next(type(t.manifest())(), {}, SCHEMA, None)
    assert t.versions() == [0]
