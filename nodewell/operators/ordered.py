"""Ordered scans of keys of any size: a key with many rows is cut into chunks by its order, each chunk is scanned by itself, and
what the chunks before or after it carry over comes from a table with one row per chunk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

SIDE = 32  # a long key is cut into SIDE * SIDE chunks


def number(df: DataFrame, column: str) -> Column | None:
    """column as a number in the same order; None where it is neither a number nor a time."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    return F.col(column) if isinstance(kind, T.NumericType) else None


@dataclass(frozen=True)
class Scan:
    """One carried column: its value inside a chunk, what a chunk tells the others, and what a chunk is told by them."""

    inside: Callable[[W, W], Column]  # of the ascending and descending windows
    told: Callable[[Column, Column], Column]  # aggregate of a chunk, by the orders of both directions
    carried: Callable[[Column, W], Column]  # over the chunks of a key in ascending order
    joined: Callable[[Column, Column], Column]  # of the value inside and what is carried


def running_total(value: Column) -> Scan:
    """Sum up to and with the row; nulls count nothing."""
    v = F.coalesce(value, F.lit(0))
    return Scan(
        lambda up, _: F.sum(v).over(up.rowsBetween(W.unboundedPreceding, 0)),
        lambda up, _: F.sum(v),
        lambda told, chunks: F.sum(told).over(chunks.rowsBetween(W.unboundedPreceding, -1)),
        lambda own, before: own + F.coalesce(before, F.lit(0)),
    )


def latest(value: Column) -> Scan:
    """The last value that is not null up to and with the row."""
    return Scan(
        lambda up, _: F.last(value, ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, 0)),
        lambda up, _: F.max_by(value, F.when(value.isNotNull(), up)),
        lambda told, chunks: F.last(told, ignorenulls=True).over(chunks.rowsBetween(W.unboundedPreceding, -1)),
        lambda own, before: F.coalesce(own, before),
    )


def coming(value: Column) -> Scan:
    """The first value that is not null from the row on; rows at the same place count as later if their ties are lower."""
    return Scan(
        lambda _, down: F.last(value, ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0)),
        lambda _, down: F.max_by(value, F.when(value.isNotNull(), down)),
        lambda told, chunks: F.first(told, ignorenulls=True).over(chunks.rowsBetween(1, W.unboundedFollowing)),
        lambda own, after: F.coalesce(own, after),
    )


def previous(value: Column) -> Scan:
    """The value of the row before, null or not; null for a key's first."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda up, _: F.lag(boxed).over(up),
        lambda up, _: F.max_by(boxed, up),
        lambda told, chunks: F.lag(told).over(chunks),
        lambda own, before: F.coalesce(own, before)["v"],
    )


def following(value: Column) -> Scan:
    """The value of the row after, null or not; null for a key's last."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda up, _: F.lead(boxed).over(up),
        lambda up, _: F.min_by(boxed, up),
        lambda told, chunks: F.lead(told).over(chunks),
        lambda own, after: F.coalesce(own, after)["v"],
    )


def first(value: Column) -> Scan:
    """The value of the key's first row, null or not."""
    boxed = F.struct(value.alias("v"))
    return Scan(
        lambda up, _: F.first(boxed).over(up),
        lambda up, _: F.min_by(boxed, up),
        lambda told, chunks: F.first(told).over(chunks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        lambda own, whole: F.coalesce(whole, own)["v"],
    )


@dataclass(frozen=True)
class Timeline:
    """df with the column _chunk, which is 0 but for the rows of long keys; at: the place in a key's order; ties: columns that
    order the rows of one place."""

    df: DataFrame
    keys: tuple[str, ...]
    at: str
    ties: tuple[str, ...]
    cut: bool

    def scan(self, **columns: Scan) -> Timeline:
        """The timeline with these columns. A window per key and chunk, in either direction; if there are chunks, the table of
        what they tell is joined on key and chunk, by which the rows are partitioned already."""
        group = [*self.keys, "_chunk"]
        up = W.partitionBy(*group).orderBy(self.at, *self.ties)
        down = W.partitionBy(*group).orderBy(F.desc(self.at), *self.ties)
        inside = self.df.withColumns({name: s.inside(up, down) for name, s in columns.items()})
        if not self.cut:
            empty = F.lit(None)
            return replace(self, df=inside.withColumns({name: s.joined(F.col(name), empty) for name, s in columns.items()}))
        place = number(self.df, self.at)
        ascending, descending = F.struct(place.alias("at"), *self.ties), F.struct((-place).alias("at"), *self.ties)
        told = self.df.groupBy(*group).agg(*[s.told(ascending, descending).alias(name) for name, s in columns.items()])
        chunks = W.partitionBy(*self.keys).orderBy("_chunk")
        carried = told.select(*group, *[s.carried(F.col(name), chunks).alias(f"_told_{name}") for name, s in columns.items()])
        same = [inside[c].eqNullSafe(carried[c]) for c in group]
        both = inside.join(carried, same).select(*[inside[c] for c in inside.columns], *[f"_told_{name}" for name in columns])
        out = both.withColumns({name: s.joined(F.col(name), F.col(f"_told_{name}")) for name, s in columns.items()})
        return replace(self, df=out.select(*inside.columns))

    def rows(self) -> DataFrame:
        return self.df.drop("_chunk", "_all")


def timeline(df: DataFrame, keys: tuple[str, ...], at: str, ties: tuple[str, ...] = (), chunk_rows: int | None = 1_000_000) -> Timeline:
    """df in order of `at` within its keys; without keys all rows are one key.

    Counts the rows of each key, which is a job. Keys of more than chunk_rows rows, of which there are few by that bound, are cut at
    approximate quantiles of at into some thousand chunks; rows of one place stay together. Rows with a null place come
    first, in the chunk before all cuts. With chunk_rows None, or where at is no number or time, nothing is counted or cut.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ("_all",)
    place = number(df, at)
    whole = Timeline(df.withColumn("_chunk", F.lit(0)), keys, at, ties, False)
    if chunk_rows is None or place is None:
        return whole
    long = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk_rows).drop("_n")
    if long.isEmpty():
        return whole
    share = [k / SIDE**2 for k in range(1, SIDE**2)]
    own = df.withColumn("_place", place)
    names = [f"_k{n}" for n in range(len(keys))]
    same = lambda few: [own[k].eqNullSafe(few[n]) for k, n in zip(keys, names, strict=True)]
    few = F.broadcast(long.toDF(*names))
    cuts = own.join(few, same(few), "left_semi").groupBy(*keys).agg(F.percentile_approx("_place", share, 10 * SIDE**2).alias("_cuts"))
    named = F.broadcast(cuts.toDF(*names, "_cuts"))
    cut = own.join(named, same(named), "left").drop(*names)
    below = lambda values: F.coalesce(F.size(F.filter(values, lambda c: c <= F.col("_place"))), F.lit(0))
    coarse = cut.withColumn("_coarse", below(F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda k: F.get(F.col("_cuts"), k * SIDE - 1))))
    fine = F.when(F.col("_cuts").isNull() | F.col("_place").isNull(), 0).otherwise(F.col("_coarse") * SIDE + below(F.slice("_cuts", F.col("_coarse") * SIDE + 1, F.lit(SIDE - 1))))
    return Timeline(coarse.withColumn("_chunk", fine).select(*df.columns, "_chunk"), keys, at, ties, True)
