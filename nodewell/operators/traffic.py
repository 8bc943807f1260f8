"""Foot traffic: tracks to sessions, directions, minute, day and period rollups, dashboard figures."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nodewell.operators.ordered import latest, previous, running_total, timeline
from nodewell.sources.snapshots import Snapshots

TRACK = ("source", "track_id")


def track_sessions(points: DataFrame, patience: int = 120, keys: tuple[str, ...] = TRACK, frame: str = "frame_idx", chunk_rows: int | None = 1_000_000) -> DataFrame:
    """points with session: a track's number of gaps of more than `patience` absent frames so far."""
    line = timeline(points, keys, frame, (), chunk_rows).scan(_before=previous(F.col(frame)))
    line = replace(line, ties=("_before",))  # of repeated frames the one after the gap comes first
    new = F.coalesce((F.col(frame) - F.col("_before") - 1 > patience).cast("int"), F.lit(0))
    return line.scan(session=running_total(new)).rows().drop("_before")


def track_direction(points: DataFrame, threshold: float = 100, patience: int = 120, history: int = 120, least: int = 15, closed_only: bool = True, x: str = "cx", keys: tuple[str, ...] = TRACK, frame: str = "frame_idx") -> DataFrame:
    """One row per session of `least` points or more that has ended: first and last x of its last `history` points, dx, and
    direction Right (dx above the threshold), Left (below minus the threshold) or null. A session has ended if its source
    went on for more than `patience` frames. The older form: history 20, least 2, patience 0, closed_only False."""
    s = track_sessions(points, patience, keys, frame)
    late = F.row_number().over(W.partitionBy(*keys, "session").orderBy(F.desc(frame)))
    last = s.withColumn("_r", late).where(F.col("_r") <= history)
    g = last.groupBy(*keys, "session").agg(
        F.count("*").alias("points"), F.min_by(x, frame).alias("x_start"), F.max_by(x, frame).alias("x_end"), F.max(frame).alias("last_frame")
    ).where(F.col("points") >= least)
    if closed_only:
        ends = points.groupBy(keys[0]).agg(F.max(frame).alias("_max"))
        g = g.join(ends, keys[0]).where(F.col("_max") - F.col("last_frame") > patience).drop("_max")
    dx = F.col("x_end") - F.col("x_start")
    return g.withColumn("dx", dx).withColumn("direction", F.when(dx > threshold, "Right").when(dx < -threshold, "Left"))


def smooth_boxes(points: DataFrame, last: int = 5, keys: tuple[str, ...] = TRACK, frame: str = "frame_idx") -> DataFrame:
    """points with s_x1 ... s_y2: means of the last boxes, cut to integers."""
    w = W.partitionBy(*keys).orderBy(frame).rowsBetween(1 - last, 0)
    return points.withColumns({f"s_{c}": F.avg(c).over(w).cast("int") for c in ("x1", "y1", "x2", "y2")})


def running_counts(events: DataFrame, key: str = "source", order: tuple[str, ...] = ("ts",), chunk_rows: int | None = 1_000_000) -> DataFrame:
    """events with left, right and total so far; order should tell any two events of a key apart."""
    side = lambda name: running_total((F.col("direction") == name).cast("int"))
    return timeline(events, (key,), order[0], order[1:], chunk_rows).scan(left=side("Left"), right=side("Right"), total=running_total(F.lit(1))).rows()


METRICS = ("CPU_usage", "GPU_usage", "mem_usage", "CPU_temp", "GPU_temp")


def attach_telemetry(events: DataFrame, samples: DataFrame, key: str = "source", ts: str = "ts", columns: tuple[str, ...] = METRICS, chunk_rows: int | None = 1_000_000) -> DataFrame:
    """events with the latest sample of their source at or before them: both streams in one order, of samples at one time the
    greatest, the last sample carried on."""
    kept = F.struct(*columns)
    both = events.withColumns({"_e": F.lit(1), "_s": F.lit(None).cast(samples.select(kept.alias("s")).schema["s"].dataType)}).unionByName(
        samples.select(key, ts, F.lit(0).alias("_e"), kept.alias("_s")), allowMissingColumns=True
    )
    out = timeline(both, (key,), ts, ("_e", "_s"), chunk_rows).scan(_l=latest(F.col("_s"))).rows().where("_e = 1")
    return out.select(*events.columns, *[F.col(f"_l.{c}").alias(c) for c in columns])


def minute_rollup(events: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per (Date, Time HH:MM): means without the missing mark -1 (-1 if nothing else), rounded to 2, and events to the right and
    not to the right; a null direction counts for neither."""
    minute = F.substring("Time", 1, 5)
    means = [F.coalesce(F.round(F.round(F.avg(F.nullif(c, F.lit(-1.0))), 9), 2), F.lit(-1.0)).alias(c) for c in metrics]
    right = F.col("Direction") == "Right"
    return events.groupBy("Date", minute.alias("Time")).agg(*means, F.count_if(~right).alias("direction_left"), F.count_if(right).alias("direction_right"))


def day_rollup(blocks: DataFrame, metrics: tuple[str, ...] = ("cpu", "mem", "swap", "cpu_temp", "gpu_temp")) -> DataFrame:
    """Per run of consecutive blocks of one date, in file order: means rounded to 2, events to the right (a direction of exactly
    " Right") and other. A date that comes back after another is a run of its own."""
    w = W.partitionBy("file").orderBy("block")
    new = F.coalesce((F.col("date") != F.lag("date").over(w)).cast("int"), F.lit(1))
    runs = blocks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    right = F.coalesce(F.col("direction") == " Right", F.lit(False))
    means = [F.round(F.round(F.avg(c), 9), 2).alias(c) for c in metrics]
    return runs.groupBy("file", "run", "date").agg(*means, F.count_if(~right).alias("left"), F.count_if(right).alias("right"))


def daily_totals(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy("Date").agg(F.sum("direction_left").alias("left"), F.sum("direction_right").alias("right"), F.sum(F.col("direction_left") + F.col("direction_right")).alias("total"))


def traffic_dashboard(minutes: DataFrame, now: str, days: int = 7) -> DataFrame:
    """One row: today's totals, and of the last days with an event the mean left, right (each over the days that have some) and
    daily total, rounded half up, and the day with most events, the earliest of equals. Without such a day these are null.
    now is a time and a day is told by its midnight, so of `days` days the oldest is left out unless now is at midnight."""
    at = F.lit(now).cast("timestamp_ntz")
    day = F.to_date("Date").cast("timestamp_ntz")
    recent = minutes.withColumn("_d", day).where(F.col("_d") >= at - F.expr(f"interval {days - 1} days"))
    per_day = recent.groupBy("_d").agg(F.sum("direction_left").alias("l"), F.sum("direction_right").alias("r"))
    today = F.col("_d") == F.date_trunc("day", at).cast("timestamp_ntz")
    total, valid = F.col("l") + F.col("r"), (F.col("l") > 0) | (F.col("r") > 0)

    def mean(c: Column, over: Column) -> Column:
        return F.floor(F.try_divide(F.sum(F.when(over, c)), F.count_if(over)) + 0.5)

    some = F.count_if(valid) > 0
    date = F.col("_d").cast("date")
    return per_day.agg(
        F.coalesce(F.sum(F.when(today, F.col("l"))), F.lit(0)).alias("today_left"), F.coalesce(F.sum(F.when(today, F.col("r"))), F.lit(0)).alias("today_right"),
        F.when(some, F.coalesce(mean(F.col("l"), F.col("l") > 0), F.lit(0))).alias("avg_left"), F.when(some, F.coalesce(mean(F.col("r"), F.col("r") > 0), F.lit(0))).alias("avg_right"),
        mean(total, valid).alias("avg_daily_total"),
        F.max_by(F.when(valid, date.cast("string")), F.when(valid, F.struct(total, -F.unix_date(date)))).alias("peak_day"), F.max(F.when(valid, total)).alias("peak_total"),
    )


def period_rollup(minutes: DataFrame, unit: str = "week", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Totals and means per month and week (or day), with subtotals per month and over all (nulls)."""
    day = F.to_date("Date")
    g = minutes.select(F.date_trunc("month", day).cast("date").alias("month"), F.date_trunc(unit, day).cast("date").alias(unit), "direction_left", "direction_right", *metrics)
    means = [F.round(F.round(F.avg(F.nullif(c, F.lit(-1.0))), 9), 2).alias(c) for c in metrics]
    return g.rollup("month", unit).agg(F.sum("direction_left").alias("left"), F.sum("direction_right").alias("right"), *means)


def change_feed(minutes: DataFrame, order: tuple[str, ...], columns: list[str]) -> DataFrame:
    """Rows that differ in `columns` from the row before, in one order, whose columns should tell any two rows apart. Each value of
    the order's first column, a date, is a task of its own; only the last rows of the dates pass through one."""
    day, own = order[0], F.struct(*columns)
    last = minutes.groupBy(day).agg(F.max_by(own, F.struct(*order)).alias("_l"))
    before = last.select(day, F.lag("_l").over(W.orderBy(day)).alias("_d"))
    w = W.partitionBy(day).orderBy(*order)
    marked = minutes.withColumns({"_b": F.lag(own).over(w), "_k": F.row_number().over(w)}).join(before.withColumnRenamed(day, "_day"), F.col(day).eqNullSafe(F.col("_day")))
    return marked.where(~own.eqNullSafe(F.when(F.col("_k") == 1, F.col("_d")).otherwise(F.col("_b")))).select(*minutes.columns)


def latest_minute(minutes: DataFrame) -> DataFrame:
    return minutes.orderBy(F.desc("Date"), F.desc("Time")).limit(1)


def newest_first(minutes: DataFrame) -> DataFrame:
    return minutes.orderBy(F.desc("Date"), F.desc("Time"))


def merged_minutes(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with the rows of new in place of those with the same (Date, Time)."""
    return known.join(new.select("Date", "Time").distinct(), ["Date", "Time"], "left_anti").unionByName(new)


def upsert_minutes(spark: SparkSession, new: DataFrame, path: str, batch: tuple[str, int] | None = None) -> int:
    """Merge new minutes into the table of snapshots at path, by (Date, Time); only the dates that occur in new are read and
    written. Readers see the version before or the one after. batch: see sources.snapshots.Snapshots.upsert."""
    return Snapshots(spark, path).upsert(new, ("Date", "Time"), "Date", batch)


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """The last version of the minutes at path."""
    return Snapshots(spark, path).read()
