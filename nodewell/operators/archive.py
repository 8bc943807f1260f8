"""Camera archive and photo labels: nearest frames, ranges, playback, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from nodewell.operators.ordered import coming, first, following, latest, timeline


def nearest_frame(
    requests: DataFrame, frames: DataFrame, request: str = "request_id", at: str = "at", ts: str = "ts", path: str = "path", before: int = 15, after: int = 30, days: int = 30, chunk_rows: int | None = 1_000_000
) -> DataFrame:
    """(request, at, stage, ts, path): the frame closest to each requested time; of equals the earlier, of frames at one time the least path.

    Stage 1 looks from `before` minutes earlier to `after` minutes later, stage 2 at the same day, stage 3 at the nearest day within `days`
    (of two as near the later), there at the frame least apart in time; nothing, and a null time: nulls. In each stage the
    answer is the last frame up to the request or the first one from it on, so requests and frames pass in one order, which
    carries the last frame on and the next one back: a request meets two frames, however many its day has.
    """
    minute, day = 60_000_000, 86_400_000_000
    fr = frames.where(F.col(ts).isNotNull()).groupBy(F.col(ts).alias("_ts")).agg(F.min(path).alias("_path"))
    fr = fr.select(F.unix_micros(F.col("_ts").cast("timestamp")).alias("_at"), F.struct(F.unix_micros(F.col("_ts").cast("timestamp")).alias("f"), F.col("_ts").alias("ts"), F.col("_path").alias("path")).alias("_f"))
    req = requests.select(F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.struct(request, at).alias("_q"))
    both = fr.unionByName(req, allowMissingColumns=True).withColumn("_kind", F.col("_q").isNotNull())
    found = timeline(both, (), "_at", ("_kind",), chunk_rows).scan(_lo=latest(F.col("_f")), _hi=coming(F.col("_f"))).rows().where("_kind and _at is not null")
    # Days by the clock of the times as given.
    date = lambda c: F.unix_date(F.to_date(c))
    lo, hi = F.col("_at") - F.col("_lo.f"), F.col("_hi.f") - F.col("_at")
    lo_days, hi_days = date(f"_q.{at}") - date("_lo.ts"), date("_hi.ts") - date(f"_q.{at}")
    near = lambda a, b: F.when(a & b, F.when(lo <= hi, F.col("_lo")).otherwise(F.col("_hi"))).when(a, F.col("_lo")).when(b, F.col("_hi"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    one = near(yes(lo <= before * minute), yes(hi <= after * minute))
    two = near(yes(lo_days == 0), yes(hi_days == 0))
    lo_in, hi_in = yes(lo_days <= days), yes(hi_days <= days)
    three = F.when(hi_in & (~lo_in | (hi_days <= lo_days)), F.col("_hi")).when(lo_in, F.col("_lo"))
    told = found.withColumns({"_1": one, "_2": two, "_3": three})
    stage = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3)
    best = told.select("_q.*", stage.alias("stage"), F.coalesce("_1", "_2", "_3").alias("_m")).select(request, at, "stage", F.col("_m.ts").alias("ts"), F.col("_m.path").alias("path"))
    kinds = {f.name: f.dataType for f in frames.schema}
    untimed = requests.where(F.col(at).isNull()).select(request, at, F.lit(None).cast("int").alias("stage"), F.lit(None).cast(kinds[ts]).alias("ts"), F.lit(None).cast(kinds[path]).alias("path"))
    return best.unionByName(untimed)


def frames_in_range(frames: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    return frames.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy(ts)


def playback_sequence(frames: DataFrame, mode: str = "full", ts: str = "ts", path: str = "path", camera: str = "camera", chunk_rows: int | None = 1_000_000) -> DataFrame:
    """frames with next_path: the next in time of the camera; at the end of the archive, day or hour (mode full, day, hour) the
    first of it again, in mode none null."""
    keys = (camera,)
    if mode in ("day", "hour"):
        frames, keys = frames.withColumn("_unit", F.date_trunc(mode, ts)), (camera, "_unit")
    told = timeline(frames, keys, ts, (path,), chunk_rows).scan(next_path=following(F.col(path)), _first=first(F.col(path))).rows()
    out = told if mode == "none" else told.withColumn("next_path", F.coalesce("next_path", "_first"))
    return out.drop("_first", "_unit")


LABELS = ("weather", "people", "visibility", "time")


def search_photos(photos: DataFrame, limit: int = 50, **equal: str | None) -> DataFrame:
    """Photos with the given labels, by datetime; 1 to 200 of them."""
    for name, value in equal.items():
        if name not in LABELS:
            raise ValueError(f"no such label: {name}")
        if value is not None:
            photos = photos.where(F.col(name) == value)
    return photos.orderBy("datetime", "filename").limit(max(1, min(limit, 200)))


def top_categories(photos: DataFrame, labels: tuple[str, ...] = ("weather", "people", "time"), n: int = 5) -> DataFrame:
    """(label, value, n, total) of the n most frequent values per label; one pass over the photos."""
    long = photos.select(*labels).unpivot([], list(labels), "label", "value").where("value is not null")
    counts = long.groupBy("label", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumns({"rank": F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "value")), "total": F.sum("n").over(W.partitionBy("label"))})
    return ranked.where(F.col("rank") <= n)
