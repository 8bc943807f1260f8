"""Streaming forms. Every one has a watermark (the change feed without a time column: a time to live by the clock): rows later
than it are dropped, which the batch forms would count, and no state stays for ever."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from nodewell.functions.telemetry import rails
from nodewell.operators import stats, traffic
from nodewell.sources.snapshots import Snapshots


def stream_minute_rollup(events: DataFrame, ts: str = "ts", late: str = "10 minutes", metrics: tuple[str, ...] = traffic.METRICS) -> DataFrame:
    """traffic.minute_rollup over event time, for update mode and an upsert per batch."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"))
    means = [F.coalesce(F.round(F.round(F.avg(F.nullif(c, F.lit(-1.0))), 9), 2), F.lit(-1.0)).alias(c) for c in metrics]
    right = F.col("Direction") == "Right"
    g = w.agg(*means, F.count_if(~right).alias("direction_left"), F.count_if(right).alias("direction_right"))
    start = F.col("window.start")
    return g.select(F.date_format(start, "yyyy-MM-dd").alias("Date"), F.date_format(start, "HH:mm").alias("Time"), *metrics, "direction_left", "direction_right")


def start_minute_upsert(rollup: DataFrame, path: str, checkpoint: str):
    """A running query that merges each batch of minutes into the table of snapshots at path; a batch that is replayed after
    a failure is told by its number and merged once."""
    merge = lambda batch, n: traffic.upsert_minutes(batch.sparkSession, batch, path, (checkpoint, n))
    return rollup.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def start_history_merge(minutes: DataFrame, path: str, checkpoint: str, days: int = 30):
    """A running query that replaces or appends minutes by (Date, Time) and keeps the last `days` days as a report, the table of
    snapshots at path with -recent added."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        traffic.upsert_minutes(spark, batch, path, (checkpoint, n))
        known = traffic.read_minutes(spark, path)
        newest = known.agg(F.max(F.to_date("Date")).alias("d"))
        kept = known.join(F.broadcast(newest), F.to_date("Date") > F.date_sub("d", days)).drop("d")
        Snapshots(spark, f"{path.rstrip('/')}-recent").replace(kept, "Date", (checkpoint, n))

    return minutes.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def _keep_in_rocksdb(spark: SparkSession) -> None:
    """State with several variables and timers needs this store; queries started later in the session use it too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """A processor with one event-time timer a key, whose time is kept beside it as timers can't be asked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms bigint")

    def wake(self, ms: int | None) -> None:
        """Moves the key's timer to ms, or takes it away."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if known != ms:
            if known is not None:
                self.handle.deleteTimer(known)
            if ms is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(ms)
                self.timer.update((ms,))

    def close(self) -> None:
        pass


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


_TRACK = [("source", pa.string()), ("track_id", pa.int64())]
_POINT = pa.schema([*_TRACK, ("ms", pa.int64()), ("frame", pa.int64()), ("x", pa.int64())])
_SESSION = pa.schema([*_TRACK, ("n", pa.int64()), ("last_ms", pa.int64())])


def _codes(tables: list[pa.Table]) -> tuple[list[np.ndarray], pa.Table]:
    """The number of each row's track, and the tracks by number."""
    both = pa.concat_tables([t.select(["source", "track_id"]) for t in tables]).combine_chunks()
    source, track = (c.combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in both.columns)
    pair = source.astype(np.int64) * (1 + int(track.max(initial=0))) + track
    _, at, code = np.unique(pair, return_index=True, return_inverse=True)
    return np.split(code, np.cumsum([len(t) for t in tables])[:-1]), both.take(at)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first to its last."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class _Tracks(_Timed):
    """The state of a bucket of tracks, each part a packed table: points that the watermark has not passed, in order of arrival; the
    last `history` points of the tracks' open sessions, in order of frames; and a track's number of sessions and last time. Points
    are dealt with in order of frames once the watermark has passed them, so neither their order of arrival nor the cut into batches
    matters. The timer is the first time at which there is anything to do, and until then points are only put by."""

    def __init__(self, threshold: float, patience: int, history: int, least: int, frame_ms: int, forget_ms: int) -> None:
        self.threshold, self.patience, self.history, self.least, self.frame_ms, self.forget_ms = threshold, patience, history, least, frame_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "points binary")
        self.open = handle.getValueState("open", "points binary")
        self.session = handle.getValueState("session", "tracks binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wake = self.timer.get()[0] if self.timer.exists() else None
        for b in rows:
            ms = b["ts"].astype("int64") // 10 ** (6 if str(b["ts"].dtype).startswith("datetime64[ns") else 3)
            track = pa.array(b["track_id"].to_numpy(), mask=b["unnamed"].to_numpy())
            others = [pa.array(c, t, from_pandas=True) for c, t in ((b["source"], pa.string()), (ms, pa.int64()), (b["frame_idx"], pa.int64()), (b["cx"], pa.int64()))]
            self.waiting.appendValue((_packed(pa.table([others[0], track, *others[1:]], schema=_POINT)),))
            wake = int(ms.min()) if wake is None else min(wake, int(ms.min()))
        now = timerValues.getCurrentWatermarkInMs()
        if wake <= now:
            yield self._settle(now)
        else:
            self.wake(wake)
            yield self._told([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        yield self._settle(timerValues.getCurrentWatermarkInMs())

    def _settle(self, now: int) -> pd.DataFrame:
        waiting = pa.concat_tables([_POINT.empty_table(), *[_unpacked(r[0]) for r in (self.waiting.get() if self.waiting.exists() else [])]])
        known = _unpacked(self.open.get()[0]) if self.open.exists() else _POINT.empty_table()
        sessions = _unpacked(self.session.get()[0]) if self.session.exists() else _SESSION.empty_table()
        # A point waits as long as one of a lesser frame may still come.
        passed = waiting["ms"].to_numpy() <= now
        ready, left = waiting.filter(pa.array(passed)), waiting.filter(pa.array(~passed))
        (of_known, of_ready, of_left, of_sessions), tracks = _codes([known, ready, left, sessions])
        n, last_ms = np.zeros(len(tracks), np.int64), np.zeros(len(tracks), np.int64)
        n[of_sessions], last_ms[of_sessions] = sessions["n"].to_numpy(), sessions["last_ms"].to_numpy()
        np.maximum.at(last_ms, of_ready, ready["ms"].to_numpy())
        ends = last_ms + (self.patience + 1) * self.frame_ms

        points = pa.concat_tables([known, ready])
        track, old = np.concatenate([of_known, of_ready]), np.arange(len(points)) < len(known)
        order = np.lexsort((np.where(old, 0, points["ms"].to_numpy()), np.where(old, 0, points["frame"].to_numpy()), ~old, track))
        points, track = points.take(order), track[order]
        frame = points["frame"].to_numpy()
        other = np.diff(track, prepend=-1) != 0
        cut = other | (np.diff(frame, prepend=frame[:1]) - 1 > self.patience)
        first = np.flatnonzero(cut)
        last = np.append(first, len(track))[1:] - 1
        of, opens = track[first], other[first]
        number = n[of] + np.arange(len(of)) - np.maximum.accumulate(np.where(opens, np.arange(len(of)), 0))
        closed = ~np.append(opens[1:], True) if len(of) else opens
        closed = closed | (now > ends[of])
        np.add.at(n, of[closed], 1)
        first = np.maximum(first, last - self.history + 1)
        told = closed & (last - first + 1 >= self.least)
        done = self._told([tracks.take(of[told]), number[told], points.take(first[told]), points.take(last[told]), (last - first + 1)[told]])

        known = points.take(_ranges(first[~closed], last[~closed]))
        least_ms = np.full(len(tracks), np.iinfo(np.int64).max)
        least_ms[of[~closed]] = ends[of[~closed]] + 1
        np.minimum.at(least_ms, of_left, left["ms"].to_numpy())
        idle = least_ms == np.iinfo(np.int64).max
        least_ms[idle] = last_ms[idle] + self.forget_ms + 1
        kept = ~idle | (now <= last_ms + self.forget_ms)
        sessions = tracks.append_column("n", pa.array(n)).append_column("last_ms", pa.array(last_ms)).filter(pa.array(kept))
        if len(left):
            self.waiting.put([(_packed(left),)])
        elif self.waiting.exists():
            self.waiting.clear()
        for state, rows in ((self.open, known), (self.session, sessions)):
            if len(rows):
                state.update((_packed(rows),))
            elif state.exists():
                state.clear()
        self.wake(int(least_ms[kept].min()) if kept.any() else None)
        return done

    def _told(self, ended: list) -> pd.DataFrame:
        """The verdicts on sessions that have ended: their tracks, numbers, first and last points, and sizes."""
        names = ["source", "track_id", "session", "points", "x_start", "x_end", "last_frame", "dx", "direction"]
        if not ended or not len(ended[0]):
            return pd.DataFrame([], columns=names)
        tracks, number, first, last, size = ended
        dx = pc.subtract(last["x"], first["x"])
        side = pc.if_else(pc.greater(dx, self.threshold), "Right", pc.if_else(pc.less(dx, -self.threshold), "Left", None))
        columns = [tracks["source"], tracks["track_id"], pa.array(number, pa.int32()), pa.array(size, pa.int32()), first["x"], last["x"], last["frame"], dx, side]
        return pa.table(columns, names=names).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def stream_track_direction(
    points: DataFrame, threshold: float = 100, patience: int = 120, history: int = 120, least: int = 15, frame_ms: int = 33, late: str = "10 seconds", forget_s: int = 86_400, buckets: int = 256
) -> DataFrame:
    """traffic.track_direction over a stream of points (source, track_id, frame_idx, ts, cx). A session is told when a later point
    leaves a gap of more than `patience` frames, or when the watermark has passed that many frame periods. Points may come in any
    order within `late`. A track that stays away for forget_s seconds is forgotten, and its sessions are counted from 0 again.
    Tracks are dealt to buckets by their hash and a bucket's are dealt with together; a checkpoint holds for one number of buckets."""
    _keep_in_rocksdb(points.sparkSession)
    schema = "source string, track_id bigint, session int, points int, x_start bigint, x_end bigint, last_frame bigint, dx bigint, direction string"
    # A null among numbers would make a batch's numbers floats.
    track = F.coalesce(F.col("track_id").cast("bigint"), F.lit(0).cast("bigint"))
    bucket = F.pmod(F.xxhash64("source", "track_id"), F.lit(buckets)).cast("int")
    own = points.select("source", track.alias("track_id"), F.col("track_id").isNull().alias("unnamed"), "frame_idx", "ts", "cx", bucket.alias("bucket")).withWatermark("ts", late)
    job = _Tracks(threshold, patience, history, least, frame_ms, 1000 * forget_s)
    return own.groupBy("bucket").transformWithStateInPandas(job, schema, "append", "eventTime")


class _Changes(_Timed):
    """The values last sent of a key; ttl_ms after its last row, by the watermark, they are forgotten."""

    def __init__(self, key: str, columns: list[str], by: list[str], kinds: str, ts: str | None, ttl_ms: int) -> None:
        self.key, self.columns, self.by, self.kinds, self.ts, self.ttl_ms = key, columns, by, kinds, ts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ts:
            super().init(handle)
        self.sent = handle.getValueState("sent", self.kinds, None if self.ts else self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows))
        last = whole.sort_values(self.by, na_position="first").iloc[-1]
        own = tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in (last[c] for c in self.columns))
        changed = not self.sent.exists() or tuple(self.sent.get()) != own
        if changed or not self.ts:  # a value that is written again lives on
            self.sent.update(own)
        if self.ts:
            newest = int(whole[self.ts].max().timestamp() * 1000)
            self.wake(max(newest + self.ttl_ms, self.timer.get()[0] if self.timer.exists() else 0, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([(key[0], *own)] if changed else [], columns=[self.key, *self.columns])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        self.sent.clear()
        yield pd.DataFrame([], columns=[self.key, *self.columns])


def stream_change_feed(rows: DataFrame, key: str, columns: list[str], order: list[str] | None = None, ts: str | None = None, late: str = "10 minutes", ttl_s: int = 86_400) -> DataFrame:
    """The last row per key and batch, by the columns `order` (else by `columns` themselves, so that it is always the same one),
    where it differs in `columns` from the last one sent. A key without rows for ttl_s seconds is forgotten, so its next row is
    sent in any case: seconds of event time by the watermark with a time column ts, else of the clock; by the clock a query has
    no last batch, so the trigger availableNow does not end it."""
    _keep_in_rocksdb(rows.sparkSession)
    by = order or columns
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [key, *columns]}
    own = rows.select(key, *dict.fromkeys([*columns, *by, *([ts] if ts else [])]))
    own = own.withWatermark(ts, late) if ts else own
    job = _Changes(key, columns, by, ", ".join(f"`{c}` {kinds[c]}" for c in columns), ts, 1000 * ttl_s)
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return own.groupBy(key).transformWithStateInPandas(job, schema, "append", "eventTime" if ts else "processingTime")


def sliding_chunks(samples: DataFrame, length: str, step: str, ts: str = "ts", keys: tuple[str, ...] = ("audio_id",), late: str | None = None) -> DataFrame:
    """Chunks of `length` every `step`, overlapping by the difference: keys, start, end, n. The same for batch and stream; a
    stream gives late, its watermark."""
    rows = samples.withWatermark(ts, late) if late else samples
    g = rows.groupBy(*keys, F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def viewer_sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", idle: str = "30 minutes", late: str | None = None) -> DataFrame:
    """A user's sessions, each ended by `idle` without an event: user, start, end (of the idle time), events."""
    rows = events.withWatermark(ts, late) if late else events
    g = rows.groupBy(user, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("events"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def stream_power(lines: DataFrame, run: str = "run", ts: str = "ts", width: str = "1 minute", late: str = "1 minute", edition: str = "board") -> DataFrame:
    """Headline watts and their peak (see stats.headline_watts), samples and energy (watts times width) per run and window,
    from telemetry lines (run, ts, value)."""
    watts, peak = stats.headline_watts("_rails", edition)
    known = lines.withWatermark(ts, late).withColumn("_rails", rails(F.col("value")))
    g = known.groupBy(run, F.window(ts, width).alias("w")).agg(watts.alias("watts_avg"), peak.alias("watts_peak"), F.count("*").alias("samples"))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return g.select(run, F.col("w.start").alias("start"), "watts_avg", "watts_peak", "samples", (F.col("watts_avg") * seconds).alias("energy_joules"))
