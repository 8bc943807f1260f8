"""Speech: error rates, confidence, segments, intervals and transcript files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nodewell.functions.scalars import format_lrc, format_timestamp
from nodewell.functions.speechtext import word_edit_distance
from nodewell.operators.ordered import coming, latest, running_total, timeline

RATE = 16_000


def utterance_errors(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """pairs with edits, words (of the reference) and accuracy = max(0, 100 (1 - wer)), 0 without reference words.
    Rows are dealt evenly first, as long texts take most of the time."""
    words = F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), "\\s+"), lambda w: w != ""))
    out = pairs.withColumns({"edits": word_edit_distance(reference, hypothesis), "words": words.cast("bigint")})
    return out.withColumn("accuracy", F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 100 * (1 - F.col("edits") / F.nullif("words", F.lit(0))))))


def word_error_rate(errors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edits over reference words of the whole corpus or of each group."""
    return errors.groupBy(*keys).agg(F.sum("edits").alias("edits"), F.sum("words").alias("words"), F.try_divide(F.sum("edits"), F.sum("words")).alias("wer"))


def speech_model_summary(rows: DataFrame, columns: tuple[str, ...] = ("accuracy", "engine_ms", "wall_ms", "gpu_percent", "cpu_percent")) -> DataFrame:
    return rows.groupBy("model").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("wall_ms", "model")


def sequence_quality(tokens: DataFrame, no_speech: str | None = None, keys: tuple[str, ...] = ("audio_id", "seg_no"), length_penalty: float = -1.0, entropy_below: float = 2.4, logprob_below: float = -1.0, no_speech_above: float = 0.6) -> DataFrame:
    """Per sequence of tokens (tok_no, id, plog): length, sum and mean log probability, score (the sum over the length, or over
    ((5 + length) / 6) ** length_penalty if that is above zero), entropy of the last 32 tokens, failed (longer than 32 and
    entropy below the limit) and, with a column of no-speech probabilities, no_speech and fallback: failed, or improbable
    where there is speech. tok_no orders the tokens of a sequence, each with one of its own."""
    extra = [F.max(no_speech).alias("_ns")] if no_speech else []
    sums = tokens.groupBy(*keys).agg(F.count("*").alias("n_tokens"), F.sum("plog").alias("sum_logprobs"), F.avg("plog").alias("avg_logprobs"), *extra)
    last = tokens.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("tok_no")))).where("_r <= 32")
    counts = last.groupBy(*keys, "id").agg(F.count("*").alias("c"))
    total = F.sum("c")
    # -sum(p ln p) with p = c / total, written without a second pass.
    entropy = counts.groupBy(*keys).agg((F.ln(total) - F.sum(F.col("c") * F.ln("c")) / total).alias("entropy"))
    weight = F.pow((5 + F.col("n_tokens")) / 6, F.lit(length_penalty)) if length_penalty > 0 else F.col("n_tokens")
    out = sums.join(entropy, list(keys)).withColumn("score", F.col("sum_logprobs") / weight)
    out = out.withColumn("failed", (F.col("n_tokens") > 32) & (F.col("entropy") < entropy_below))
    if not no_speech:
        return out
    poor = F.round("avg_logprobs", 9) < logprob_below  # a mean at the limit is not below it, however its sum was added up
    flags = {"no_speech": (F.col("_ns") > no_speech_above) & poor, "fallback": F.col("failed") | poor & (F.col("_ns") < no_speech_above)}
    return out.withColumns(flags).drop("_ns")


_BLOCK = 128  # samples of one triangular product


def filtered(x: np.ndarray, alpha: float, lead: float) -> np.ndarray:
    """y[k] = alpha * (y[k - 1] + x[k] - x[k - 1]), where lead is y - x before the first sample and x[-1] counts as 0.

    In blocks: inside one the recursion is a product with powers of alpha below the diagonal; from block to block the map
    from the value before to the last one is affine, so only these values go through a loop."""
    if not len(x):
        return x
    steps = np.zeros(-(-len(x) // _BLOCK) * _BLOCK)
    steps[: len(x)] = np.diff(x, prepend=0.0)
    k = np.arange(_BLOCK)
    powers = alpha ** (k + 1.0)
    inside = steps.reshape(-1, _BLOCK) @ np.tril(alpha ** (np.abs(k[:, None] - k) + 1.0)).T
    before, carry = [], lead
    for last in inside[:, -1].tolist():
        before.append(carry)
        carry = last + float(powers[-1]) * carry
    return (inside + np.array(before)[:, None] * powers).ravel()[: len(x)]


def _filter_pass(alpha: float, summary: bool):
    """Filters sorted samples of (audio_id, _chunk) batch by batch; column _lead tells a chunk's y - x before it, null in an audio's
    first. summary: one row per chunk instead, with its size, first sample and y - x after it from a lead of 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lead, n, first_x = None, 0.0, 0, 0.0

        def told() -> pd.DataFrame:
            return pd.DataFrame([] if now is None else [(*now, n, first_x, lead)], columns=["audio_id", "_chunk", "_n", "_x", "_end"])

        for b in batches:
            x, out = b["value"].to_numpy(float), np.empty(len(b))
            audio, chunk = b["audio_id"].to_numpy(), b["_chunk"].to_numpy()
            edges = [0, *(np.flatnonzero((audio[1:] != audio[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(b)]
            for at, end in zip(edges, edges[1:], strict=False):
                if at == end:
                    continue
                own = x[at:end]
                if (audio[at], chunk[at]) != now:
                    if summary:
                        yield told()
                    now, n, first_x = (audio[at], chunk[at]), 0, float(own[0])
                    given = 0.0 if summary else b["_lead"].iloc[at]
                    lead = first_x * (1 - alpha) / alpha if pd.isna(given) else float(given)
                out[at:end] = y = filtered(own, alpha, lead)
                lead, n = float(y[-1] - own[-1]), n + len(own)
            if not summary:
                yield b.assign(value=out).drop(columns=["_chunk", "_lead"])
        if summary:
            yield told()

    return run


def high_pass(samples: DataFrame, cutoff: float, rate: int = RATE, textbook: bool = False, chunk_rows: int | None = 1_000_000) -> DataFrame:
    """samples (audio_id, i, value) through a first-order high-pass filter; an audio starts at its first value. Its factor is
    dt / (rc + dt), as the gate was tuned with, or rc / (rc + dt), which a high-pass filter of that cutoff has by the textbook.

    A long audio is cut into chunks. A chunk maps what comes before it to what it leaves behind by a * s + b; one pass finds b,
    the maps are composed in a table of one row per chunk, and a second pass filters each chunk by itself."""
    rc, dt = 1.0 / (2 * math.pi * cutoff), 1.0 / rate
    alpha = (rc if textbook else dt) / (rc + dt)
    line = timeline(samples, ("audio_id",), "i", (), chunk_rows)
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    cut = line.df
    ready = lambda df: df.repartition("audio_id", "_chunk").sortWithinPartitions("audio_id", "_chunk", "i")
    leads = F.lit(None).cast("double")
    if line.cut:
        told = ready(cut).select("audio_id", "_chunk", "value").mapInPandas(_filter_pass(alpha, True), f"audio_id {kinds['audio_id']}, _chunk int, _n bigint, _x double, _end double")
        maps = told.groupBy("audio_id").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_n", "_x", "_end"))).alias("m"))
        start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<struct<_chunk: int, _lead: double>>").alias("out"))

        def compose(state, m):
            lead = F.coalesce(state["s"], m["_x"] * (1 - alpha) / alpha)
            return F.struct((F.pow(F.lit(alpha), m["_n"]) * lead + m["_end"]).alias("s"), F.concat(state["out"], F.array(F.struct(m["_chunk"].alias("_chunk"), state["s"].alias("_lead")))).alias("out"))

        leads_of = maps.select("audio_id", F.inline(F.aggregate("m", start, compose)["out"]))
        same = [cut[c].eqNullSafe(leads_of[c]) for c in ("audio_id", "_chunk")]
        cut = cut.join(leads_of, same).select(*[cut[c] for c in cut.columns], "_lead")
    else:
        cut = cut.withColumn("_lead", leads)
    return ready(cut).mapInPandas(_filter_pass(alpha, False), ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def speech_energy_gate(samples: DataFrame, last_ms: int = 1000, threshold: float = 0.6, rate: int = RATE, cutoff: float = 0.0) -> DataFrame:
    """Per audio: mean |value| of the whole and of the last last_ms, and silent_tail: whether the tail's is threshold times the
    whole's at most. Audios no longer than the tail are not silent. cutoff: of a high-pass filter before."""
    n_last = rate * last_ms // 1000
    if cutoff > 0:
        samples = high_pass(samples, cutoff, rate)
    sizes = samples.groupBy("audio_id").agg(F.max("i").alias("_n"))
    tail = F.when(F.col("i") > F.col("_n") - n_last, F.abs("value"))
    g = samples.join(sizes, "audio_id").groupBy("audio_id").agg(F.count("*").alias("n"), F.avg(F.abs("value")).alias("energy_all"), F.avg(tail).alias("energy_last"))
    return g.withColumn("silent_tail", (F.col("n") > n_last) & (F.col("energy_last") <= threshold * F.col("energy_all")))


def segment_energy(segments: DataFrame, samples: DataFrame, rate: int = RATE, chunk_rows: int | None = 1_000_000) -> DataFrame:
    """segments (audio_id, seg_no, t0, t1 in centiseconds) with the energy of two channels (samples: audio_id, i, left, right)
    and the speaker, 0 or 1 if its channel has over 1.1 times the other's energy, else ?. Samples are summed per
    centisecond first, and each centisecond's running sum is looked up at both ends, so no segment is multiplied."""
    cs = F.floor(F.col("i") * 100 / rate)
    frames = samples.groupBy("audio_id", cs.alias("cs")).agg(F.sum(F.abs("left")).alias("l"), F.sum(F.abs("right")).alias("r"))
    # Ends come before the frame at the same centisecond: a bound takes in what is earlier.
    marks = segments.select("audio_id", "seg_no", F.explode(F.array(*[F.struct(F.col(t).cast("bigint").alias("cs"), F.lit(s).alias("s")) for t, s in (("t0", -1), ("t1", 1))])).alias("m"))
    both = frames.select("audio_id", "cs", F.lit(1).alias("_kind"), "l", "r", F.lit(None).cast("int").alias("seg_no"), F.lit(0).alias("s")).unionByName(
        marks.select("audio_id", F.col("m.cs").alias("cs"), F.lit(0).alias("_kind"), F.lit(0.0).alias("l"), F.lit(0.0).alias("r"), F.col("seg_no").cast("int").alias("seg_no"), "m.s")
    )
    run = timeline(both, ("audio_id",), "cs", ("_kind",), chunk_rows).scan(l=running_total(F.col("l")), r=running_total(F.col("r"))).rows().where("_kind = 0")
    e = run.groupBy("audio_id", "seg_no").agg(F.sum(F.col("s") * F.col("l")).alias("energy0"), F.sum(F.col("s") * F.col("r")).alias("energy1"))
    speaker = F.when(F.col("energy0") > 1.1 * F.col("energy1"), "0").when(F.col("energy1") > 1.1 * F.col("energy0"), "1").otherwise("?")
    return segments.join(e, ["audio_id", "seg_no"], "left").withColumn("speaker", speaker)


def map_time(times: DataFrame, mapping: DataFrame, time: str = "t", chunk_rows: int | None = 1_000_000, whole: bool = True) -> DataFrame:
    """times (audio_id, t) with original_time: of the mapping point (processed_time, original_time) at t, before the first and after the
    last that point's, between two points interpolated in whole numbers, without points t itself. Of points at one processed time
    the latest original time counts. Points and times pass in one order, which carries the last point on and the next one back.
    Null times stay null, null audios have no points, and points at a null time count for nothing. whole=False divides as doubles
    before it cuts, so a product beyond 2^53 may give one less or more."""
    mapping = mapping.where("processed_time is not null").groupBy("audio_id", "processed_time").agg(F.max("original_time").alias("original_time"))
    points = mapping.select("audio_id", F.col("processed_time").alias("_t"), F.struct("processed_time", "original_time").alias("p"))
    rows = times.withColumn("_row", F.struct(*times.columns)).select("audio_id", F.col(time).alias("_t"), "_row")
    both = points.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows.withColumn("p", F.lit(None).cast(points.schema["p"].dataType)))
    # At one time a point comes before the times, in either direction.
    both = both.withColumn("_kind", F.col("_row").isNotNull())
    found = timeline(both, ("audio_id",), "_t", ("_kind",), chunk_rows).scan(_lo=latest(F.col("p")), _hi=coming(F.col("p"))).rows().where("_kind")
    span, offset = F.col("_hi.processed_time") - F.col("_lo.processed_time"), F.col("_t") - F.col("_lo.processed_time")
    product, divisor = "(_t - _lo.processed_time) * (_hi.original_time - _lo.original_time)", "nullif(_hi.processed_time - _lo.processed_time, 0)"
    between = F.col("_lo.original_time") + F.expr(f"({product}) div {divisor}" if whole else f"cast(cast({product} as double) / {divisor} as bigint)")
    value = (
        F.when(F.col("audio_id").isNull() | F.col("_t").isNull() | F.col("_lo").isNull() & F.col("_hi").isNull(), F.col("_t"))
        .when(F.col("_lo").isNull(), F.col("_hi.original_time"))
        .when(F.col("_hi").isNull() | (span == 0) | (offset == 0), F.col("_lo.original_time"))
        .otherwise(between)
    )
    return found.select("_row.*", value.alias("original_time"))


def merge_chunks(segments: DataFrame, chunk_samples: int, offset_ms: int = 0, rate: int = RATE) -> DataFrame:
    """Segments (audio_id, chunk, seg_no, t0, t1) of chunks recognised apart, on one time line, none before the end of the one before."""
    shift = F.when(F.col("chunk") > 0, F.expr(f"(100 * chunk * {chunk_samples}L) div {rate}") + offset_ms // 10).otherwise(F.lit(0))
    moved = segments.withColumns({"t0": F.col("t0") + shift, "t1": F.col("t1") + shift})
    w = W.partitionBy("audio_id").orderBy("chunk", "seg_no")
    return moved.withColumn("t0", F.when(F.col("chunk") > 0, F.greatest("t0", F.lag("t1").over(w))).otherwise(F.col("t0")))


def wrap_segments(segments: DataFrame, max_chars: int, on_word: bool = True) -> DataFrame:
    """segments (with tokens: array of text, t0, t1) cut where a token would pass max_chars, on_word only before a token that
    starts with a space: rows with part, t0, t1 and text. A piece ends where the next begins. One fold over each segment's tokens."""
    empty = F.array().cast("array<struct<t0: bigint, text: string, n: int>>")

    def step(a: Column, t: Column) -> Column:
        n = F.length(t["text"])
        last = F.try_element_at(a, F.lit(-1))
        full = (last["n"] + n > max_chars) & (t["text"].startswith(" ") if on_word else F.lit(True))
        fresh = F.struct(t["t0"].cast("bigint").alias("t0"), t["text"].alias("text"), n.alias("n"))
        more = F.struct(last["t0"].alias("t0"), F.concat(last["text"], t["text"]).alias("text"), (last["n"] + n).alias("n"))
        return F.when(F.size(a) == 0, F.array(fresh)).when(full, F.concat(a, F.array(fresh))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(more)))

    pieces = segments.withColumn("_p", F.aggregate("tokens", empty, step))
    rows = pieces.select(*[c for c in segments.columns if c not in ("tokens", "text", "t0", "t1")], F.col("t0").alias("_t0"), F.col("t1").alias("_t1"), "_p", F.posexplode("_p").alias("part", "x"))
    following = F.get(F.col("_p"), F.col("part") + 1)["t0"]
    keep = [c for c in segments.columns if c not in ("tokens", "text", "t0", "t1")]
    return rows.select(*keep, "part", F.when(F.col("part") == 0, F.col("_t0")).otherwise(F.col("x.t0")).alias("t0"), F.coalesce(following, F.col("_t1")).alias("t1"), F.col("x.text").alias("text"))


OFF, HOLD, ON = range(3)


def probability_runs(probs: DataFrame, threshold: float) -> DataFrame:
    """(audio_id, first, last, kind) of the runs of neighbouring windows that are ON (at the threshold or above), OFF (below a
    lower one) or on HOLD between both. probs: audio_id, i (from 0, without gaps), prob."""
    kind = F.when(F.col("prob") >= threshold, ON).when(F.col("prob") < max(threshold - 0.15, 0.01), OFF).otherwise(HOLD)
    w = W.partitionBy("audio_id").orderBy("i")
    turns = probs.select("audio_id", "i", kind.alias("kind")).withColumn("_t", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(1)))
    runs = turns.withColumn("_g", F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("audio_id", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.first("kind").alias("kind")).drop("_g")


class Stretches:
    """Speech in runs of windows, told in samples. It starts with a run that is on and ends where the first pause of min_silence
    starts; stretches of min_speech or less don't count. A pause is counted from its first window that is off to another one,
    with no window on between. Before speech is longer than max_speech, it is cut at its last pause of more than 98 ms,
    and goes on where that ended; without such a pause it is cut on the spot, and may start with the next window."""

    def __init__(self, window: int, min_speech: int, min_silence: int, max_speech: float, rate: int = RATE):
        self.window, self.min_speech, self.max_speech = window, min_speech, max_speech
        self.silence = -(-min_silence // window) * window
        self.notable = rate * 98 // 1000
        self.begin()

    def begin(self) -> None:
        self.start = None
        self.rest()

    def rest(self) -> None:
        self.pause = self.cut = self.resumed = None

    def due(self) -> float:
        """The first window at which speech from start on is too long."""
        return self.start + self.max_speech // self.window * self.window + self.window

    def run(self, kind: int, first: int, last: int) -> Iterator[tuple[int, int]]:
        """The stretches that end in a run from window first to last."""
        a, z = first * self.window, last * self.window
        if kind == ON:
            self.pause = None
            self.start = a if self.start is None else self.start
            self.resumed = a if self.resumed is None else self.resumed
        while self.start is not None:
            if kind == OFF and self.pause is None:
                self.pause = a
            over = max(a, self.pause + self.silence) if kind == OFF else z + 1
            if (due := self.due()) <= min(z, over):
                yield self.split(kind, a, z, int(due))
                if kind == OFF and self.start is not None:
                    self.pause = int(due)
                continue
            if kind == OFF:
                self.note(z)
                if over <= z:
                    if self.pause - self.start > self.min_speech:
                        yield self.start, self.pause
                    self.begin()
            return

    def note(self, at: int) -> None:
        """The pause has come to a window that is off."""
        if at - self.pause > self.notable:
            self.cut, self.resumed = self.pause, None

    def split(self, kind: int, a: int, z: int, due: int) -> tuple[int, int]:
        if kind == OFF and due > a:
            self.note(due - self.window)
        if self.cut is None:
            piece = self.start, due
            self.start = due + self.window if kind == ON and due < z else None
        else:
            piece = self.start, self.cut
            self.start = self.resumed
        self.rest()
        return piece

    def end(self, total: int) -> Iterator[tuple[int, int]]:
        if self.start is not None and total - self.start > self.min_speech:
            yield self.start, total
        self.begin()


def speech_segments(probs: DataFrame, window: int = 512, threshold: float = 0.5, min_speech_ms: int = 250, min_silence_ms: int = 100, max_speech_s: float = float("inf"), pad_ms: int = 30, rate: int = RATE) -> DataFrame:
    """(audio_id, seg_no, t0, t1 in centiseconds) of speech in probability series (audio_id, i, prob).

    Windows are joined into runs first, then one task folds an audio's runs in order, one at a time; see Stretches. Joining over
    gaps below 200 ms, dropping what is shorter than min_speech_ms and padding by pad_ms, or half the gap, are windows.
    """
    min_speech, pad = rate * min_speech_ms // 1000, rate * pad_ms // 1000
    limit = float("inf") if max_speech_s > 100_000 else rate * int(max_speech_s) - window - 2 * pad
    limit = float("inf") if limit < 0 else limit

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, audio, total = Stretches(window, min_speech, rate * min_silence_ms // 1000, limit, rate), None, 0
        for b in batches:
            rows = []
            for a, first, last, kind in zip(b["audio_id"], b["first"].tolist(), b["last"].tolist(), b["kind"].tolist(), strict=True):
                if a != audio:
                    rows += [(audio, s, e, total) for s, e in state.end(total)]
                audio, total = a, (last + 1) * window
                rows += [(a, s, e, total) for s, e in state.run(kind, first, last)]
            yield pd.DataFrame(rows, columns=["audio_id", "s", "e", "total"])
        yield pd.DataFrame([(audio, s, e, total) for s, e in state.end(total)], columns=["audio_id", "s", "e", "total"])

    kind = probs.schema["audio_id"].dataType.simpleString()
    runs = probability_runs(probs, threshold).repartition("audio_id").sortWithinPartitions("audio_id", "first")
    raw = runs.mapInPandas(fold, f"audio_id {kind}, s bigint, e bigint, total bigint").drop("total")
    ends = probs.groupBy("audio_id").agg(((F.max("i") + 1) * window).alias("total"))
    w = W.partitionBy("audio_id").orderBy("s")
    apart = F.coalesce((F.col("s") - F.lag("e").over(w) >= rate * 200 // 1000).cast("int"), F.lit(1))
    merged = raw.withColumn("_a", apart).withColumn("_g", F.sum("_a").over(w)).groupBy("audio_id", "_g").agg(F.min("s").alias("s"), F.max_by("e", "s").alias("e")).join(ends, "audio_id")
    kept = merged.where(F.col("e") - F.col("s") >= min_speech)
    before, after = F.col("s") - F.lag("e").over(w), F.lead("s").over(w) - F.col("e")
    start = F.greatest(F.lit(0), F.col("s") - F.when(before < 2 * pad, F.floor(before / 2)).otherwise(pad))
    end = F.when(after < 2 * pad, F.col("e") + F.floor(after / 2)).otherwise(F.least(F.col("e") + pad, "total"))
    cs = lambda c: F.floor(c * 100 / rate + 0.5).cast("bigint")
    return kept.select("audio_id", (F.row_number().over(w) - 1).alias("seg_no"), cs(start).alias("t0"), cs(end).alias("t1"))


def cues(segments: DataFrame, kind: str, tool: str = "nodewell") -> DataFrame:
    """Text rows (audio_id, no, value) of segments (audio_id, seg_no, t0, t1, text) as txt, vtt, srt, csv or lrc, header first."""
    n = F.row_number().over(W.partitionBy("audio_id").orderBy("seg_no"))
    rows = segments.withColumn("no", n)
    t0, t1, comma = F.col("t0"), F.col("t1"), kind == "srt"
    span = F.concat(format_timestamp(t0, comma), F.lit(" --> "), format_timestamp(t1, comma))
    value = {
        "txt": F.col("text"),
        "vtt": F.concat(span, F.lit("\n"), "text", F.lit("\n")),
        "srt": F.concat(F.col("no").cast("string"), F.lit("\n"), span, F.lit("\n"), "text", F.lit("\n")),
        "csv": F.concat((t0 * 10).cast("string"), F.lit(","), (t1 * 10).cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')),
        "lrc": F.concat(F.lit("["), format_lrc(t0), F.lit("]"), "text"),
    }[kind]
    out = rows.select("audio_id", "no", value.alias("value"))
    header = {"vtt": "WEBVTT\n", "csv": "start,end,text", "lrc": f"[by:{tool}]"}.get(kind)
    if header is None:
        return out
    return out.unionByName(segments.select("audio_id").distinct().select("audio_id", F.lit(0).alias("no"), F.lit(header).alias("value")))


def token_scores(tokens: DataFrame) -> DataFrame:
    """Rows `token TAB probability` in order."""
    n = F.row_number().over(W.partitionBy("audio_id").orderBy("seg_no", "tok_no"))
    return tokens.select("audio_id", n.alias("no"), F.concat_ws("\t", "text", F.col("p").cast("string")).alias("value"))


def last_events(events: DataFrame, keep: int = 100, key: str = "source", ts: str = "ts", ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest events of each key; ties: columns whose greater values are later at one time."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in ties]))).where(F.col("_r") <= keep).drop("_r")
