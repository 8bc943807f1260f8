"""Column expressions: latency and throughput, times, payloads, similarity of strings, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latency_of(output: str = "o", first: str = "gen_latency_s") -> Column:
    """The asked latency of an output, else generation, total and plain latency, whichever is there."""
    return F.coalesce(*[F.col(f"{output}.{n}") for n in dict.fromkeys((first, "gen_latency_s", "total_latency_s", "latency_s"))])


def tokens_per_second(gen_len: Column, latency: Column) -> Column:
    """Rounded to 3 places (over 9, so that a tie does not hang on the last bit); null where length or latency is not above zero."""
    return F.when((gen_len > 0) & (latency > 0), F.round(F.round(gen_len / latency, 9), 3))


def falsy_or(value: Column, other: Column) -> Column:
    """value unless it is null or zero, then other."""
    return F.when(value != 0, value).otherwise(other)


def image_timestamp(path: Column) -> Column:
    """Time of an archived image from its name: top_ or bottom_YYYY-MM-DD_HH-MM-SS.jpg, or ISO, with or without an offset, which
    is left out; else null."""
    named = F.regexp_extract(path, "(?:top|bottom)_(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})\\.jpg", 1)
    iso = F.regexp_extract(path, "(?:^|/)(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})(?:[+-]\\d{4})?\\.jpg$", 1)
    return F.coalesce(F.try_to_timestamp(named, F.lit("yyyy-MM-dd_HH-mm-ss")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).cast("timestamp_ntz")


def camera_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "(top|bottom)_\\d{4}-\\d{2}-\\d{2}_", 1), F.lit(""))


def bounds(ts: Column, unit: str) -> Column:
    """Struct (start, end) of the day, hour or month of ts; end is the next one's start."""
    start = F.date_trunc(unit, ts).cast("timestamp_ntz")
    return F.struct(start.alias("start"), (start + F.expr(f"interval 1 {unit}")).alias("end"))


def parse_movement_payload(payload: Column) -> Column:
    """Struct of a record date,time,direction,x_start,x_end,cpu,gpu,ram,ram_total,cpu_temp,gpu_temp. Numbers that are empty or
    don't parse are 0.0; the total RAM is left out."""
    parts = F.split(payload, ",")

    def text(i: int) -> Column:
        return F.trim(F.get(parts, F.lit(i)))

    def number(i: int) -> Column:
        return F.coalesce(text(i).try_cast("double"), F.lit(0.0))

    names = ((3, "x_start"), (4, "x_end"), (5, "CPU_usage"), (6, "GPU_usage"), (7, "mem_usage"), (9, "CPU_temp"), (10, "GPU_temp"))
    return F.struct(*[text(i).alias(n) for i, n in ((0, "Date"), (1, "Time"), (2, "Direction"))], *[number(i).alias(n) for i, n in names])


def string_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer, in characters; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def best_command(text: Column, phrases: list[str]) -> Column:
    """Struct (command, similarity) of the phrase most like the text in lower case; of equals the first in order."""
    each = [F.struct(string_similarity(F.lower(text), F.lit(p.lower())).alias("similarity"), F.lit(p).alias("command")) for p in sorted(phrases)]
    best = F.reduce(F.array(*each), F.struct(F.lit(-1.0).alias("similarity"), F.lit(None).cast("string").alias("command")), lambda a, x: F.when(x["similarity"] > a["similarity"], x).otherwise(a))
    return F.when(text.isNotNull(), best)


def format_timestamp(cs: Column, comma: bool = False) -> Column:
    """HH:MM:SS.mmm of centiseconds."""
    return F.format_string(
        "%02d:%02d:%02d" + ("," if comma else ".") + "%03d", F.floor(cs / 360000), F.floor(cs % 360000 / 6000), F.floor(cs % 6000 / 100), cs % 100 * 10
    )


def format_lrc(cs: Column) -> Column:
    """MM:SS.cc of centiseconds."""
    return F.format_string("%02d:%02d.%02d", F.floor(cs / 6000), F.floor(cs % 6000 / 100), cs % 100)


def confidence_band(p: Column) -> Column:
    return F.when(p < 0.33, "low").when(p < 0.66, "medium").otherwise("high")


def confidence_colour(p: Column, colours: int) -> Column:
    """Index of a colour scale: p cubed times the number of colours, cut to the scale."""
    return F.greatest(F.lit(0), F.least(F.lit(colours - 1), F.floor(F.pow(p, 3) * colours).cast("int")))


def clip_score(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), 2.5 * cosine)


def box_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.floor((x1 + x2) / 2).cast("int").alias("cx"), F.floor((y1 + y2) / 2).cast("int").alias("cy"))


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, pad: float, width: Column, height: Column) -> Column:
    """The box grown by pad of its size on every side and cut to the frame; null if nothing is left."""
    px, py = ((x2 - x1) * pad).cast("int"), ((y2 - y1) * pad).cast("int")
    box = F.struct(
        F.greatest(F.lit(0), x1 - px).alias("x1"), F.greatest(F.lit(0), y1 - py).alias("y1"), F.least(width, x2 + px).alias("x2"), F.least(height, y2 + py).alias("y2")
    )
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def head_box(x1: Column, y1: Column, x2: Column, y2: Column, ratio: float = 0.25) -> Column:
    """The top part of a person's box."""
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), (y1 + ((y2 - y1) * ratio).cast("int")).alias("y2"))


def sample_every(df: DataFrame, n: int, frame: str = "frame_idx") -> DataFrame:
    """Every nth frame."""
    return df.where(F.col(frame) % n == 0)


def nearest_rank(values: Column, percent: float) -> Column:
    """Of a sorted array, the element at the index percent / 100 * (n - 1) rounded half to even."""
    return F.get(values, F.rint(F.lit(percent / 100.0) * (F.size(values) - 1)).cast("int"))
