"""Parsing of telemetry and timing text into columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the device tools' output (fixed formats).
RAIL = r"\b([A-Za-z][A-Za-z0-9_]*)\s+(\d+)mW/\d+mW"
RAM = r"\bRAM\s+(\d+)/(\d+)MB"
EMC = r"EMC_FREQ\s+(\d+)%"
JUNCTION = r"tj@(-?[\d.]+)C"
CORES = r"CPU\s+\[([^\]]*)\]"
CORE = r"(\d+)%@(\d+)"
GPU_LOAD = r"GR3D_FREQ\s+(\d+)%"
GPU_MHZ = r"GR3D_FREQ\s+(?:\d+%)?\s*@\s*\[?\s*([\d,\s]*\d)"
TEMPERATURE = r"(?i)\b{}@(-?[\d.]+)C"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _mean(values: Column) -> Column:
    numbers = F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def rails(line: Column) -> Column:
    """Map from power rail to watts; of a rail named twice in a line the first counts."""
    names, watts = (F.regexp_extract_all(line, F.lit(RAIL), F.lit(g)) for g in (1, 2))
    first = F.array_distinct(names)
    return F.map_from_arrays(first, F.transform(first, lambda n: F.get(watts, F.array_position(names, n).cast("int") - 1).cast("double") / 1000))


def parse_telemetry(line: Column) -> Column:
    """Struct of one telemetry line: rails (watts), ram_used_mb, ram_total_mb, emc_percent, junction_c, mean core load and MHz,
    gpu_percent, gpu_mhz and gpu_mhz_peak (mean and highest of the clusters). What a line doesn't have is null."""
    cores = F.regexp_extract(line, CORES, 1)
    clusters = F.transform(F.split(F.regexp_extract(line, GPU_MHZ, 1), ","), lambda x: F.trim(x))
    return F.struct(
        rails(line).alias("rails"),
        _number(line, RAM, 1).alias("ram_used_mb"),
        _number(line, RAM, 2).alias("ram_total_mb"),
        _number(line, EMC).alias("emc_percent"),
        _number(line, JUNCTION).alias("junction_c"),
        _mean(F.regexp_extract_all(cores, F.lit(CORE), F.lit(1))).alias("cpu_percent"),
        _mean(F.regexp_extract_all(cores, F.lit(CORE), F.lit(2))).alias("cpu_mhz"),
        _number(line, GPU_LOAD).alias("gpu_percent"),
        _mean(clusters).alias("gpu_mhz"),
        F.array_max(F.transform(clusters, lambda x: x.try_cast("double"))).alias("gpu_mhz_peak"),
    )


def parse_node_stats(line: Column) -> Column:
    """Struct of RAM, GPU load, mean core load and the CPU's and GPU's temperature, names in either case."""
    return F.struct(
        _number(line, RAM, 1).alias("ram_used_mb"),
        _number(line, RAM, 2).alias("ram_total_mb"),
        _number(line, GPU_LOAD).alias("gpu_percent"),
        _mean(F.regexp_extract_all(F.regexp_extract(line, CORES, 1), F.lit(r"(\d+)%"), F.lit(1))).alias("cpu_percent"),
        _number(line, TEMPERATURE.format("cpu")).alias("cpu_c"),
        _number(line, TEMPERATURE.format("gpu")).alias("gpu_c"),
    )


def parse_speech_timings(log: Column) -> Column:
    """Struct of load_ms, total_ms (the last), and ms per run, rounded to 2, of sample, encode and decode."""

    def per_run(name: str) -> Column:
        pattern = rf"{name} time\s*=\s*([\d.]+)\s*ms\s*/\s*(\d+)\s*runs"
        return F.round(F.try_divide(_number(log, pattern, 1), _number(log, pattern, 2)), 2).alias(f"{name}_ms")

    totals = F.regexp_extract_all(log, F.lit(r"total time\s*=\s*([\d.]+)\s*ms"), F.lit(1))
    return F.struct(
        _number(log, r"load time\s*=\s*([\d.]+)\s*ms").alias("load_ms"),
        *[per_run(n) for n in ("sample", "encode", "decode")],
        F.try_element_at(totals, F.lit(-1)).try_cast("double").alias("total_ms"),
    )


#: Flags of an engine's system line, in the order in which they are told, and the name of each.
BUILD_FLAGS = (
    ("AVX2", ("AVX2 = 1",)),
    ("NEON", ("NEON = 1",)),
    ("BLAS", ("BLAS = 1",)),
    ("COREML", ("COREML = 1",)),
    ("CUDA", ("CUDA = 1", "CUDA : ARCHS")),
    ("MTL", ("MTL = 1", "MTL : EMBED_LIBRARY = 1")),
)


def build_config(system_info: Column) -> Column:
    """Names of the flags that are set, each after a space; empty if none is."""
    return F.concat(*[F.when(F.exists(F.array(*[F.lit(x) for x in marks]), lambda m: F.contains(system_info, m)), f" {name}").otherwise("") for name, marks in BUILD_FLAGS])


# Terminal codes, time stamps, and what lines of the engine and its drivers start with or hold.
ANSI = "\\x1B\\[[0-?]*[ -/]*[@-~]"
CLEARED_LINE = "\\x1B\\[2K"
CLEARED_SPACES = "\\r+\\s{20,}\\r+"
STAMPED = r"^\[[0-9:.,\s\-]+-->\s*[0-9:.,\s\-]+\]\s*(.*)$"
LOG_PREFIXES = ("whisper_", "system_info:", "main:")
CHUNK_PREFIXES = ("Script started", "Script done", "init:", "whisper_", "whisper_print_timings:", "system_info:", "main:", "ggml_", "NvRm", "****", "ALSA ", "###")
LOG_PARTS = ("whisper_print_timings:",)
CHUNK_PARTS = ("samples per frame", "required:")
BLANK, START = "[BLANK_AUDIO]", "[Start speaking]"
# End of the fixed values.


def _said(line: Column, prefixes: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Whether a line is none of the engine's."""
    told = F.exists(F.array(*[F.lit(x) for x in prefixes]), lambda x: line.startswith(x))
    return (line != "") & ~told & ~F.exists(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(line, x))


def _bare(line: Column) -> Column:
    return F.when(line.rlike(STAMPED), F.trim(F.regexp_extract(line, STAMPED, 1))).otherwise(line)


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))


def clean_transcript_log(log: Column) -> Column:
    """The spoken text of a run's log, lines joined by a space: without terminal codes, engine lines, time stamps, and lines
    without a stamp that start or end with a bracket."""
    lines = F.filter(_trimmed(F.split(F.regexp_replace(log, ANSI, ""), "\r?\n|\r")), lambda x: _said(x, LOG_PREFIXES, LOG_PARTS))
    lines = F.filter(lines, lambda x: x.rlike(STAMPED) | ~(x.startswith("[") | x.endswith("]")))
    return F.trim(F.array_join(F.transform(lines, _bare), " "))


def clean_transcript_chunk(chunk: Column) -> Column:
    """The spoken lines of a piece of terminal output, each ended by a line feed: without terminal codes, lines that were cleared,
    marks of blank audio, lines of the engine, its session and drivers, and time stamps."""
    text = F.regexp_replace(chunk, CLEARED_LINE, "\r")
    text = F.replace(F.regexp_replace(F.regexp_replace(text, ANSI, ""), CLEARED_SPACES, "\r"), F.lit(BLANK), F.lit(""))
    lines = F.filter(_trimmed(F.split(text, "[\r\n]+")), lambda x: _said(x, CHUNK_PREFIXES, CHUNK_PARTS))
    kept = F.filter(F.transform(lines, _bare), lambda x: (x != "") & (x != START))
    return F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), "")
