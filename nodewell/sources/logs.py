"""Movement logs, filter metrics, telemetry text, archive listings and transcripts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from nodewell import schemas
from nodewell.operators.ordered import latest, timeline


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of text files; pos orders the lines of a file, of which large ones are read in several tasks."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), pos.alias("pos"), F.col("value").alias("line"))


def _by_header(spark: SparkSession, path: str, field: str, names: list[str]) -> DataFrame:
    """(file, names as strings) of CSV files, each line read by the last header before it, a line that has the given field name, so
    a log that was started again may order its columns anew; lines before the first header are read by it. A column that a header
    lacks is null. A file without a header is left out, as nothing tells its columns. Only the distinct headers come to the driver."""
    lines = _lines(spark, path).where("trim(line) <> ''").select("file", "pos.block", "pos.n", "line")
    is_head = F.array_contains(F.transform(F.split("line", ","), lambda x: F.trim(x)), field)
    forms = sorted(r[0] for r in lines.where(is_head).select("line").distinct().collect())
    head = F.when(is_head, F.col("line"))
    told = timeline(lines, ("file",), "block", ("n",)).scan(_h=latest(head)).rows()
    first = lines.where(is_head).groupBy("file").agg(F.min_by("line", F.struct("block", "n")).alias("_first"))
    rows = told.where(~is_head).join(first, "file").withColumn("_h", F.coalesce("_h", "_first"))
    parsed = F.lit(None).cast("struct<" + ", ".join(f"`{n}`: string" for n in names) + ">")
    for form in forms:
        own = [c.strip() for c in form.split(",")]
        row = F.from_csv("line", F.lit(", ".join(f"`_{i}` string" for i in range(len(own)))))
        value = [F.trim(row[f"_{own.index(n)}"]) if n in own else F.lit(None).cast("string") for n in names]
        parsed = F.when(F.col("_h") == form, F.struct(*[v.alias(n) for v, n in zip(value, names, strict=True)])).otherwise(parsed)
    return rows.select("file", parsed.alias("_r")).select("file", "_r.*")


def read_movement(spark: SparkSession, path: str) -> DataFrame:
    """Movement CSV files, each read by its own header, so the order of its columns does not matter; numbers that don't parse are null."""
    names = [f.strip().split(" ")[0].strip("`") for f in schemas.MOVEMENT.split(", ")]
    text = {"Date", "Time", "Direction"}
    rows = _by_header(spark, path, "Date", names)
    return rows.select(*[F.col(f"`{n}`") if n in text else F.expr(f"try_cast(`{n}` as double)").alias(n) for n in names])


LEGACY_FIELDS = ("date", "time", "cpu", "mem", "swap", "cpu_temp", "gpu_temp", "x", "direction")
EXCEPTION = "Encountered exception!"


def legacy_blocks(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """Blocks of nine lines (file, block, date, time, load of CPU, memory and swap, temperatures, x, direction).

    A line counts up to its first comma; empty lines and those that say EXCEPTION alone are skipped. Its value is what follows
    the first colon, of numbers without the sign at the end. Blocks are numbered in file order; an unfinished one is left
    out. direction keeps its space, by which it is told; see traffic.day_rollup.
    """
    said = F.split_part(line, F.lit(","), F.lit(1))
    kept = lines.where((F.col(line) != "") & (said != EXCEPTION))
    kept = kept.withColumn("_n", F.row_number().over(W.partitionBy(file).orderBy(pos)) - 1)
    kept = kept.select(file, F.expr("_n div 9").alias("block"), (F.col("_n") % 9).alias("_f"), F.regexp_replace(said, "^[^:]*:", "").alias("_v"))
    fields = [F.max(F.when(F.col("_f") == i, F.col("_v"))).alias(n) for i, n in enumerate(LEGACY_FIELDS)]
    out = kept.groupBy(file, "block").agg(*fields, F.count("*").alias("_c")).where("_c = 9").drop("_c")
    numbers = {n: F.expr(f"try_cast(trim(substring({n}, 1, length({n}) - 1)) as double)") for n in LEGACY_FIELDS[2:7]}
    return out.withColumns({"date": F.trim("date"), "time": F.trim("time"), **numbers})


def read_legacy_log(spark: SparkSession, path: str) -> DataFrame:
    return legacy_blocks(_lines(spark, path))


def read_filter_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSV files, each read by its own header; the filter is a column or part of the file name metrics_<filter>.csv; numbers
    that don't parse are null."""
    names = [f.split(" ")[0] for f in schemas.FILTER_METRICS.split(", ")]
    rows = _by_header(spark, path, "timestamp", names)
    named = F.nullif(F.regexp_extract("file", "metrics_([^/]*?)\\.csv$", 1), F.lit(""))
    numbers = [F.expr(f"try_cast({c} as double)").alias(c) for c in ("fps", "cpu_percent", "memory_percent", "gpu_percent")]
    return rows.select("timestamp", F.coalesce(F.nullif("filter", F.lit("")), named).alias("filter"), F.expr("try_cast(frame_index as int)").alias("frame_index"), *numbers)


def index_images(spark: SparkSession, root: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Paths of the images below root, in either layout (YYYY/MM/DD/HH/*.jpg, YYYY-MM-DD/*.jpg); see functions.scalars.image_timestamp.
    With days start to end only their folders are looked into, whatever else the archive holds; many are listed by tasks."""
    own = [root]
    if start is not None and end is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path
        system = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
        days = [start + timedelta(days=n) for n in range((end - start).days + 1)]
        own = [f for d in days for f in (f"{root.rstrip('/')}/{d:%Y/%m/%d}", f"{root.rstrip('/')}/{d:%Y-%m-%d}") if system.exists(place(f))]
    if not own:
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(own).select("path")


def read_telemetry_text(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def read_reference_lines(spark: SparkSession, path: str) -> DataFrame:
    """(code, text) of lines `code text`."""
    return spark.read.text(path).select(F.regexp_extract("value", "^(\\S+)\\s*(.*)$", 1).alias("code"), F.regexp_extract("value", "^(\\S+)\\s*(.*)$", 2).alias("text")).where("code <> ''")


def read_hypotheses(spark: SparkSession, path: str, ending: str = ".flac.txt") -> DataFrame:
    """(code, text) of one file each, decoded as windows-1252 where all bytes are defined there, else as UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    undefined = F.hex("content").rlike("^(..)*(81|8D|8F|90|9D)")
    # Spark decodes Latin-1, which differs from windows-1252 in the bytes 80 to 9F alone.
    own = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
    windows = F.translate(F.decode("content", "ISO-8859-1"), "".join(a for a, _ in own), "".join(b for _, b in own))
    text = F.when(undefined, F.decode("content", "UTF-8")).otherwise(windows)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("code"), text.alias("text")).withColumn("code", F.regexp_replace("code", ending.replace(".", "\\.") + "$", ""))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(code, text) of token files: the first |-separated field of every line but the header, joined in line order."""
    lines = _lines(spark, path).withColumn("code", F.regexp_extract("file", "([^/]*?)(\\.[^./]*)?$", 1))
    numbered = lines.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy("pos"))).where("_n > 1 and trim(line) <> ''")
    token = F.struct("_n", F.split_part("line", F.lit("|"), F.lit(1)).alias("t"))
    g = lines.select("file", "code").distinct().join(numbered.groupBy("file").agg(F.array_sort(F.collect_list(token)).alias("x")), "file", "left")
    return g.select("code", F.coalesce(F.array_join("x.t", " "), F.lit("")).alias("text"))


def write_transcript(cues: DataFrame, path: str) -> None:
    """Text rows of operators.speech.cues, one folder per audio_id, in order within each."""
    cues.repartition("audio_id").sortWithinPartitions("audio_id", "no").select("audio_id", "value").write.mode("overwrite").partitionBy("audio_id").text(path)
