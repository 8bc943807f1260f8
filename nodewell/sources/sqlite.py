"""Tables of SQLite files as a Spark data source: read in ranges of rows by many tasks, written as one file a task.

The files lie in a folder that driver and executors mount alike, as each task opens them by itself."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from glob import glob
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

FORMAT = "sqlite_files"
ROWS = 10_000  # rows of a batch


def local_path(path: str) -> str:
    """The path without file: before it; another scheme raises, as SQLite opens files only."""
    plain = path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"SQLite files must be mounted: {path}")
    return "/" + plain.lstrip("/") if path.startswith("file:") else plain


def files_of(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those of a pattern, without hidden ones."""
    plain = local_path(path)
    found = glob(os.path.join(plain, "*")) if os.path.isdir(plain) else glob(plain)
    out = sorted(f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
    if not out:
        raise FileNotFoundError(f"no SQLite file matches {path}")
    return out


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def said(column: str, kind: str) -> str:
    """A column as text where it is read as such: a column need not store what it is declared to hold."""
    name = quoted(column)
    return f"case typeof({name}) when 'blob' then null else cast({name} as text) end" if kind == "string" else name


def opened(file: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(os.path.abspath(file))}?mode=ro", uri=True)


def spark_type(declared: str) -> str:
    """The type of a column by SQLite's rules of affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return "bigint"
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in kind:
        return "binary"
    return "double" if any(x in kind for x in ("REAL", "FLOA", "DOUB")) or kind else "string"


def read_value(value: Any, kind: str) -> Any:
    """A stored value, which may be of any type, as the column's; null where it has none in it."""
    if value is None or kind == "binary" and isinstance(value, bytes):
        return value
    if kind == "string":
        return str(value)
    if kind == "binary":
        return value.encode() if isinstance(value, str) else None
    if isinstance(value, (str, bytes)):
        return None
    if kind == "double":
        return float(value)
    return int(value) if value == int(value) else None


@dataclass
class Rows(ds.InputPartition):
    """The rows of a file whose row number, a column of that name, is from low to high, or all where the table has none."""

    file: str
    number: str | None = None
    low: int | None = None
    high: int | None = None


class Reader(ds.DataSourceReader):
    """Reads ranges of rowids. Comparisons of a column with a value are left to SQLite too, which then reads and sends fewer rows;
    Spark checks them again, as a stored value may have another type than its column."""

    SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, dict(options)
        self.where: list[str] = []
        self.values: list[Any] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            comparable = {"bigint": int, "double": (int, float), "string": str}.get(kinds.get(column, ""))
            if comparable:
                name = f"{said(column, kinds[column])} collate binary"
                if type(f) in self.SIGNS and isinstance(f.value, comparable) and not isinstance(f.value, bool):
                    self.where.append(f"{name} {self.SIGNS[type(f)]} ?")
                    self.values.append(f.value)
                elif isinstance(f, ds.In) and 0 < len(f.value) < 500 and all(isinstance(v, comparable) for v in f.value):
                    self.where.append(f"{name} in ({', '.join('?' * len(f.value))})")
                    self.values += f.value
            yield f

    def partitions(self) -> list[Rows]:
        files = files_of(self.options["path"])
        each = max(1, int(self.options.get("numpartitions", 8)) // len(files))
        return [p for f in files for p in self._ranges(f, each)]

    def _ranges(self, file: str, n: int) -> list[Rows]:
        table = quoted(self.options["table"])
        with closing(opened(file)) as c:
            own = {r[1].lower() for r in c.execute(f"pragma table_info({table})")}
            free = [x for x in ("rowid", "_rowid_", "oid") if x not in own]
            numbered = any(kind == "table" and not without for _, _, kind, _, without, _ in c.execute(f"pragma table_list({table})"))
            if not free or not numbered:  # a view, or a table without row numbers
                return [Rows(file)]
            low, high = c.execute(f"select min({free[0]}), max({free[0]}) from {table}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // n)
        return [Rows(file, free[0], at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a row
            return
        kinds = [(f.name, f.dataType.simpleString()) for f in self.schema]
        where, values = list(self.where), list(self.values)
        if partition.number:
            where.append(f"{partition.number} between ? and ?")
            values += [partition.low, partition.high]
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
        wanted = f"select {', '.join(said(n, k) for n, k in kinds)} from {quoted(self.options['table'])}" + (f" where {' and '.join(where)}" if where else "")
        with closing(opened(partition.file)) as c:
            cursor = c.execute(wanted, values)
            while rows := cursor.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([read_value(r[i], k) for r in rows], types[k]) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


@dataclass
class Written(ds.WriterCommitMessage):
    name: str | None


class Writer(ds.DataSourceArrowWriter):
    """A file per task, under a hidden name until the job commits; a task that is run again leaves one file."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.schema, self.folder, self.table, self.overwrite = schema, local_path(options["path"]), options["table"], overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        affinity = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        columns = ", ".join(f"{quoted(f.name)} {affinity.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema)
        name = f".{self.job}-{uuid.uuid4().hex[:12]}.db"
        n = 0
        with closing(sqlite3.connect(os.path.join(self.folder, name))) as c:
            c.execute(f"create table {quoted(self.table)} ({columns})")
            for b in iterator:
                rows = zip(*(col.to_pylist() for col in b.columns), strict=True)
                c.executemany(f"insert into {quoted(self.table)} values ({', '.join('?' * len(self.schema))})", rows)
                n += b.num_rows
            c.commit()
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        names = [m.name for m in messages if m and m.name]
        before = files_of(self.folder) if self.overwrite and os.path.isdir(self.folder) and any(not f.startswith((".", "_")) for f in os.listdir(self.folder)) else []
        for name in names:
            os.rename(os.path.join(self.folder, name), os.path.join(self.folder, "part-" + name[1:]))
        for f in before:
            os.remove(f)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for f in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if f.startswith(f".{self.job}-"):
                os.remove(os.path.join(self.folder, f))


class SqliteSource(ds.DataSource):
    """Options: path (a file, folder or pattern), table, columns (separated by commas; all if not given), numPartitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        with closing(opened(files_of(self.options["path"])[0])) as c:
            known = {n: spark_type(t) for _, n, t, *_ in c.execute(f"pragma table_info({quoted(self.options['table'])})")}
        if not known:
            raise ValueError(f"no table {self.options['table']}")
        wanted = [n.strip() for n in self.options["columns"].split(",")] if self.options.get("columns") else list(known)
        return ", ".join(f"`{n}` {known[n]}" for n in wanted)

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """A table of one or many SQLite files, such as directional_data or photos of a device each. Types follow the first file's
    declarations; values of another type are null. columns: read these alone."""
    _ready(spark)
    given = spark.read.format(FORMAT).option("table", table).option("numPartitions", partitions)
    return (given.option("columns", ",".join(columns)) if columns else given).load(path)


def write_sqlite(df: DataFrame, path: str, table: str, overwrite: bool = False) -> None:
    """df as a folder of SQLite files, one per task, times as text; the files appear when all are complete."""
    _ready(df.sparkSession)
    plain = {"bigint", "int", "smallint", "tinyint", "boolean", "double", "float", "binary", "string"}
    kept = df.select(*[df[c] if t in plain else df[c].cast("string").alias(c) for c, t in df.dtypes])
    kept.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("table", table).save(path)
