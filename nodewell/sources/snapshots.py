"""Tables of immutable files under numbered manifests: a reader sees one version, a writer adds the next one or none."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass
class Manifest:
    """version; parts: the folders of files by the value of the partition column (as text, null as ''); done: the last batch of each
    stream that is in the table; schema of the rows."""

    version: int = -1
    parts: dict[str, list[str]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    schema: str = ""


class Snapshots:
    """The table at a path. Files of it are written once and named by manifests; a manifest is published under the next number by
    an operation that fails if the number is taken, so of two writers one sees the other's version and starts over."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def versions(self) -> list[int]:
        """Published versions, oldest first; none where there is no table."""
        folder = self._place("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, else of the last one; an empty one where there is no table."""
        known = self.versions()
        if version is None:
            if not known:
                return Manifest()
            version = known[-1]
        stream = self._fs.open(self._place("manifests", f"{version:020}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, whatever is written meanwhile."""
        own = self.manifest(version)
        if own.version < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(own, sorted(own.parts))

    def _rows(self, own: Manifest, parts: list[str]) -> DataFrame:
        folders = [f"{self.path}/{f}" for p in parts for f in own.parts.get(p, ())]
        given = self.spark.read.schema(own.schema)
        return given.parquet(*folders) if folders else self.spark.createDataFrame([], own.schema)

    def _publish(self, new: Manifest) -> None:
        final, hidden = self._place("manifests", f"{new.version:020}.json"), self._place("manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if self._fs.getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), final.toUri().getPath())  # a rename would replace the other's file
            except FileExistsError as e:
                raise Conflict(str(final)) from e
            finally:
                self._fs.delete(hidden, False)
        elif not self._fs.rename(hidden, final):
            self._fs.delete(hidden, False)
            raise Conflict(str(final))

    def _write(self, rows: DataFrame, part: str) -> dict[str, list[str]]:
        """Writes rows as files of a folder of their own; which of it holds which part."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_part", F.coalesce(F.col(part).cast("string"), F.lit(""))).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._place(folder)) if s.isDirectory()]
        unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        value = lambda n: "" if n == "_part=__HIVE_DEFAULT_PARTITION__" else unescaped(n.removeprefix("_part="))
        return {value(n): [f"{folder}/{n}"] for n in names if n.startswith("_part=")}

    def upsert(self, new: DataFrame, keys: tuple[str, ...], part: str, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Puts the rows of new in place of those with the same keys, of equals in new the greatest; part is one of the keys, and
        only its parts that occur in new are read and written. The version that holds them.

        batch: a stream's name and the batch's number; a batch that is in the table already changes nothing. Another writer's version
        is merged again only where it touched the same parts."""
        one = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("_v")) if len(new.columns) > len(keys) else new.distinct()
        once = one.select(*[F.col(c) if c in keys or "_v" not in one.columns else F.col(f"_v.`{c}`").alias(c) for c in new.columns])
        folder = f"{self.path}/data/given-{uuid.uuid4().hex}"
        once.write.parquet(folder)  # the same rows in every try
        given = self.spark.read.schema(new.schema).parquet(folder)
        touched = [r[0] for r in given.select(F.coalesce(F.col(part).cast("string"), F.lit(""))).distinct().collect()]
        try:
            base, written = None, {}
            for _ in range(tries):
                own = self.manifest()
                if batch and own.done.get(batch[0], -1) >= batch[1]:
                    return own.version
                if base is None or any(own.parts.get(p) != base.parts.get(p) for p in touched):
                    base, merged = own, given
                    if any(own.parts.get(p) for p in touched):
                        known = self._rows(own, touched)
                        same = [known[k].eqNullSafe(given[k]) for k in keys]
                        merged = known.join(given, same, "left_anti").unionByName(given, allowMissingColumns=True)
                    written = self._write(merged, part) if touched else {}
                    schema = merged.schema.toDDL()
                kept = {p: f for p, f in own.parts.items() if p not in touched}
                try:
                    return self._next(own, {**kept, **written}, schema, batch)
                except Conflict:
                    continue
            raise Conflict(f"{self.path}: given up after {tries} tries")
        finally:
            self._fs.delete(self._hadoop.Path(folder), True)

    def replace(self, rows: DataFrame, part: str, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Makes rows the whole table. The version that holds them."""
        written, schema = self._write(rows, part), rows.schema.toDDL()
        for _ in range(tries):
            own = self.manifest()
            if batch and own.done.get(batch[0], -1) >= batch[1]:
                return own.version
            try:
                return self._next(own, written, schema, batch)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: given up after {tries} tries")

    def _next(self, own: Manifest, parts: dict[str, list[str]], schema: str, batch: tuple[str, int] | None) -> int:
        new = Manifest(own.version + 1, parts, {**own.done, **({batch[0]: batch[1]} if batch else {})}, schema)
        self._publish(new)
        return new.version

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400) -> int:
        """Deletes manifests but for the last `keep`, and folders that no kept one names and that are older; how many folders.
        The age spares what a writer has not published yet."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self._fs.delete(self._place("manifests", f"{v:020}.json"), False)
        used = {f for m in kept for folders in m.parts.values() for f in folders}
        now, gone = self.spark._jvm.java.lang.System.currentTimeMillis(), 0
        folders = self._fs.listStatus(self._place("data")) if self._fs.exists(self._place("data")) else []
        for s in (s for s in folders if now - s.getModificationTime() >= 1000 * older_than_s):
            name = f"data/{s.getPath().getName()}"
            if not any(f.startswith(name + "/") for f in used):
                gone += bool(self._fs.delete(s.getPath(), True))
                continue
            for part in self._fs.listStatus(s.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(part.getPath(), True))
        return gone
