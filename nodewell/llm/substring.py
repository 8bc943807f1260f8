"""Substring dedup: words covered by a window of words that starts earlier elsewhere, by partitioned suffix trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nodewell.llm.common import join_few, materialise
from nodewell.llm.workers import tidy

WINDOW, GRAM = 20, 8
#: Bytes of the suffixes of a group; a larger one is split by the longest prefix, the whole window.
GROUP_BYTES = 1 << 20
#: Groups are collected up to so many bytes of suffixes before their subtrees are built.
BUFFER_BYTES = 16 << 20
#: Bytes that a suffix takes besides its words.
SUFFIX_BYTES = 64
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(GRAM)], np.uint64)


def super_windows(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, first window, number of windows, places, bytes) of the runs of windows whose least gram hash is the same.

    Equal windows have equal keys, so all places of a repeated window meet in one group, and the suffixes of a run
    travel as one text instead of one text each. places is 2 if the run itself may hold equal windows: it then has
    more windows than hold one gram, or a window that holds the least gram twice. bytes: of the windows, each for itself.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    m = len(words) - gram + 1
    g = np.zeros(m, np.uint64)
    for i in range(gram):
        g += h[i : i + m] * _FACTORS[i]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    span, width = g, 1
    while 2 * width <= window - gram + 1:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    if (more := window - gram + 1 - width) > 0:
        span = np.minimum(span[:-more], span[more:])
    first = np.concatenate([[0], np.flatnonzero(span[1:] != span[:-1]) + 1])
    number = np.diff(np.append(first, n))
    held = np.zeros(n, np.int8)
    for i in range(window - gram + 1):
        held += g[i : i + n] == span
    twice = np.maximum.reduceat(held, first) > 1
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    size = np.add.reduceat(at[window:] - at[:-window] + SUFFIX_BYTES, first)
    return span[first], first, number, np.where(twice | (number > window - gram + 1), 2, 1), size


def suffix_classes(texts: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, class) of every suffix of window words or more; those with a common prefix of window words,
    that is under one internal node of their suffix tree at that depth, have one class.

    The classes are refined by prefix doubling: two suffixes share 2k words if they share k and k words on share k more.
    """
    number: dict[bytes, int] = {}
    of_text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = [w for t in texts for w in t]
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    first = np.searchsorted(of_text, np.arange(len(texts)))
    word = np.arange(len(words)) - first[of_text]
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        # Past a text's end the suffix is too short for the window and drops out at last.
        pair = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        depth += step
    long = np.flatnonzero(of_text[: len(rank)] == of_text[window - 1 :])
    return of_text[long], word[long], rank[long]


def repeated_windows(texts: list[list[bytes]], order: list[tuple], window: int = WINDOW) -> list[np.ndarray]:
    """For each text the numbers of the windows that also start earlier: all leaves but the earliest of each internal node
    of window words. order: a comparable place of each text, its last part the number of its first word; windows of one
    document and word are one place, as texts of a document may overlap."""
    row, number, node = suffix_classes(texts, window)
    by_place = sorted(range(len(texts)), key=order.__getitem__)
    place = np.empty(len(texts), np.int64)
    place[by_place] = np.concatenate([[0], np.cumsum([order[a][:-1] != order[b][:-1] for a, b in zip(by_place[1:], by_place[:-1], strict=True)])])
    word = np.array([o[-1] for o in order])[row] + number
    leaves = np.lexsort((word, place[row], node))
    opens = np.concatenate([[True], node[leaves][1:] != node[leaves][:-1]])[: len(leaves)]
    least = leaves[np.maximum.accumulate(np.where(opens, np.arange(len(leaves)), 0))]
    later = np.zeros(len(row), bool)
    later[leaves] = (place[row[leaves]] != place[row[least]]) | (word[leaves] != word[least])
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [number[a:b][later[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(df with d, th and _t, exceptions): d is the key, null first; th a hash of the text; exceptions has (d, th, v, copy, again)
    of texts that equal another document's earlier one (copy), whose key has several texts (v tells those apart), or whose
    key and text are in several rows (again)."""
    docs = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))).alias("d"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"),
    ).withColumn("th", F.xxhash64("_t"))
    names = materialise(docs.select("d", "th", F.md5("_t").alias("m")), "text-digests")
    of_key = names.groupBy("d").agg(F.min("m").alias("x"), F.max("m").alias("y"), F.count("*").alias("rows")).where("rows > 1")
    first = names.groupBy("m").agg(F.min(F.struct("d", "th")).alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "first")
    marked = names.join(first, "m", "left").join(of_key, "d", "left")
    copy = F.coalesce(F.struct("d", "th") != F.col("first"), F.lit(False))
    odd = marked.select("d", "th", F.when(F.expr("x <> y"), F.col("th")).otherwise(F.lit(0)).alias("v"), copy.alias("copy"), F.expr("rows is not null").alias("again"))
    return docs, materialise(odd.where("copy or v <> 0 or again").distinct(), "copies")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, v, text -> one row per super-window: h, d, v, s (first window), n (windows), c (places), z (bytes)."""
    for b in batches:
        d, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        found, owner = [], []
        for i, t in enumerate(b.column(2)):
            found.append(super_windows(t.as_py().split()))
            owner.append(np.full(len(found[-1][0]), i))
        if found:
            at = np.concatenate(owner)
            keys, first, count, places, size = (np.concatenate(x) for x in zip(*found, strict=True))
            small = [pa.array(x.astype(np.int32)) for x in (first, count, places)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(d[at]), pa.array(v[at]), *small, pa.array(size)], ["h", "d", "v", "s", "n", "c", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, v, text, marks [(h, s, n)] -> h, d, v, s, text of each marked super-window."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for b in batches:
        for at in range(0, b.num_rows, 200):
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, v, t, marks in zip(*[c.slice(at, 200).to_pylist() for c in b.columns], strict=True):
                words = t.split()
                for m in marks:
                    for column, x in zip(out, (m["h"], d, v, m["s"], b" ".join(words[m["s"] : m["s"] + m["n"] + WINDOW - 1])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "d", "v", "s", "w"])


def _whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """d, v, text, marks -> w, d, v, s: each window of the marked super-windows at its earliest place, once as long as the windows
    met since the last time fit into HELD_BYTES."""
    first: dict[bytes, tuple[int, int, int]] = {}
    held = 0

    def told() -> pa.RecordBatch:
        places = list(zip(*first.values(), strict=True)) or [[], [], []]
        columns = [pa.array(list(x), k) for x, k in zip(places, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), *columns], ["w", "d", "v", "s"])

    for b in batches:
        for at in range(0, b.num_rows, 200):
            for d, v, t, marks in zip(*[c.slice(at, 200).to_pylist() for c in b.columns], strict=True):
                words = t.split()
                for m in marks:
                    for s in range(m["s"], m["s"] + m["n"]):
                        w = b" ".join(words[s : s + WINDOW])
                        known = first.get(w)
                        if known is None:
                            held += len(w) + ENTRY_BYTES
                        if known is None or (d, v, s) < known:
                            first[w] = (d, v, s)
                        if held > HELD_BYTES:
                            yield told()
                            first, held = {}, 0
    yield told()


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h, d, v, s, w sorted by h -> d, v, b, e: words b to e - 1 of the document are covered by a window that starts earlier."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[4] for r in rows], [r[1:4] for r in rows])
        out: list[tuple] = []
        for (_, d, v, s, _), later in zip(rows, found, strict=True):
            if later.size:
                cuts = np.flatnonzero(np.diff(later) > 1)
                for a, z in zip(later[np.append(0, cuts + 1)].tolist(), later[np.append(cuts, later.size - 1)].tolist(), strict=True):
                    out.append((d, v, s + a, s + z + WINDOW))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["d", "v", "b", "e"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            for h, d, v, s, w in zip(*[c.slice(at, 2000).to_pylist() for c in batch.columns], strict=True):
                if size >= BUFFER_BYTES and h != rows[-1][0]:
                    yield search(rows)
                    rows, size = [], 0
                words = w.split()
                rows.append((h, d, v, s, words))
                size += (len(words) - WINDOW + 1) * (SUFFIX_BYTES + WINDOW * len(w) // len(words))
    if rows:
        yield search(rows)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, copy, spans -> key, n_words, n_removed, kept. A span is (kind, b, e): covered words, windows that all
    start earlier elsewhere but for exceptions, or such an exception."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            total, gone, kept = [], [], []
            for t, copy, spans in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                words = t.split()
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif spans:
                    starts = np.zeros(n + 1, np.int8)
                    for x in sorted(spans, key=lambda x: x["kind"]):
                        starts[x["b"] : x["e"] - (WINDOW - 1 if x["kind"] == COVERED else 0)] = x["kind"] != EXCEPT
                    edge = np.zeros(n + 1, np.int64)
                    begin = np.flatnonzero(starts)
                    edge[begin] += 1
                    edge[begin + WINDOW] -= 1
                    keep = np.cumsum(edge)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], ["key", "n_words", "n_removed", "kept"])


#: Bytes of windows and their places that a task holds before it passes them on, and what an entry takes besides its words.
HELD_BYTES, ENTRY_BYTES = 64 << 20, 400

#: What a span of a document holds; see _strip. Windows of oversize groups come first, as others may cover the same words.
HOT, EXCEPT, COVERED = range(3)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; key must be an integer.

    A word goes if a window of 20 words covers it whose words also start earlier: in a document with a smaller key, or
    earlier in its own. kept: the other words, joined by one space. Null text: no words. Null keys count as the
    smallest. Rows that repeat key and text are one document and get one result each; different texts of one key are
    told apart by a hash. Texts equal to an earlier document's are settled by their digest. Texts of any length are
    taken whole; a task holds one of them at a time, with its windows. An empty table gives none.

    Steps: the keys of all super-windows are counted; the windows of a key found once are unique. The others meet in
    groups by key, sorted by Spark, and suffix trees are built of each group in memory: its nodes of 20 words or more are
    the repeats. A key whose suffixes take more than group_bytes is split by the longest prefix, the whole window; all
    places of such a window but the earliest repeat, so the earliest alone is looked for, by an aggregation.
    """
    docs, odd = _numbered(df, key, text)
    no = F.lit(False)
    flagged = join_few(docs, odd, ["d", "th"]).withColumns({"v": F.coalesce("v", F.lit(0).cast("bigint")), "copy": F.coalesce("copy", no), "again": F.coalesce("again", no)})
    texts = flagged.where("not copy").select("d", "v", "_t", "again")
    unique = texts.where("not again").unionByName(texts.where("again").dropDuplicates(["d", "v"])).drop("again")
    anchors = materialise(unique.mapInArrow(tidy(_anchors), "h bigint, d bigint, v bigint, s int, n int, c int, z bigint"), "super-windows")
    again = anchors.groupBy("h").agg(F.sum("c").alias("places"), F.sum("z").alias("size")).where("places > 1")
    mark = F.struct("h", "s", "n", (F.col("size") > group_bytes).alias("hot"))
    marks = anchors.join(again, "h").groupBy("d", "v").agg(F.collect_list(mark).alias("marks"))
    marks = materialise(marks, "marks")

    def marked(hot: bool) -> DataFrame:
        own = marks.withColumn("marks", F.filter("marks", lambda m: m["hot"] == F.lit(hot))).where(F.size("marks") > 0)
        return join_few(unique, own, ["d", "v"], "inner").select("d", "v", "_t", "marks")

    groups = marked(False).mapInArrow(tidy(_cut), "h bigint, d bigint, v bigint, s int, w binary").repartition("h").sortWithinPartitions("h")
    spans = groups.mapInArrow(tidy(_subtrees), "d bigint, v bigint, b int, e int").select("d", "v", F.lit(COVERED).alias("kind"), "b", "e")
    hot = marks.select("d", "v", F.explode(F.filter("marks", lambda m: m["hot"])).alias("m"))
    hot = hot.select("d", "v", F.lit(HOT).alias("kind"), F.col("m.s").alias("b"), F.expr("m.s + m.n").alias("e"))
    earliest = marked(True).mapInArrow(tidy(_whole_windows), "w binary, d bigint, v bigint, s int").groupBy("w").agg(F.min(F.struct("d", "v", "s")).alias("p"))
    earliest = earliest.select("p.d", "p.v", F.lit(EXCEPT).alias("kind"), F.col("p.s").alias("b"), F.expr("p.s + 1").alias("e"))
    each = spans.union(hot).union(earliest)
    covered = materialise(each.groupBy("d", "v").agg(F.collect_list(F.struct("kind", "b", "e")).alias("spans")), "covered")
    out = join_few(flagged, covered, ["d", "v"]).select("_key", "_t", "copy", "spans")
    kind = df.schema[key].dataType.simpleString()
    return out.mapInArrow(tidy(_strip), f"key {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("key", key)
