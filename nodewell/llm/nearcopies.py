"""Near copies: fingerprints and rare word shingles name candidates, and the exact Jaccard similarity of the whole sets decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from nodewell.llm import simhash
from nodewell.llm.common import connected_components, join_few, materialise
from nodewell.llm.workers import tidy

#: Frequent shingles are told on 10,000 documents or an eighth of all, and this many of them at most (3 MB in every task). Both bear
#: on the cost only, never on the result.
SAMPLE_DOCS, ONE_IN, FREQUENT = 10_000, 8, 200_000
#: Orders in which a shingle's texts choose one of them to be compared with; on the cost only, too.
ORDERS = 4
#: Shingles before one that tell whether two texts have met already; on the cost only, too.
MET = 8
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit codes of the runs of width words; of a shorter text one code, of no words none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    code = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        code = code * BASE + h[i : i + n]
    code = (code ^ (code >> np.uint64(31))) * MIX
    return np.unique(code ^ (code >> np.uint64(29)))


def _codes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                own = [shingles(t.as_py(), width) for t in b.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["code"])

    return run


def _node(codes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(codes.tobytes())


def _fingerprint(codes: np.ndarray) -> int:
    """SimHash of a set of codes; zero of none."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(codes), bitorder="little").view(np.uint64)[0])


def _residues(codes: np.ndarray) -> bytes:
    """How many codes have each residue, of two to four times fewer residues than codes (255 for more than that): two sets have
    no more in common than the sum of the lesser counts. Counts by more residues fold into those by fewer."""
    n = 1 << max(4, len(codes).bit_length() - 2)
    return np.minimum(np.bincount((codes & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def _most_in_common(a: bytes, b: bytes) -> int | None:
    """The bound that two texts' residues set, or None where they set none."""
    x, y = (np.frombuffer(r, np.uint8) for r in (a, b))
    if (x == 255).any() and (y == 255).any():
        return None
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(axis=0), y.reshape(-1, n).sum(axis=0)).sum())


def _prefixes(width: int, percent: int, often: np.ndarray, counts: np.ndarray, kind: pa.DataType):
    """Of each text its fingerprint, its shingles by residue, and the least of its shingles in an order that is one for all
    texts: by frequency, then by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, prints, sizes, firsts, residues = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), [], []
            for row, t in enumerate(b.column(2)):
                own = shingles(t.as_py(), width)
                nodes[row], prints[row], sizes[row] = _node(own), _fingerprint(own), len(own)
                residues.append(_residues(own))
                f = np.zeros(len(own), np.int64)
                if len(often) and len(own):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    f = np.where(often[at] == own, counts[at], 0)
                keep = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                firsts.append(own[np.lexsort((own, f))[:keep]].view(np.int64))
            columns = [b.column(0).cast(kind), b.column(1), pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(sizes), pa.array(residues, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "th", "node", "fp", "n", "residues", "prefix"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.as_py(), width) for t in b.column(0)]
            nodes = np.fromiter(map(_node, own), np.uint64, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["node", "codes"])

    return run


def _admitted(percent: int):
    """Rows a, b, na, nb, ra, rb -> the pairs (a, b) whose residues leave enough in common possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [_most_in_common(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)]
            total = (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()).tolist()
            keep = [m is None or m * (100 + percent) >= percent * t for m, t in zip(most, total, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, their counts) of those with the highest counts, as many counts as FREQUENT has room for."""
    least, held = 0, 0
    for c, n in sorted(((r.c, r.n) for r in counted.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > FREQUENT:
            least = c + 1
            break
    few = counted.where(F.col("c") >= least).toArrow()
    codes, counts = few.column("code").to_numpy().view(np.uint64), few.column("c").to_numpy()
    order = np.argsort(codes)
    return codes[order], counts[order]


def _across(spread: DataFrame, may) -> DataFrame:
    """(a, b) of the texts of different groups that share a shingle, where may(s, r) holds.

    spread: code, root, s (node, n, at, and others), main. Of a shingle's texts all but those of its main group meet those of any
    other group. Two texts meet at the first shingle that they share, and not again at one of which both have a common
    shingle among the MET before: a passage makes one row of a pair and not one per shingle.
    """
    met = F.collect_list("code").over(W.partitionBy("s.node").orderBy("s.at").rowsBetween(-MET, -1))
    told = materialise(spread.withColumn("met", met), "spread-shingles")
    left, right = told.where("root <> main"), told.select("code", F.col("root").alias("other"), F.col("s").alias("r"), F.col("met").alias("rmet"))
    once = (F.col("other") == F.col("main")) | (F.col("s.node") < F.col("r.node"))
    pairs = left.join(right, "code").where((F.col("root") != F.col("other")) & once & may("s", "r") & ~F.arrays_overlap("met", "rmet"))
    return pairs.select(F.least("s.node", "r.node").alias("a"), F.greatest("s.node", "r.node").alias("b"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, component_id) of every row; component_id is the smallest key reachable by links.

    Rows are linked if the sets of their width-word shingles have a Jaccard similarity of percent / 100 or more. No such
    pair is missed: two of these sets share a shingle among the first n - ceil(n * percent / 100) + 1 of each in any order
    that is one for all. The order puts shingles frequent in a sample last, so that few unlike texts meet. Texts
    without words are copies of one another. A null key is never the smallest while its component has another;
    repeated rows give repeated rows; an empty table gives none. Texts of any length are taken whole, one at a time.

    Candidates come in two rounds, each decided by the whole sets. First the links of the fingerprints' vantage trees, and of
    every shingle's texts to a few of them: pairs in proportion to the texts, which join most of a group. Then the pairs
    that share a shingle and are not joined yet, so that a large group never yields all its pairs.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).cast("binary").alias("t"))
    one_in = max(1, min(ONE_IN, df.count() // SAMPLE_DOCS))
    sample = rows.where(F.pmod(F.xxhash64("th"), F.lit(one_in)) == 0).select("t").mapInArrow(tidy(_codes(width)), "code bigint")
    often, counts = _frequent(materialise(sample.groupBy("code").agg(F.count("*").alias("c")).where("c > 1"), "frequent-shingles"))
    made = rows.mapInArrow(tidy(_prefixes(width, percent, often, counts, to_arrow_type(kind))), f"key {kind.simpleString()}, th bigint, node bigint, fp bigint, n int, residues binary, prefix array<bigint>")
    own = materialise(made, "shingle-prefixes")
    nodes = own.groupBy("node").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("th", "fp", "n", "residues", "prefix")])
    nodes = materialise(nodes, "shingle-nodes")

    def enough(common, size_a, size_b):
        return common.cast("bigint") * F.lit(100 + percent) >= F.lit(percent) * (size_a.cast("bigint") + size_b)

    def may(a: str, b: str):
        """The shingles from here on could be enough in common."""
        return enough(F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")), F.col(f"{a}.n"), F.col(f"{b}.n"))

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are similar enough. Whole sets travel only for pairs that sizes and residues admit."""
        few = nodes.select("node", "n", "residues")
        some = pairs.where("a <> b").distinct().join(few.toDF("a", "na", "ra"), "a").where("na > 0").join(few.toDF("b", "nb", "rb"), "b")
        some = some.where(enough(F.least("na", "nb"), F.col("na"), F.col("nb"))).select("a", "b", "na", "nb", "ra", "rb")
        some = materialise(some.mapInArrow(tidy(_admitted(percent)), "a bigint, b bigint"), f"{name}-pairs")
        wanted = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
        texts = materialise(nodes.join(wanted, "node", "left_semi").select("th"), f"{name}-texts")
        found = join_few(rows.select("th", "t"), texts, ["th"], "inner").dropDuplicates(["th"]).select("t")
        sets = materialise(found.mapInArrow(tidy(_sets(width)), "node bigint, codes array<bigint>"), f"{name}-sets")
        whole = some.join(sets.toDF("a", "ca"), "a").join(sets.toDF("b", "cb"), "b")
        return materialise(whole.where(enough(F.size(F.array_intersect("ca", "cb")), F.size("ca"), F.size("cb"))).select("a", "b"), f"{name}-links")

    places = nodes.select("node", "n", F.posexplode("prefix").alias("at", "code"))
    shared = places.withColumn("c", F.count("*").over(W.partitionBy("code"))).where("c > 1").drop("c")
    shared = materialise(shared, "shared-shingles")
    weight = shared.groupBy("node").agg(F.count("*").alias("w"))
    weighed = shared.join(weight, "node").select("code", F.struct("w", "node", "n", "at").alias("x"), F.struct(F.xxhash64("node", F.pmod("code", F.lit(ORDERS))).alias("w"), "node", "n", "at").alias("y"))
    heads = weighed.groupBy("code").agg(F.max("x").alias("x"), F.min("y").alias("y")).select("code", F.explode(F.array(F.struct("x.node", "x.n", "x.at"), F.struct("y.node", "y.n", "y.at"))).alias("h"))
    by_shingle = shared.select("code", F.struct("node", "n", "at").alias("s")).join(heads, "code").where(may("s", "h")).select(*ordered(F.col("s.node"), F.col("h.node")))
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")), "shingle-fingerprints")
    same = nodes.join(prints, "fp").select(*ordered(F.col("node"), F.col("head")))
    near = simhash.links(prints.select("fp")).toDF("x", "y")
    near = near.join(prints.toDF("x", "hx"), "x").join(prints.toDF("y", "hy"), "y").select(*ordered(F.col("hx"), F.col("hy")))
    roots = connected_components(links(by_shingle.union(same).union(near), "heads"))
    group = materialise(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "shingle-groups")

    spread = shared.join(group.select("node", "root"), "node").select("code", "root", F.struct("node", "n", "at").alias("s"))
    sizes = spread.groupBy("code", "root").agg(F.count("*").alias("c")).groupBy("code").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k"))
    spread = spread.join(sizes.where("k > 1").select("code", F.col("m.root").alias("main")), "code")
    more = links(_across(spread, may), "rest")
    of = group.select("node", "root")
    bridges = more.join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    joined = connected_components(bridges).toDF("root", "top")
    placed = group.join(joined, "root", "left").withColumn("top", F.coalesce("top", "root"))
    least = placed.groupBy("top").agg(F.min("least").alias("component_id"))
    component = placed.join(least, "top").select("node", "component_id")
    return own.select("key", "node").join(component, "node").select(F.col("key").alias(key), "component_id")
