"""SimHash near-duplicates: fingerprints, vantage-point shards, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nodewell.llm.common import connected_components, materialise
from nodewell.llm.workers import tidy

BITS, RADIUS = 64, 3
#: The vantage trees are fitted on so many distinct fingerprints per shard, an eighth of them and MAX_FIT_ROWS (32 MB) at
#: most; all of them are searched.
FIT_ROWS, MAX_FIT_ROWS = 64, 4_000_000
#: Fingerprints that a shard should hold.
SHARD_ROWS = 50_000
#: Either half of two fingerprints within 3 bits differs in at most 1 bit, for one half at least. A table looks at its
#: half with radius 1, and at all bits with radius 3 where the half no longer tells the fingerprints apart.
HALVES = (np.uint64(0x00000000FFFFFFFF), np.uint64(0xFFFFFFFF00000000))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the word shingles, repeats included. No words: 0."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        parts = zip(*[words[i : i + n] for i in range(shingle)], strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(seed)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("binary").alias("_t")).mapInArrow(tidy(run), f"`{key}` {kind}, fp bigint")


# Vantage-point trees. A node is (mask, radius, vantage point, m, inner, outer): inner holds what differs from the
# vantage point in at most m of the mask's bits; a leaf is its number.


def _split(fps: np.ndarray, half: np.uint64, least: float) -> tuple | None:
    """The (mask, radius, v, m) under which the fewest fingerprints lie so near the border that they go to both sides."""
    best = None
    for mask, radius in ((half, 1), (WHOLE, RADIUS)):
        for v in fps[:: max(1, len(fps) // 12)][:12]:
            d = np.bitwise_count((fps ^ v) & mask)
            counts = np.bincount(d, minlength=BITS + 1)
            inner = np.cumsum(counts) / len(fps)
            m = int(np.argmin(np.abs(inner - 0.5)))
            if least <= inner[m] <= 1 - least:
                both = counts[max(0, m + 1 - radius) : m + radius + 1].sum() / len(fps)
                if best is None or both < best[0]:
                    best = (both, mask, radius, v, m)
        if best is not None:
            return best[1:]
    return None


def fit_tree(sample: np.ndarray, half: np.uint64, levels: int, first: int = 0) -> tuple:
    """(tree, number of leaves after it); leaves count from first."""
    node = _split(sample, half, 0.1) if levels > 0 and len(sample) >= 32 else None
    if node is None:
        return first, first + 1
    mask, radius, v, m = node
    near = np.bitwise_count((sample ^ v) & mask) <= m
    inner, after = fit_tree(sample[near], half, levels - 1, first)
    outer, after = fit_tree(sample[~near], half, levels - 1, after)
    return (mask, radius, v, m, inner, outer), after


def route(tree, fps: np.ndarray, at: np.ndarray, wide: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions): the leaf of each fingerprint, or if wide every leaf that its ball reaches by the triangle bounds."""
    if not isinstance(tree, tuple):
        yield tree, at
        return
    mask, radius, v, m, inner, outer = tree
    d = np.bitwise_count((fps[at] ^ v) & mask).astype(np.int64)
    r = radius if wide else 0
    if (near := at[d <= m + r]).size:
        yield from route(inner, fps, near, wide)
    if (far := at[d > m - r]).size:
        yield from route(outer, fps, far, wide)


def near_pairs(data: np.ndarray, queries: np.ndarray, half: np.uint64, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position in data, position in queries) of all pairs within radius bits that the half's bounds admit."""

    def go(d: np.ndarray, q: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = _split(data[d], half, 0.2) if d.size > 48 and d.size * q.size > 1 << 14 and depth < 40 else None
        if node is None:
            step = max(1, (1 << 19) // max(1, d.size))
            for i in range(0, q.size, step):
                found = np.nonzero(np.bitwise_count(data[d][None, :] ^ queries[q[i : i + step]][:, None]) <= radius)
                yield d[found[1]], q[i : i + step][found[0]]
            return
        mask, r, v, m = node
        dd = np.bitwise_count((data[d] ^ v) & mask).astype(np.int64)
        dq = np.bitwise_count((queries[q] ^ v) & mask).astype(np.int64)
        yield from go(d[dd <= m], q[dq <= m + r], depth + 1)
        yield from go(d[dd > m], q[dq > m - r], depth + 1)

    if data.size and queries.size:
        yield from go(np.arange(data.size), np.arange(queries.size), 0)


def spanning_links(data: np.ndarray, queries: np.ndarray, half: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join exactly what the pairs within the radius join; one per fingerprint at most."""
    nodes, inverse = np.unique(np.concatenate([data, queries]), return_inverse=True)
    of_data, of_query = inverse[: data.size], inverse[data.size :]
    parent = np.arange(nodes.size)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label = parent.copy()
    for d, q in near_pairs(data, queries, half):
        a, b = label[of_data[d]], label[of_query[q]]
        if not (a != b).any():
            continue
        for x, y in np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent.copy()
    own = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[own], nodes[label[own]]


def _grafted(tree, at: dict[int, tuple]):
    """tree with other trees in place of some leaves."""
    if not isinstance(tree, tuple):
        return at.get(tree, tree)
    return (*tree[:4], _grafted(tree[4], at), _grafted(tree[5], at))


def _homes(fps: DataFrame, trees: list) -> DataFrame:
    """(shard, fp): each fingerprint with its leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            for tree in trees:
                for leaf, at in route(tree, signed.view(np.uint64), np.arange(signed.size), False):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, leaf, np.int32)), pa.array(signed[at])], ["shard", "fp"])

    return fps.select("fp").mapInArrow(tidy(run), "shard int, fp bigint")


def fit_trees(fps: DataFrame, shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS, max_fit_rows: int = MAX_FIT_ROWS, rounds: int = 8) -> tuple[list, list[int]]:
    """(a tree per half, the tree of each leaf). Fitted on a bounded sample, in proportion to the shards; then the leaves' rows are
    counted, and leaves of over twice shard_rows are fitted again on rows of their own, as clustered fingerprints fall unevenly. A
    leaf stays large only if no vantage point parts its sample."""
    total = fps.count()
    levels = max(0, int(np.ceil(np.log2(max(1, total) / shard_rows))))
    n_fit = min(fit_rows << levels, total // 8, max_fit_rows) if levels else 0
    chosen = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(total)) < 2 * n_fit).orderBy(F.xxhash64("fp"), "fp").limit(n_fit)
    sample = chosen.toArrow().column(0).to_numpy().view(np.uint64) if levels else np.empty(0, np.uint64)
    trees, tree_of = [], []
    for n, half in enumerate(HALVES):
        tree, after = fit_tree(sample, half, levels, len(tree_of))
        trees.append(tree)
        tree_of += [n] * (after - len(tree_of))
    closed: set[int] = set()
    for _ in range(rounds if levels else 0):
        homes = _homes(fps, trees)
        large = {r.shard: r["count"] for r in homes.groupBy("shard").count().where(F.col("count") > 2 * shard_rows).collect() if r.shard not in closed}
        if not large:
            break
        # Twice fit_rows for each of its shards to be, by hash; so the driver holds a share of the large leaves, max_fit_rows in all.
        share = min(1.0, 2 * fit_rows / shard_rows, max_fit_rows / sum(large.values()))
        hashed = F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))
        rows = homes.where(F.col("shard").isin(list(large)) & hashed).toArrow().to_pandas()
        grafts: dict[int, tuple] = {}
        for leaf, own in rows.groupby("shard")["fp"]:
            n = tree_of[leaf]
            tree, after = fit_tree(np.sort(own.to_numpy()).view(np.uint64), HALVES[n], int(np.ceil(np.log2(large[leaf] / shard_rows))), len(tree_of))
            if isinstance(tree, tuple):
                grafts[leaf] = tree
                tree_of += [n] * (after - len(tree_of))
        closed |= large.keys() - grafts.keys()
        trees = [_grafted(t, grafts) for t in trees]
    return trees, tree_of


def links(fps: DataFrame, shard_rows: int = SHARD_ROWS, fit_rows: int = FIT_ROWS, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that differ in 3 bits or fewer.

    Two vantage trees, one per half; see fit_trees. Each fingerprint goes to its own leaf and, as a query, to every leaf whose
    border its ball crosses; each leaf is one group of about shard_rows fingerprints and is searched by a tree of its own. A leaf
    gives a spanning forest of its links, not all its pairs.
    """
    trees, tree_of = fit_trees(fps, shard_rows, fit_rows, max_fit_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            own, everything = signed.view(np.uint64), np.arange(signed.size)
            for tree in trees:
                home = np.full(signed.size, -1)
                for leaf, at in route(tree, own, everything, False):
                    home[at] = leaf
                for leaf, at in route(tree, own, everything, True):
                    n = at.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, leaf, np.int32)), pa.array(signed[at]), pa.array(home[at] == leaf)], ["shard", "fp", "home"]
                    )

    def search(table: pa.Table) -> pa.Table:
        half = HALVES[tree_of[table.column("shard")[0].as_py()]]
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = spanning_links(fp[home], fp, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(tidy(deal), "shard int, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every row.

    Rows are linked if their fingerprints differ in 3 bits or fewer; component_id is the smallest key reachable.
    Null and empty texts have fingerprint zero and are linked like any other. A null key is never the smallest
    while its component has another; repeated rows give repeated rows; an empty table gives none. Texts of any length
    are taken whole, one at a time.
    """
    own = materialise(fingerprints(df, key, text, shingle), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(least, "root").select("fp", "component_id")
    return own.join(component, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
