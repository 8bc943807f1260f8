"""Vector expressions, and the helpers for wide batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """0 if a norm is 0, unless epsilon is added to the norms. Worked out in double."""
    scale = (norm(a) + epsilon) * (norm(b) + epsilon)
    return F.when((a.isNull()) | (b.isNull()), None).when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(scale, F.lit(0.0)))


def unit(a: Column) -> Column:
    """a over its norm; zeros stay."""
    return F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, F.lit(0.0)).otherwise(x / s["n"])))[0]


def sum_vectors(vectors: Column, width: Column) -> Column:
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def mean_pair_cosine(vectors: Column) -> Column:
    """Mean cosine over all pairs i < j of an array of vectors; null for fewer than two. In closed form: for unit vectors
    u the pairs sum to (|sum u|^2 - sum |u|^2) / 2, where zero vectors give nothing, as their cosine is 0."""
    units = F.transform(vectors, unit)
    n = F.size(vectors)

    def value(u: Column) -> Column:
        total = sum_vectors(u, F.size(F.get(u, F.lit(0))))
        own = F.aggregate(F.transform(u, lambda v: dot(v, v)), F.lit(0.0), lambda s, x: s + x)
        return (dot(total, total) - own) / (n * (n - 1))

    return F.when(n >= 2, F.transform(F.array(units), value)[0])


@F.pandas_udf(T.DoubleType())
def cosine_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """cosine_similarity for wide vectors of one width, a batch at a time."""
    x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
    scale = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.where(scale == 0, 0.0, np.einsum("ij,ij->i", x, y) / np.where(scale == 0, 1.0, scale)))


def _rows_of(table: pa.Table, codes: np.ndarray) -> tuple[dict[tuple[int, int], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """The rows of each code and width of vector, and what gives rows of one width as a matrix of unit vectors."""
    v = table["_v"].combine_chunks()
    width = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    start, values = np.cumsum(width) - width, v.flatten().to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((width, codes))
    cuts = np.flatnonzero(np.diff(codes[order]) | np.diff(width[order])) + 1
    rows = {(int(codes[own[0]]), int(width[own[0]])): own for own in np.split(order, cuts) if len(own)}

    def units(own: np.ndarray) -> np.ndarray:
        x = values[start[own][:, None] + np.arange(width[own[0]])]
        return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-12)

    return rows, units


def cosines(a: pa.Table, b: pa.Table) -> pa.Table:
    """The vectors _v of a, each with its largest and its summed cosine (1e-12 is added to norms) to the vectors of b that have its key _k
    and count _n times; how many these are; and how many of its key have no cosine with it, by a null (_whole is false) or
    their width. Vectors without any of their key are left out."""
    keys = pa.concat_arrays([t["_k"].combine_chunks() for t in (a, b)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes, times, whole = keys[len(a) :], b["_n"].to_numpy(), b["_whole"].to_numpy()
    queries, q_units = _rows_of(a, keys[: len(a)])
    known, c_units = _rows_of(b, codes)
    total = np.bincount(codes, times, 1 + int(keys.max(initial=0))).astype(np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for (code, width), own in queries.items():
        if total[code]:
            other = known.get((code, width), codes[:0])
            other = other[whole[other]]
            weight, most, summed = times[other], np.zeros(len(own)), np.zeros(len(own))
            if len(other):
                c = c_units(other).T
                for at in range(0, len(own), 512):
                    s = q_units(own[at : at + 512]) @ c
                    most[at : at + 512], summed[at : at + 512] = s.max(axis=1), s @ weight
            n = np.full(len(own), weight.sum())
            parts.append((own, most, summed, n, total[code] - n))
    own, most, summed, n, odd = (np.concatenate(p) for p in zip(*parts, strict=True))
    return pa.table({"_k": a["_k"].take(own), "_v": a["_v"].take(own), "_max": pa.array(most, mask=n == 0), "_sum": summed, "_n": n, "_odd": odd})


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """df with the vectors of a text column; model takes a batch of texts and is called in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: list(np.asarray(model(b[text].fillna("").tolist()), dtype=np.float32))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` array<float>"
    return df.mapInPandas(run, schema)


def _cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """df (i, v) with cell, the nearest of the centres, and away, the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy()).astype(float)
                cell = np.concatenate([((centres**2).sum(1) - 2 * x[at : at + 1024] @ centres.T).argmin(axis=1) for at in range(0, len(x), 1024)])
                yield b.assign(cell=cell, away=np.sqrt(((x - centres[cell]) ** 2).sum(1)))

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, away double")


def near_cells(centres: np.ndarray, sizes: np.ndarray, k: int) -> list[list[int]]:
    """Per cell the cells nearest to its centre that hold k vectors together, or all."""
    order = np.argsort(((centres[:, None] - centres) ** 2).sum(axis=2) if len(centres) <= 256 else np.stack([((c - centres) ** 2).sum(axis=1) for c in centres]), axis=1, kind="stable")
    return [own[: int(np.searchsorted(np.cumsum(sizes[own]), k)) + 1].tolist() for own in order]


def open_cells(centres: np.ndarray, q_radius: np.ndarray, c_radius: np.ndarray, limit: np.ndarray, done: list[list[int]]) -> list[tuple[int, int]]:
    """Pairs of cells, not yet done, that may hold a vector within limit of a query: distances between centres less both radii."""
    out = []
    for q, own in enumerate(done):
        if q_radius[q] >= 0:
            apart = np.sqrt(((centres[q] - centres) ** 2).sum(axis=1)) - q_radius[q] - c_radius
            near = (apart <= limit[q] + 1e-9 * (1 + np.abs(limit[q]))) & (c_radius >= 0)
            near[own] = False
            out += [(q, c) for c in np.flatnonzero(near).tolist()]
    return out


def topk_l2(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", corpus_id: str = "corpus_id", vector: str = "embedding", block_rows: int = 20_000, max_cells: int = 1024, told: dict | None = None
) -> DataFrame:
    """(query_id, rank, corpus_id, distance): the k nearest corpus vectors by squared L2, exactly; equal distances by corpus_id.

    Up to max_cells corpus vectors, the ones with the least hashes, are centres of cells of some block_rows vectors, and queries
    fall into the same cells. The queries of a cell first meet the cells nearest to its centre that hold k vectors; the farthest
    k-th distance found there bounds the others: a pair of cells is left out if its centres less both radii are farther apart. Cells
    beyond block_rows are cut by hash; each pair of blocks is one group, a matrix product that keeps its own best k, and these
    meet in a window per query. Null vectors are left out. told, if given, gets the numbers of met and all pairs of cells.
    """
    c = corpus.where(F.col(vector).isNotNull()).select(F.col(corpus_id).alias("i"), F.col(vector).alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("i"), F.col(vector).alias("v"))
    n_c = c.count()
    n_cells = min(max_cells, -(-n_c // block_rows))
    if n_cells > 1:
        hashed = F.pmod(F.xxhash64("i", F.lit(3)), F.lit(max(1, n_c // (4 * n_cells)))) == 0
        chosen = c.where(hashed).orderBy(F.xxhash64("i", F.lit(3)), "i").limit(n_cells).collect()
        centres = np.unique(np.array([r.v for r in chosen], float), axis=0) if chosen else np.zeros((1, len(c.first().v)))
        c, q = _cells(c, centres), _cells(q, centres)
    else:
        centres = np.zeros((1, 1))
        c, q = (df.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")) for df in (c, q))
    size, radius = {}, {}
    for side, df in (("q", q), ("c", c)):
        size[side], radius[side] = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
        for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
            size[side][r.cell], radius[side][r.cell] = r.n, r.r
    blocks = {s: np.maximum(1, -(-n // block_rows)) for s, n in size.items()}
    spark = corpus.sparkSession
    id_type, q_type = corpus.schema[corpus_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    met = 0

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({x: np.array([], dtype=object) for x in "qcde"})
        b = b.sort_values("i", kind="stable")
        x, y = np.stack(a["v"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float)
        parts, take = [], min(k, len(y))
        for at in range(0, len(x), 512):
            own = x[at : at + 512]
            rough = (own**2).sum(1)[:, None] + (y**2).sum(1) - 2 * own @ y.T
            limit = np.partition(rough, take - 1, axis=1)[:, take - 1]
            r, c = np.nonzero(rough <= limit[:, None] + 1e-6 * (1 + np.abs(limit[:, None])))  # ties, and what rounding may have hidden
            d = ((own[r] - y[c]) ** 2).sum(1)
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < take
            parts.append(pd.DataFrame({"q": a["i"].to_numpy()[at + r[keep]], "c": b["i"].to_numpy()[c[keep]], "d": d[keep], "e": a["cell"].to_numpy()[at + r[keep]]}))
        return pd.concat(parts)

    def meet(pairs: list[tuple[int, int]]) -> DataFrame:
        """The best of each pair of blocks of the cells."""
        nonlocal met
        pairs = [(a, b) for a, b in pairs if size["q"][a] and size["c"][b]]
        met += len(pairs)
        rows = [(a, b, int(blocks["q"][a]), int(blocks["c"][b])) for a, b in pairs]

        def side(df: DataFrame, own: str, other: str) -> DataFrame:
            cut = F.pmod(F.xxhash64("i"), F.col(f"n{own}")).cast("int")
            table = spark.createDataFrame(rows, "qc int, cc int, nq int, nc int")
            return df.join(F.broadcast(table), F.col("cell") == F.col(f"{own}c")).select("i", "v", "cell", "qc", "cc", cut.alias(f"{own}b"), F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(f"{other}b"))

        group = ["qc", "cc", "qb", "cb"]
        return side(q, "q", "c").groupBy(*group).cogroup(side(c, "c", "q").groupBy(*group)).applyInPandas(search, f"q {q_type}, c {id_type}, d double, e int")

    first = near_cells(centres, size["c"], k)
    near = meet([(a, b) for a, own in enumerate(first) for b in own])
    if len(centres) > 1:
        rank = F.row_number().over(W.partitionBy("q").orderBy("d", "c"))
        last = near.withColumn("rank", rank).where(F.col("rank") == k).groupBy("e").agg(F.max("d").alias("d"), F.count("*").alias("n"))
        limit = np.full(len(centres), np.inf)
        for r in last.collect():
            if r.n == size["q"][r.e]:  # every query of the cell has found k
                limit[r.e] = np.sqrt(r.d)
        near = near.unionByName(meet(open_cells(centres, radius["q"], radius["c"], limit, first)))
    if told is not None:
        told.update(met=met, pairs=int((size["q"] > 0).sum() * (size["c"] > 0).sum()))
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "c"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", F.col("c").alias(corpus_id), F.col("d").alias("distance"))
