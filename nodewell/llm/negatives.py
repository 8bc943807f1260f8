"""Hard-negative mining: exact integer scores by residue-number-system products in float32, then windowed selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nodewell.llm.common import materialise
from nodewell.llm.workers import tidy

BLOCK_ANCHORS = 512  # anchors that travel and are multiplied together
BLOCK_ROWS = 4096  # rows that are multiplied together
BUCKET_BYTES = 32 << 20  # vectors that one task holds


def usable(vector: str) -> Column:
    """Whether a vector has a value: not null, and no component null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def primes_for(width: int, largest: int) -> list[int]:
    """Few primes whose product is over twice the greatest score that vectors of `width` components up to `largest` can
    have. Products of their centred residues add up below 2**24, so float32 holds them exactly.

    Raises ValueError where scores may not fit into 61 bits, or where vectors are too wide for residues of small primes."""
    bound = 2 * width * largest * largest + 1
    if bound >= 1 << 62:
        raise ValueError(f"scores of vectors of {width} components up to {largest} may need more than 61 bits")
    top = 2 * int(((1 << 24) / width) ** 0.5)
    able = [p for p in range(3, top) if all(p % d for d in range(2, int(p**0.5) + 1)) and width * (p // 2) ** 2 < 1 << 24]
    chosen, product = [], 1
    for p in reversed(able):
        if product > bound:
            # The last one need not be larger than it takes, so the product stays within 63 bits.
            product //= chosen.pop()
            chosen.append(next(q for q in able if q not in chosen and product * q > bound))
            return chosen
        chosen.append(p)
        product *= p
    raise ValueError(f"vectors of {width} components up to {largest} are too wide for float32")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as float32 between -(p - 1) / 2 and (p - 1) / 2."""
    r = np.mod(x.astype(np.int64), p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed 64-bit products of the rows of a and of b, given as residues by prime: one float32 product per prime, the digits of
    the mixed radix by Garner's form of Chinese remaindering, and the upper half of the range taken as negative."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        own = np.mod((a[k] @ b[k].T).astype(np.int32), p).astype(np.int64)
        for d, q in zip(digits, primes, strict=False):
            own = (own - d) * pow(q, -1, p) % p
        digits.append(own)
    value, radix = digits[0], 1
    for d, p in zip(digits[1:], primes, strict=False):
        radix *= p
        value = value + d * radix
    whole = radix * primes[-1]
    return np.where(value > whole // 2, value - whole, value)


def _packed(df: DataFrame, width: int, kind: str) -> DataFrame:
    """(i, l, v) with the vectors as bytes, shorter ones filled up with zeros; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((b.num_rows, width), np.dtype(kind))
            sizes = b.column(2).value_lengths().to_numpy()
            v[np.arange(width) < sizes[:, None]] = b.column(2).flatten().to_numpy()
            yield pa.record_batch({"i": b.column(0), "l": b.column(1), "v": pa.array([x.tobytes() for x in v], pa.binary())})

    return df.mapInArrow(run, "i bigint, l bigint, v binary").distinct()


FOUND = "array<struct<p: bigint, s: bigint>>"


def _blocks(anchors: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_ANCHORS rows of (a, i, l, v, found): numbers, ids, labels and vectors as bytes, and what was found for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ANCHORS):
                part = b.slice(at, BLOCK_ANCHORS)
                numbers = {c: pa.array([part.column(k).to_numpy().tobytes()], pa.binary()) for k, c in enumerate("ail")}
                found = pa.array([part.column(4).to_pylist()], pa.list_(part.schema.field(4).type))
                yield pa.record_batch({**numbers, "v": pa.array([b"".join(part.column(3).to_pylist())], pa.binary()), "found": found})

    return anchors.select("a", "i", "l", "v", "found").mapInArrow(run, f"a binary, i binary, l binary, v binary, found array<{FOUND}>")


class _Rows:
    """The rows of one bucket, in order of their ids."""

    def __init__(self, i: np.ndarray, l: np.ndarray, v: np.ndarray, primes: list[int]) -> None:
        order = np.argsort(i, kind="stable")
        self.i, self.l, self.v, self.primes = i[order], l[order], v[order], primes

    def scored(self, v: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Scores of the vectors v with every BLOCK_ROWS rows."""
        a = [residues(v, p) for p in self.primes]
        for at in range(0, len(self.i), BLOCK_ROWS):
            own = slice(at, at + BLOCK_ROWS)
            yield own, products(a, [residues(self.v[own], p) for p in self.primes], self.primes)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, of equals the first ones, in that order."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > limit)
        places = np.sort(np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]]))
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")]


def _positives(rows: _Rows, i: np.ndarray, l: np.ndarray, v: np.ndarray, _: list, k: int) -> tuple[list, list, list, list]:
    """(place of the anchor, 0, row, score): the bucket's best k other rows of each anchor's label."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for own, scores in rows.scored(v):
        same = l[:, None] == rows.l[own]
        for a, n in zip(*np.nonzero((i[:, None] == rows.i[own]) & same), strict=True):
            same[a, n] = not (rows.v[own][n] == v[a]).all()  # no row is its own positive
        for a in range(len(i)):
            at = np.flatnonzero(same[a])
            _add(out, a, 0, rows.i[own], scores[a], at[_first(scores[a, at], k)])
    return out


def _negatives(rows: _Rows, i: np.ndarray, l: np.ndarray, v: np.ndarray, found: list, k: int, low: int, high: int) -> tuple[list, list, list, list]:
    """(place of the anchor, place of the positive, row, score): the bucket's first k rows of other labels in the window of each positive."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for own, scores in rows.scored(v):
        other = l[:, None] != rows.l[own]
        for a, positives in enumerate(found):
            for place, p in enumerate(positives):
                lowest, highest = -(-low * p["s"] // 100), high * p["s"] // 100
                if lowest <= highest:
                    at = np.flatnonzero(other[a] & (scores[a] >= lowest) & (scores[a] <= highest))
                    _add(out, a, place, rows.i[own], scores[a], at[_first(scores[a, at], k)])
    return out


def _add(out: tuple[list, list, list, list], a: int, place: int, ids: np.ndarray, scores: np.ndarray, best: np.ndarray) -> None:
    for column, values in zip(out, ([a] * len(best), [place] * len(best), ids[best].tolist(), scores[best].tolist()), strict=True):
        column.extend(values)


def _search(rows: DataFrame, anchors: DataFrame, buckets: int, width: int, kind: str, primes: list[int], find) -> DataFrame:
    """(a, i, place, p, ps, n, s): find() of every block of anchors with every bucket of rows; p and ps are what was found before at place.

    A task takes in a bucket's rows first, BUCKET_BYTES of vectors, then the anchors stream by in blocks: only these are copied, once a bucket."""
    base = materialise(_blocks(anchors), "anchor-blocks")
    streamed = base.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("b"), F.lit(1).alias("is_anchor"), F.lit(None).cast("bigint").alias("ri"), F.lit(None).cast("bigint").alias("rl"), "*")
    held = rows.select(F.pmod(F.xxhash64("i", "l", "v"), F.lit(buckets)).cast("int").alias("b"), F.lit(0).alias("is_anchor"), F.col("i").alias("ri"), F.col("l").alias("rl"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, known = None, [], None
        for b in batches:
            place = b.column("b").to_numpy().astype(np.int64) * 2 + b.column("is_anchor").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), b.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                now, is_anchor = divmod(int(place[at]), 2)
                if now != bucket:
                    bucket, parts, known = now, [], None
                piece = b.slice(at, end - at)
                if not is_anchor:
                    vectors = np.frombuffer(b"".join(piece.column("v").to_pylist()), np.dtype(kind)).reshape(-1, width)
                    parts.append((piece.column("ri").to_numpy(), piece.column("rl").to_numpy(), vectors))
                    continue
                if known is None and parts:
                    known, parts = _Rows(*(np.concatenate(x) for x in zip(*parts, strict=True)), primes), []
                if known is not None:
                    for block in piece.select(["a", "i", "l", "v", "found"]).to_pylist():
                        yield met(known, block)

    def met(known: _Rows, block: dict) -> pa.RecordBatch:
        a, i, l = (np.frombuffer(block[c], np.int64) for c in "ail")
        v, found = np.frombuffer(block["v"], np.dtype(kind)).reshape(-1, width), block["found"]
        who, place, n, s = find(known, i, l, v, found)
        at = np.array(who, dtype=int)
        before = [found[x][y] if y < len(found[x]) else {"p": None, "s": None} for x, y in zip(who, place, strict=True)]
        columns = {"a": a[at], "i": i[at], "place": place, "p": [x["p"] for x in before], "ps": [x["s"] for x in before], "n": n, "s": s}
        return pa.record_batch({c: pa.array(x, pa.int64()) for c, x in columns.items()})

    both = streamed.unionByName(held, allowMissingColumns=True).repartitionById(buckets, "b").sortWithinPartitions("b", "is_anchor")
    return both.mapInArrow(tidy(run), ", ".join(f"{c} bigint" for c in ("a", "i", "place", "p", "ps", "n", "s")))


def hard_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of df that is an anchor and each of
    its first `positives` other rows of the same label, the first `negatives` rows of other labels whose scores are from
    window[0] to window[1] hundredths of the positive's.

    Scores are integer inner products of floor(scale * x); greater scores come first, of equals the smaller key. Rows with a null key
    or label, or a vector that is null or has null or not finite components, take no part. Repeated rows (same key, label and vector)
    are one row; rows that share only the key are rows of their own. Shorter vectors are as if filled up with zeros.
    Ties at the last place go by the key; an empty table gives none. Scores that need more than 61 bits raise ValueError.

    All rows meet all anchors, in blocks. Each bucket yields its own first rows, and these meet in a window per anchor; the anchors'
    number bounds neither a task nor the driver.
    """
    given = df.select(F.col(key).cast("bigint").alias("i"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("l"), integers(vector, scale).alias("v"), usable(vector).alias("ok"), is_anchor.alias("anchor"))
    given = given.where(F.col("ok") & F.col("i").isNotNull() & F.col("l").isNotNull())
    spread = F.max(F.coalesce(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))), F.lit(0.0)))
    n, width, largest = given.agg(F.count("*"), F.max(F.size("v")), spread).first()
    width, largest = max(1, width or 1), int(largest or 0)
    primes = primes_for(width, largest)
    kind = next((k for k in ("int8", "int16", "int32") if largest <= np.iinfo(k).max), "int64")
    rows = materialise(_packed(given.select("i", "l", "v"), width, kind), "vectors")
    own = materialise(_packed(given.where("anchor").select("i", "l", "v"), width, kind).withColumn("a", F.monotonically_increasing_id()), "anchors")
    size = max(1, -(-n * width * np.dtype(kind).itemsize // BUCKET_BYTES))
    buckets = max(size, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)))
    near = _search(rows, own.withColumn("found", F.array().cast(FOUND)), buckets, width, kind, primes, lambda *x: _positives(*x, positives))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "n"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= positives).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("n").alias("p"), "s"))).alias("best"))
    told = own.join(best, "a").withColumn("found", F.transform("best", lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s"))))
    met = _search(rows, told, buckets, width, kind, primes, lambda *x: _negatives(*x, negatives, *window))
    rank = F.row_number().over(W.partitionBy("a", "place").orderBy(F.desc("s"), "n"))
    out = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select(F.col("i").alias("anchor_id"), F.col("p").alias("positive_id"), "rank", F.col("n").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("s").alias("negative_score"))
