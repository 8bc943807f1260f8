"""Vector code compression: product quantisation in integers, with norm-of-sum bounds that spare exact scans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from nodewell.llm.common import materialise
from nodewell.llm.negatives import integers, usable
from nodewell.llm.workers import tidy

BATCH = 4096  # rows whose distances are in memory at a time
SLACK = 1e-9  # relative margin for the rounding of square roots


@dataclass
class Codebooks:
    """history: per round the entries as integers (parts, entries, width of a part), the last ones being the result."""

    history: list[np.ndarray]

    @property
    def entries(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moves(self, now: int, since: int) -> tuple[np.ndarray, np.ndarray]:
        """How far each entry is in round `now` from its own place in round `since`, and how far any other entry of its part is.

        The norm of the sum of an entry's steps: an entry that went back has not moved, however long its way was."""
        own = np.sqrt(((self.history[now] - self.history[since]).astype(float) ** 2).sum(axis=2))
        if own.shape[1] < 2:
            return own, np.zeros_like(own)
        order = np.argsort(own, axis=1)
        first, second = order[:, -1:], order[:, -2:-1]
        others = np.where(np.arange(own.shape[1]) == first, np.take_along_axis(own, second, 1), np.take_along_axis(own, first, 1))
        return own, others


@dataclass
class State:
    """Per row and part: the entry, its distance when near_at was the round, the next entry's distance when next_at was the round,
    and how often all entries were looked at."""

    code: np.ndarray
    near: np.ndarray
    near_at: np.ndarray
    next: np.ndarray
    next_at: np.ndarray
    scans: np.ndarray

    KINDS = (("code", "uint8"), ("near", "float64"), ("near_at", "uint8"), ("next", "float64"), ("next_at", "uint8"), ("scans", "uint8"))

    @classmethod
    def unseen(cls, shape: tuple[int, int]) -> State:
        return cls(*(np.full(shape, np.inf if k == "near" else 0, t) for k, t in cls.KINDS))

    @classmethod
    def read(cls, cells: list[bytes], shape: tuple[int, int]) -> State:
        whole = np.frombuffer(b"".join(cells), np.dtype([(k, t, shape[1:]) for k, t in cls.KINDS]))
        return cls(*(whole[k].copy() for k, _ in cls.KINDS))

    def cells(self) -> pa.Array:
        whole = np.empty(len(self.code), np.dtype([(k, t, self.code.shape[1:]) for k, t in self.KINDS]))
        for k, _ in self.KINDS:
            whole[k] = getattr(self, k)
        return pa.array([x.tobytes() for x in whole], pa.binary())


def advance(x: np.ndarray, state: State, books: Codebooks, now: int) -> None:
    """Assigns every part of x (rows, parts, width) to its nearest entry of round `now`, of equals the first; state is changed in place.

    An entry stays nearest while its distance, grown by its own net move since it was measured, is below the next one's, lessened by
    the greatest net move of the other entries since that was measured. Where the bounds can't tell, the distance to the own entry is
    measured, and where that does not settle it, those to all entries. Squared distances are exact, as sums below 2**53
    in float64 or in 64-bit integers.
    """
    entries = books.history[now].astype(x.dtype)
    part = np.arange(x.shape[1])
    near_move, next_move = np.empty(state.code.shape), np.empty(state.code.shape)
    for since in range(now + 1):
        own, others = books.moves(now, since)
        for stamp, values, into in ((state.near_at, own, near_move), (state.next_at, others, next_move)):
            at = stamp == since
            into[at] = np.broadcast_to(values[part, state.code], at.shape)[at]
    reach = state.next - next_move - SLACK * np.where(np.isinf(state.next), 0, state.next + next_move)
    open_ = ~((state.near + near_move) * (1 + SLACK) < reach)
    r, p = np.nonzero(open_)
    state.near[r, p] = np.sqrt(((x[r, p] - entries[p, state.code[r, p]]) ** 2).sum(axis=1).astype(float))
    state.near_at[r, p] = now
    unsettled = ~(state.near[r, p] * (1 + SLACK) < reach[r, p])
    r, p = r[unsettled], p[unsettled]
    for k in part:
        rows = r[p == k]
        if len(rows):
            own, every = x[rows, k], entries[k]
            squares = (own**2).sum(axis=1)[:, None] - 2 * (own @ every.T) + (every**2).sum(axis=1)
            best = squares.argmin(axis=1)
            state.code[rows, k], state.near[rows, k] = best, np.sqrt(squares[np.arange(len(rows)), best].astype(float))
            if squares.shape[1] > 1:
                squares[np.arange(len(rows)), best] = squares.max(axis=1) + 1
                state.next[rows, k] = np.sqrt(squares.min(axis=1).astype(float))
            else:
                state.next[rows, k] = np.inf
            state.near_at[rows, k] = state.next_at[rows, k] = now
            state.scans[rows, k] += 1


def _vectors(cells: list[bytes], kind: str, parts: int, exact: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.dtype(kind)).reshape(len(cells), parts, -1).astype(exact)


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, Codebooks]:
    """((key, label, code, error, scans), codebooks): the code of each vector as bytes, one a part, and its squared distance.

    Vectors are taken as integers floor(scale * x) and cut into `parts` equal parts. A part's codebook starts as that part of the rows
    with the `entries` smallest keys (null keys last, of equal keys the vectors in order of their bytes); a round assigns all
    parts and sets each entry to the floor of its parts' mean, unused ones staying. Rows whose vector is null or has null or
    not finite components are left out; repeated rows count each; shorter vectors are filled up with zeros, as is a width that `parts` does not divide.
    An empty table gives none. At most 256 entries; components beyond some 2**29 raise ValueError.

    Each round is one pass over a written table, whose bounds the next one takes up; the driver holds the codebooks, and sums of
    parts * entries rows a task are all that is shuffled.
    """
    if not 1 <= entries <= 256 or not 1 <= rounds <= 250:
        raise ValueError("1 to 256 entries and 1 to 250 rounds can be had")
    given = df.select(F.col(key).alias("i"), F.col(label).alias("l"), integers(vector, scale).alias("v"), usable(vector).alias("ok")).where("ok").drop("ok")
    spread = F.max(F.coalesce(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))), F.lit(0.0)))
    width, largest = given.agg(F.max(F.size("v")), spread).first()
    width = parts * max(1, -(-(width or 0) // parts))
    largest = int(largest or 0)
    if 4 * width * largest * largest >= 1 << 62:
        raise ValueError(f"squared distances of {width} components up to {largest} may need more than 62 bits")
    kind = next(k for k in ("int8", "int16", "int32") if largest <= np.iinfo(k).max)
    exact = "float64" if 8 * width * largest * largest < 1 << 53 else "int64"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((b.num_rows, width), np.dtype(kind))
            v[np.arange(width) < b.column(2).value_lengths().to_numpy()[:, None]] = b.column(2).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary())], ["i", "l", "v"])

    own = f"i {df.schema[key].dataType.simpleString()}, l {df.schema[label].dataType.simpleString()}, v binary"
    packed = materialise(given.mapInArrow(pack, own), "code-vectors")
    first = packed.orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()
    start = _vectors([bytes(r.v) for r in first], kind, parts, "int64") if first else np.zeros((0, parts, width // parts), np.int64)
    books = Codebooks([start.transpose(1, 0, 2)])
    if not first:
        return packed.selectExpr("i", "l", "v as code", "cast(0 as bigint) as error", "cast(0 as bigint) as scans").toDF(key, label, "code", "error", "scans"), books
    state = packed.withColumn("state", F.lit(None).cast("binary"))
    for now in range(rounds + 1):
        state = materialise(_assigned(state, own, books, now, kind, exact, parts), "code-states")
        if now < rounds:
            books.history.append(_means(state, books, kind, exact, parts))
    return _finished(state, own, books, kind, parts).toDF(key, label, "code", "error", "scans"), books


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _assigned(df: DataFrame, own: str, books: Codebooks, now: int, kind: str, exact: str, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            x = _vectors(b.column(2).to_pylist(), kind, parts, exact)
            state = State.unseen(x.shape[:2]) if now == 0 else State.read(b.column(3).to_pylist(), x.shape[:2])
            advance(x, state, books, now)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], state.cells()], ["i", "l", "v", "state"])

    return df.mapInArrow(tidy(run), own + ", state binary")


def _means(df: DataFrame, books: Codebooks, kind: str, exact: str, parts: int) -> np.ndarray:
    """The entries of the next round: floors of the means, summed in each task first."""
    before = books.entries
    _, entries, width = before.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in _batches(batches):
            x = _vectors(b.column(0).to_pylist(), kind, parts, "int64")
            at = (State.read(b.column(1).to_pylist(), x.shape[:2]).code + np.arange(parts) * entries).ravel()
            counts += np.bincount(at, minlength=len(counts))
            for d in range(width):
                values = x[:, :, d].ravel()
                if exact == "float64":  # sums of a batch are below 2**53 too
                    sums[:, d] += np.bincount(at, values, len(counts)).astype(np.int64)
                else:
                    np.add.at(sums[:, d], at, values)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"e": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64()), "s": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    told = df.select("v", "state").mapInArrow(tidy(run), "e bigint, n bigint, s array<bigint>")
    total = told.select("e", "n", F.posexplode("s").alias("d", "s")).groupBy("e", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = before.reshape(parts * entries, width).copy()
    for r in total.collect():
        out[r.e, r.d] = int(r.s) // r.n
    return out.reshape(before.shape)


def _finished(df: DataFrame, own: str, books: Codebooks, kind: str, parts: int) -> DataFrame:
    """Codes, exact errors and numbers of scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            x = _vectors(b.column(2).to_pylist(), kind, parts, "int64")
            state = State.read(b.column(3).to_pylist(), x.shape[:2])
            error = ((x - books.entries[np.arange(parts), state.code]) ** 2).sum(axis=(1, 2))
            code = pa.array([c.tobytes() for c in state.code], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], code, pa.array(error, pa.int64()), pa.array(state.scans.sum(axis=1, dtype=np.int64), pa.int64())], ["i", "l", "code", "error", "scans"])

    return df.mapInArrow(tidy(run), own.replace("v binary", "code binary") + ", error bigint, scans bigint")


def restored(codes: DataFrame, books: Codebooks, code: str = "code", name: str = "vector", scale: int = 256) -> DataFrame:
    """codes with the vectors that they stand for: the middles of the integer cells, over scale. A column `name` is replaced."""
    codes = codes.drop(name)
    at, entries = codes.columns.index(code), (books.entries + 0.5) / scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            known = [None if c is None else entries[np.arange(len(entries)), np.frombuffer(c, np.uint8)].ravel().tolist() for c in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known, pa.list_(pa.float64()))], [*b.schema.names, name])

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + f", `{name}` array<double>")


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error: the errors of all rows of its label, nulls being one label, summed.

    Labels with more than a thousandth of the rows, which are fewer than a thousand, are broadcast; the others, none of them hot, are joined."""
    sums = materialise(codes.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    total: Row = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    is_hot = F.col("_n") * 1000 > total.n
    hot = sums.where(is_hot).select("_l", "label_error", F.lit(True).alias("_hot"))
    same = codes[label].eqNullSafe(F.col("_l"))
    told = codes.join(F.broadcast(hot), same, "left").drop("_l")
    done = told.where("_hot").drop("_hot")
    rest = told.where("_hot is null").drop("_hot", "label_error")
    return done.unionByName(rest.join(sums.where(~is_hot).select("_l", "label_error"), rest[label].eqNullSafe(F.col("_l"))).drop("_l"))
