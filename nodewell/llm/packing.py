"""Best-fit packing of token sequences: tokenise, plan on the histogram of lengths, place by rank."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from nodewell.llm.common import materialise
from nodewell.llm.workers import Kept, tidy

#: Separators that str.split() knows but the tokenizers' \s does not; texts with them are encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Bytes that a worker's remembered chunks take at most, about.
REMEMBERED_BYTES = 160 << 20
#: Rows that one task numbers at most, of the pieces of one length.
PART_ROWS = 200_000
#: Normaliser and splitting under which no id depends on more than one chunk between white space.
CHUNKED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)
#: Texts of ASCII and Latin-1 letters, which normalising only lower-cases and shortens in white space, and the pieces of what is then left.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s\x80-\uffff\U00010000-\U0010ffffA-Za-z0-9]+")
#: Unseen pieces that are encoded as one text.
AT_ONCE = 20_000


class Pieces:
    """The model of a tokenizer file alone, for pieces that need no normalising and no splitting any more.

    They are encoded many at once, as words of one text; a piece ends with the one token that has the suffix for it.
    """

    def __init__(self, said: dict):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        suffix, vocab, signs = said["model"]["end_of_word_suffix"], said["model"]["vocab"], pre_tokenizers.ByteLevel.alphabet()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others follow from 256 on
        others = iter(range(256, 512))
        self.signs = {b: b if b in kept else next(others) for b in range(256)} | {32: 32}
        self.whole = all(t in vocab and t + suffix in vocab for t in signs)

    @staticmethod
    def fit(said: dict) -> Pieces | None:
        """Where the file's model has a token for every byte, inside a word and at its end, so that no piece lacks its last token."""
        model = said["model"]
        same = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        rest = said["pre_tokenizer"]["pretokenizers"][1:]
        if not same or [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in rest] != [("ByteLevel", False, False)]:
            return None
        return own if (own := Pieces(said)).whole else None

    def encode(self, pieces: list[str]) -> list[bytes]:
        text = " ".join(pieces).encode().decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.translate(self.signs)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


class Chunks:
    """Ids of chunks seen lately, in two generations: a full new one becomes the old one, whose chunks are kept if met again."""

    def __init__(self, tokenizer, limit: int = REMEMBERED_BYTES, pieces: Pieces | None = None):
        self.tokenizer, self.limit, self.pieces = tokenizer, limit, pieces
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def ids(self, chunks: set[str]) -> dict[str, bytes]:
        found = dict(zip(chunks, map(self.new.get, chunks), strict=True))
        unmet = [c for c, own in found.items() if own is None]
        found.update((c, own) for c in unmet if (own := self.old.get(c)) is not None)
        unseen = [c for c in unmet if found[c] is None]
        if self.pieces:
            single = [c for c in unseen if PIECE.fullmatch(c)]
            for i in range(0, len(single), AT_ONCE):
                part = single[i : i + AT_ONCE]
                found.update(zip(part, self.pieces.encode(part), strict=True))
            unseen = [c for c in unseen if found[c] is None]
        for i in range(0, len(unseen), AT_ONCE):
            part = unseen[i : i + AT_ONCE]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[c] = np.array(e.ids, "<u4").tobytes()
        for c in unmet:
            self.new[c] = own = found[c]
            self.size += len(c) + len(own) + 190  # with the two objects and their slot
            if self.size > self.limit // 2:
                self.old, self.new, self.size = self.new, {}, 0
        return found


_TOKENIZERS: dict[str, tuple] = {}
_KEPT = Kept(_TOKENIZERS.clear)


def _tokenizer(path: str, remembered: int | None = None):
    """The tokenizer of a file and, if it may be given single chunks, those seen so far; kept by each worker process, for one file, while it encodes."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = (tokenizer, Chunks(tokenizer, pieces=Pieces.fit(said)) if (said.get("normalizer"), split[0]) == CHUNKED else None)
    if remembered is not None and (known := _TOKENIZERS[path][1]):
        known.limit = remembered
    return _TOKENIZERS[path]


def encode(texts: list[str], path: str, remembered: int | None = None) -> list[np.ndarray]:
    """Ids (uint32) of each text. Under a tokenizer that drops white space and never crosses it (CHUNKED), chunks between white
    space, or of plain texts the pieces that it splits them into, are encoded once and remembered, which gives the ids of the
    whole text; any other is given whole texts. Those remembered take about so many bytes at most, else REMEMBERED_BYTES."""
    with _KEPT:
        return _encode(texts, *_tokenizer(path, remembered))


def _encode(texts: list[str], tokenizer, known: Chunks | None) -> list[np.ndarray]:
    if known is None:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    chunks = []
    for t in texts:
        if any(c in t for c in ODD_SPACE):
            chunks.append(None)
        elif "<|" in t:  # special tokens are told by their case
            chunks.append(t.split())
        elif known.pieces and PLAIN.fullmatch(t):
            chunks.append(PIECE.findall(t.lower()))
        else:
            chunks.append((t.lower() if t.isascii() else t).split())
    ids = known.ids(set().union(*[own for own in chunks if own]))
    out = []
    for t, own in zip(texts, chunks, strict=True):
        if own is None:
            out.append(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4"))
        else:
            out.append(np.frombuffer(b"".join(map(ids.__getitem__, own)), "<u4"))
    return out


def token_pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) : each document's ids and end_id, cut into pieces of capacity where longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for b in batches:
            at = 0
            while at < b.num_rows:
                n, size = 0, 0  # a MB of text at a time, or one text
                texts: list[str] = []
                while at + n < b.num_rows and (not texts or size < 1_000_000):
                    texts.append(b.column(1)[at + n].as_py() or "")
                    size += len(texts[-1])
                    n += 1
                rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for i, ids in enumerate(encode(texts, tokenizer_path, remembered)):
                    ids = np.concatenate([ids, end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows["row"].append(at + i)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(len(own))
                        rows["crc"].append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            rows["ids"].append(own.tolist())
                columns = [b.column(0).take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32())]
                columns += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at += n

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return df.select(key, text).mapInArrow(tidy(run), schema)


class OpenBins:
    """Segment tree over remaining capacities: how many open bins have each, and the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.width
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least size that an open bin has."""
        i = size + self.width
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of equal lengths: runs (length, rank_from, rank_to, first_bin, per_bin, offset).

    Items of one length are interchangeable, and so are bins of one remaining capacity. The plan places runs of them,
    the same way as one document after another would be, so its work depends on the number of lengths and not on the
    number of documents. Item of rank r in a run lies in bin first_bin + (r - rank_from) // per_bin, at offset plus
    length times the remainder.
    """
    free, bins = OpenBins(capacity), 0
    open_runs: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first bin, number)
    plan = []

    def keep(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            free.add(remaining, n)
            open_runs.setdefault(remaining, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = free.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_runs[remaining].pop()
                free.add(remaining, -n)
            # The tightest bin stays the tightest until it is full, so each takes as many as fit.
            each = remaining // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - remaining))
                keep(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left:
                some = min(left, each)
                plan.append((length, rank, rank + some, first + full, each, capacity - remaining))
                keep(remaining - some * length, first + full, 1)
                rank, left, full = rank + some, left - some, full + 1
            keep(remaining, first + full, n - full)
    return plan


def place(pieces: DataFrame, capacity: int = 4096, key: str = "doc_id", part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (columns key, piece, length and others) with sequence_id and offset.

    Only the histogram of lengths, capacity rows at most, comes to the driver. Pieces of one length are numbered in
    two levels, in so many parts that a task numbers about part_rows of them, and joined with the plan's runs, whose
    number depends on the capacity alone.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(32, -(-max(histogram.values(), default=0) // part_rows))
    plan = spark.createDataFrame(plan_bins(histogram, capacity), "length bigint, r0 bigint, r1 bigint, bin bigint, each bigint, off bigint")
    order = [F.col(key), F.col("piece")] + [F.col(c) for c in pieces.columns if c in ("ids_crc32", "start")]
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)) - 1).join(counts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_r")).drop("_r", "_before", "_part")
    joined = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("r0")) & (F.col("_rank") < F.col("r1"))).drop(plan["length"])
    i = F.col("_rank") - F.col("r0")
    return joined.withColumns(
        {"sequence_id": F.col("bin") + F.floor(i / F.col("each")), "offset": F.col("off") + (i % F.col("each")) * F.col("length")}
    ).select(*pieces.columns, "sequence_id", "offset")


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """Every document's pieces with their sequence_id and offset; see token_pieces and place.

    Null and empty texts give one piece of end_id alone; repeated rows are packed each for itself; an empty table
    gives an empty result. with_ids adds the ids, so that grouping by sequence_id yields the sequences. remembered: bytes
    of pieces of texts that a worker keeps at most, REMEMBERED_BYTES if not given; fewer cost time, no result.
    """
    pieces = materialise(token_pieces(df, tokenizer_path, key, text, capacity, end_id, with_ids, remembered), "pieces")
    return place(pieces, capacity, key)
