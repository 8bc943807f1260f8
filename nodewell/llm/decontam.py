"""Benchmark decontamination: rare n-gram seeds find candidates, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodewell.llm.common import materialise
from nodewell.llm.workers import tidy

WORD = re.compile(r"[^\W_]+")
GRAM = 3
#: Items, and bytes of their texts, that one scan of the corpus looks for; a larger benchmark takes several scans.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 4 << 20
#: Distinct words of a block: codes of three words must fit 63 bits.
MAX_WORDS = 2**21 - 2
#: Scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Block:
    """Items of a bounded block: word numbers from 1, and the grams as numbers in base len(vocabulary) + 1."""

    def __init__(self, items: list[tuple], min_words: int = 0):
        """Items of fewer than min_words words are looked for as they are; see short."""
        told = [(i, words_of(t)) for i, t in items]
        self.short = [(i, w) for i, w in told if 0 < len(w) < min_words]
        self.ids = [i for i, w in told if w and len(w) >= min_words]
        split = [w for _, w in told if w and len(w) >= min_words]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for own in split for w in own}), 1)}
        if len(self.vocabulary) > MAX_WORDS:
            raise ValueError(f"an item of more than {MAX_WORDS} distinct words")
        self.items = [np.array([self.vocabulary[w] for w in own], np.int64) for own in split]
        self.codes = np.unique(np.concatenate([self.grams(x) for x in self.items] or [np.empty(0, np.int64)]))

    def grams(self, numbers: np.ndarray) -> np.ndarray:
        """A code per gram; -1 where a word is not in the vocabulary."""
        n = len(numbers) - GRAM + 1
        if n < 1:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(GRAM):
            code = code * (len(self.vocabulary) + 1) + numbers[i : i + n]
            known &= numbers[i : i + n] > 0
        return np.where(known, code, -1)

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)

    def hits(self, numbers: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in codes) of the grams that are in the sorted codes."""
        own = self.grams(numbers)
        at = np.flatnonzero(own >= 0)
        where = np.searchsorted(codes, own[at])
        found = np.flatnonzero((where < len(codes)) & (codes[np.minimum(where, len(codes) - 1)] == own[at])) if len(codes) else np.empty(0, np.int64)
        return at[found], where[found]

    def seeds(self, frequency: np.ndarray, common: float, stretch: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        """Seed codes and their places (item, word): grams in at most `common` documents, and of every `stretch`
        neighbouring grams of an item the rarest and those in up to twice as many documents, so that an exact run of
        stretch + 2 words always has a seed. Copies of the item raise all its grams, but most those that edited copies
        leave intact: grams in up to twice as many documents as the item's median gram are seeds too."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, x in enumerate(self.items):
            g = self.grams(x)
            f = frequency[np.searchsorted(self.codes, g)]
            keep = f <= common
            if len(g):
                keep |= f <= 2 * np.sort(f)[len(g) // 2]
            for a in range(max(1, len(g) - stretch + 1)):
                if len(g):
                    keep[a : a + stretch] |= f[a : a + stretch] <= 2 * f[a : a + stretch].min()
            for p in np.flatnonzero(keep).tolist():
                places[int(g[p])].append((i, p))
        return np.array(sorted(places), np.int64), places


class Short:
    """Items of few words, found in a text as they are: as a run of its words if they have three or more, or twelve characters
    or more of a script without spaces (then within a run of letters, too); any other if it is all of the text's words."""

    def __init__(self, items: list[tuple]):
        self.runs, self.wholes = None, {}
        inside: dict[str, list] = {}
        for i, words in items:
            said = " ".join(words)
            if UNSPACED.search(said) and len(said) >= 12:
                inside.setdefault(said, []).append(i)
            elif len(words) >= GRAM:
                inside.setdefault(f" {said} ", []).append(i)
            else:
                self.wholes.setdefault(said, []).append(i)
        if inside:
            import ahocorasick

            self.runs = ahocorasick.Automaton()
            for said, ids in inside.items():
                self.runs.add_word(said, ids)
            self.runs.make_automaton()

    def found(self, text: str) -> set:
        said = " ".join(words_of(text))
        out = set(self.wholes.get(said, ()))
        if self.runs is not None:
            out.update(i for _, ids in self.runs.iter(f" {said} ") for i in ids)
        return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window (Smith-Waterman, linear gaps), all pairs at once."""
    rows, wide = max(map(len, items)), max(map(len, windows))
    a, b = np.full((len(items), rows), -1, np.int64), np.full((len(items), wide), -2, np.int64)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, np.where(y > 0, y, -2)
    slope = -GAP * np.arange(wide, dtype=np.int32)
    h, best = np.zeros((len(items), wide + 1), np.int32), np.zeros(len(items), np.int32)
    for i in range(rows):
        diagonal = h[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH)
        here = np.maximum(np.maximum(diagonal, h[:, 1:] + GAP), 0)
        h[:, 1:] = np.maximum.accumulate(here + slope, axis=1) - slope
        best = np.maximum(best, h[:, 1:].max(axis=1))
    return best


def candidates(block: Block, numbers: np.ndarray, codes: np.ndarray, places: dict, stretch: int = 8) -> Iterator[tuple[int, int, int]]:
    """(item, from, to): windows of a text in which seeds of an item lie about where the item has them."""
    at, which = block.hits(numbers, codes)
    starts: dict[int, list[int]] = defaultdict(list)
    for p, c in zip(at.tolist(), codes[which].tolist(), strict=True):
        for item, q in places[c]:
            starts[item].append(p - q)
    for item, own in starts.items():
        own.sort()
        n = len(block.items[item])
        slack = n // 4 + 4
        first = last = own[0]
        for s in [*own[1:], None]:
            if s is not None and s - last <= slack and s - first <= n + slack:
                last = s
                continue
            yield item, max(0, first - slack), min(len(numbers), last + n + slack)
            if s is not None:
                first = last = s


def leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    min_score: float = 0.5, min_words: int = 8, common_share: float = 0.0005, stretch: int = 4, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item, score) of every document that holds a copy of a benchmark item, exact, edited or paraphrased in part.

    Words are compared in lower case without punctuation. Seeds are three-word grams of the items, rare by the number
    of documents of the whole corpus that hold them. Around seeds the item is aligned with the text; score is the
    best local alignment over the score of the item with itself, from 0 to 1, and min_score or more is a leak.
    Items of fewer than min_words words leak as they are alone, with a score of 1 (see Short). Null and wordless items and
    null texts leak nothing; repeated rows give one row per key and item, a null key is kept as one; texts of any length
    are taken whole, one at a time. An empty table or benchmark gives none. The benchmark is taken in blocks of block_items
    items and block_bytes bytes at most, or one longer item, each small enough to send to every task; every block takes
    two scans of the corpus, one to count seeds and one to align.
    """
    spark = df.sparkSession
    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, score double"
    total, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    n_docs = df.count()
    n_blocks = max(-(-total // block_items), -(-size // block_bytes))
    named = benchmark.select(F.col(item), F.col(item_text).alias("_t"), F.pmod(F.xxhash64(item, item_text), F.lit(max(1, n_blocks))).alias("_b"))
    out = spark.createDataFrame([], kinds)
    for k in range(n_blocks):
        for own in _parts(named.where((F.col("_b") == k) & F.col("_t").isNotNull()).toLocalIterator(), block_items, block_bytes):
            block = Block(own, min_words)
            if block.short:
                out = out.union(rows.mapInArrow(tidy(_as_they_are(block.short, key, item, to_arrow_type(benchmark.schema[item].dataType))), kinds))
            if not block.items:
                continue
            counted = rows.select("_t").mapInArrow(tidy(_count(block)), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
            frequency = np.zeros(len(block.codes), np.int64)
            for r in counted.collect():  # one row per gram of the block at most
                frequency[r.gram] = r.n
            seeds = block.seeds(frequency, max(1.0, common_share * n_docs), stretch)
            out = out.union(rows.mapInArrow(tidy(_score(block, *seeds, min_score, key, item, to_arrow_type(benchmark.schema[item].dataType))), kinds))
    return materialise(out.groupBy(key, item).agg(F.max("score").alias("score")), "leaks")


def _parts(items: Iterator, most: int, size: int) -> Iterator[list[tuple]]:
    """The items in lists of `most` items and `size` bytes at most, or of one longer item."""
    held, taken = [], 0
    for r in items:
        n = len(r[1].encode())
        if held and (len(held) >= most or taken + n > size):
            yield held
            held, taken = [], 0
        held.append((r[0], r[1]))
        taken += n
    if held:
        yield held


def _as_they_are(items: list[tuple], key: str, item: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = Short(items)
        for b in batches:
            found = [(row, i) for row, t in enumerate(b.column(1)) for i in short.found(t.as_py())]
            docs = b.column(0).take(pa.array([r for r, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in found], id_type), pa.array([1.0] * len(found), pa.float64())], [key, item, "score"])

    return run


def _count(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(block.codes), np.int64)
        for b in batches:
            for t in b.column(0):
                _, which = block.hits(block.numbers(t.as_py()), block.codes)
                n[np.unique(which)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["gram", "n"])

    return run


def _score(block: Block, codes: np.ndarray, places: dict, min_score: float, key: str, item: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting: list[tuple[int, int, np.ndarray]] = []
            found: dict[tuple[int, int], float] = {}

            def settle() -> None:
                if not waiting:
                    return
                scores = align([block.items[i] for _, i, _ in waiting], [w for _, _, w in waiting])
                for (row, i, _), s in zip(waiting, scores.tolist(), strict=True):
                    share = s / (MATCH * len(block.items[i]))
                    if share >= min_score:
                        found[row, i] = max(share, found.get((row, i), 0))
                waiting.clear()

            for row, t in enumerate(b.column(1)):
                numbers = block.numbers(t.as_py())
                for i, start, end in candidates(block, numbers, codes, places):
                    window = numbers[start:end]
                    # A score of s needs s / 2 words of the item at least.
                    if MATCH * np.isin(window, block.items[i]).sum() >= min_score * MATCH * len(block.items[i]):
                        waiting.append((row, i, window))
                if len(waiting) >= 256:
                    settle()
            settle()
            docs = b.column(0).take(pa.array([r for r, _ in found], pa.int64()))
            ids = pa.array([block.ids[i] for _, i in found], id_type)
            yield pa.RecordBatch.from_arrays([docs, ids, pa.array(list(found.values()), pa.float64())], [key, item, "score"])

    return run
