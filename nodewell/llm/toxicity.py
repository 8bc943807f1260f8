"""Toxicity: maximum-scoring segments of token log-odds under Dirichlet priors, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from nodewell.llm.common import fresh, materialise
from nodewell.llm.workers import tidy

#: Words, and single characters of scripts without spaces.
TOKEN = re.compile("[぀-ヿ㐀-鿿]|[^\\W぀-ヿ㐀-鿿]+")
SHORTEST, LONGEST = 3, 8  # characters of the prefixes that stand for a word
PIECE = 1 << 20  # characters of a text that are cut into tokens at a time
REMEMBERED = 200_000  # tokens that a worker remembers


def features(token: str) -> tuple[str, ...]:
    """The prefixes of a token from short to long, and the whole token, marked by a line end: each is the parent of the next."""
    word = token.lower()
    return (*(word[:n] for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)), word + "\n")


def tokens_of(text: str) -> Iterator[list[str]]:
    """The tokens of a text, piece by piece; a token is never cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalnum() | (text[end] == "_") and text[end - 1].isalnum() | (text[end - 1] == "_"):
            end += 1
        yield TOKEN.findall(text, at, end)
        at = end


class Segments:
    """All maximal scoring segments (Ruzzo and Tompa) of a row of scores that is fed piece by piece.

    A candidate keeps the sums before and after it, its first and last place, and the nearest candidate to its left with
    a lesser sum before it; following these links instead of the list makes the scan linear.
    """

    def __init__(self) -> None:
        self.total, self.at, self.found = 0.0, 0, []

    def feed(self, scores: np.ndarray) -> Segments:
        sums = self.total + np.cumsum(scores)
        for k in np.flatnonzero(scores > 0).tolist():
            right, place = float(sums[k]), self.at + k
            self._add(float(sums[k - 1]) if k else self.total, right, place)
        if len(scores):
            self.total = float(sums[-1])
        self.at += len(scores)
        return self

    def _add(self, left: float, right: float, place: int) -> None:
        first, found = place, self.found
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, place, j))
                return
            left, first = found[j][0], found[j][2]
            del found[j:]

    def spans(self) -> list[tuple[float, int, int]]:
        """(score, first token, last token) from left to right."""
        return [(right - left, a, z) for left, right, a, z, _ in self.found]


@dataclass
class Model:
    """Scores of features, and how the scores of segments spread over clean texts.

    known: per feature its score, and its score with one toxic or one clean document less: a training document is judged
    without its own vote. decay and scale: lambda and K of the extreme-value law, by which the best segment of a clean text of
    n tokens reaches s with probability 1 - exp(-K n exp(-lambda s)). bias, slope: from a text's evidence to its score.
    """

    known: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    cost: float = 2.0
    decay: float = 1.0
    scale: float = 1.0
    bias: float = 0.0
    slope: float = 0.0

    def token_score(self, token: str, view: int = 0) -> float:
        """Log-odds of the longest known feature, less the cost of a token."""
        for f in reversed(features(token)):
            own = self.known.get(f)
            if own is not None:
                return own[view] - self.cost
        return -self.cost

    def scores_of(self, tokens: list[str], view: int = 0) -> np.ndarray:
        memory = self.__dict__.setdefault("_memory", ({}, {}, {}))[view]
        out = list(map(memory.get, tokens))
        if None in out:
            if len(memory) > REMEMBERED:
                memory.clear()
            for i, s in enumerate(out):
                if s is None:
                    out[i] = memory.get(tokens[i])
                    if out[i] is None:
                        out[i] = memory[tokens[i]] = self.token_score(tokens[i], view)
        return np.array(out, dtype=float)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memory"}

    def evidence(self, n: int, segments: list[float]) -> float:
        """-log of the probability that a clean text of n tokens has segments as good: the best of the sums of its r best
        segments (Karlin and Altschul), each r paying for the choice among them; 0 for none."""
        best, total = 0.0, 0.0
        if n:
            floor = math.log(self.scale * n)
            for r, s in enumerate(sorted(segments, reverse=True), 1):
                if self.decay * s <= floor:
                    break
                total += self.decay * s - floor
                likely = (r - 1) * math.log(2 * total) - total - math.lgamma(r + 1) - math.lgamma(r)
                best = max(best, -likely)
        return best

    def expected(self, n: int, segment: float) -> float:
        """Number of segments as good that a clean text of n tokens has by chance."""
        return self.scale * n * math.exp(-self.decay * segment)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * math.log1p(evidence)))))


def held_out(key: str | Column) -> Column:
    """Whether a row takes no part in training: CRC-32 of its id as text leaves 1 by 3; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 3 == 1, F.lit(False))


def _sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(k, y): the labelled ids that may be learnt from, at most `rows`: those with the least hash, as far as whole
    4096ths of the hash range go. An id with several labels has the greatest."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    own = own.groupBy(F.col(key).alias("k")).agg(F.max(F.when(F.col(label) >= 1, 1).otherwise(0)).alias("y"))
    part = F.pmod(F.xxhash64("k"), F.lit(4096))
    kept, last = 0, -1
    for r in sorted(own.groupBy(part.alias("p")).count().collect(), key=lambda r: r.p):
        if kept + r["count"] > rows:
            break
        kept, last = kept + r["count"], r.p
    return own.where(part <= last)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, t, c): toxic and clean documents that hold a feature, summed as far as 300,000 features fit; and, as f = '', all documents."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    known: dict[str, tuple[str, ...]] = {}

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.record_batch({"f": pa.array(names, pa.string()), "t": pa.array([counts[1][f] for f in names], pa.int64()), "c": pa.array([counts[0][f] for f in names], pa.int64())})

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = {""}
            for piece in tokens_of(text or ""):
                for w in set(piece):
                    fs = known.get(w)
                    if fs is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        fs = known[w] = features(w)
                    own.update(fs)
            counts[y].update(own)
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
                counts = (Counter(), Counter())
    yield out()


def _pairs(counted: DataFrame) -> DataFrame:
    """Each feature with its counts and those of its parent, '' being the parent of the shortest."""
    n, whole = F.length("f"), F.col("f").endswith("\n")
    shorter = F.when(whole, F.least(n - 2, F.lit(LONGEST))).otherwise(n - 1)
    parent = F.when(shorter >= SHORTEST, F.substring("f", 1, shorter)).otherwise("")
    up = counted.select(F.col("f").alias("parent"), F.col("t").alias("pt"), F.col("c").alias("pc"))
    return counted.where("f <> ''").withColumn("parent", parent).join(up, "parent")


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 50_000,
    max_features: int = 200_000,
    min_docs: int = 2,
    prior: float = 15.0,
    min_z: float = 0.5,
    cost: float = 2.0,
) -> Model:
    """A model of the documents that labels marks, but for the held-out ones; nothing else than the texts and the marks is used.

    At most sample_rows labelled ids are learnt from (see _sample), whole texts of them; they are broadcast, so no text is
    shuffled. A feature's share of toxic documents has a Dirichlet prior of weight `prior` around its parent's share. Features are
    kept if their log-odds differ from their parent's by min_z standard deviations, at most max_features of them, those
    that differ most; a token counts as its longest kept feature. The driver holds the kept features (some 20 MB) and
    histograms. Without documents of both marks every text gets the share of toxic ones, smoothed.
    """
    marks = _sample(labels, key, label, sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(marks), "k").select("t", "y")
    counted = rows.mapInArrow(tidy(_count_features), "f string, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = materialise(counted.where((F.col("t") + F.col("c") >= min_docs) | (F.col("f") == "")), "toxic-features")
    n1, n0 = next(((r.t, r.c) for r in counted.where("f = ''").collect()), (0, 0))
    if not n1 or not n0:
        return Model(cost=cost, bias=math.log((n1 + 1) / (n0 + 1)))
    base = n1 / (n1 + n0)
    share = (F.col("pt") + prior * base) / (F.col("pt") + F.col("pc") + prior)
    logit = lambda p: F.log(p / (1 - p))
    a, b = F.col("t") + prior * share, F.col("c") + prior * (1 - share)
    z = F.abs(F.log(a / b) - logit(share)) / F.sqrt(1 / a + 1 / b)
    tested = _pairs(counted).withColumn("z", F.least(z, F.lit(1000.0))).where(F.col("z") >= min_z)
    size, floor = 0, None
    for r in sorted(tested.groupBy(F.floor(F.col("z") * 100).alias("at")).count().collect(), key=lambda r: -r["at"]):
        if size + r["count"] > max_features:
            break
        size, floor = size + r["count"], r["at"]
    kept = tested.where(F.floor(F.col("z") * 100) >= floor).select("f", "t", "c").collect() if floor is not None else []
    model = Model(_smoothed({r.f: (r.t, r.c) for r in kept}, base, prior), cost)
    _calibrate(model, rows, base)
    return model


def _smoothed(counts: dict[str, tuple[int, int]], base: float, prior: float) -> dict[str, tuple[float, float, float]]:
    """Log-odds of each feature against the base share, as Model.known has them; its prior is its nearest kept ancestor's share."""
    shares: dict[str, tuple[float, ...]] = {}
    for f in sorted(counts, key=lambda f: (len(f), f)):
        above = (base,) * 3
        for p in reversed(features(f[:-1])[:-1] if f.endswith("\n") else [f[:n] for n in range(SHORTEST, len(f))]):
            if p in shares:
                above = shares[p]
                break
        t, c = counts[f]
        less = ((0, 0), (min(t, 1), 0), (0, min(c, 1)))
        shares[f] = tuple((t - x + prior * s) / (t + c - x - y + prior) for s, (x, y) in zip(above, less, strict=True))
    origin = math.log(base / (1 - base))
    return {f: tuple(math.log(s / (1 - s)) - origin for s in own) for f, own in shares.items()}


def _calibrate(model: Model, rows: DataFrame, base: float) -> None:
    """Fits decay, scale, bias and slope to the training rows, each judged without its own vote."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: Counter = Counter()
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, n = Segments(), 0
                for piece in tokens_of(text or ""):
                    s = model.scores_of(piece, 1 if y else 2)
                    found.feed(s)
                    n += len(s)
                    if not y:
                        spread.update(dict(zip(*(x.tolist() for x in np.unique(np.round(s * 50).astype(int), return_counts=True)), strict=True)))
                for column, value in zip(out, (y, n, [s for s, _, _ in found.spans()]), strict=True):
                    column.append(value)
            yield _judged(["doc"] * len(out[0]), *out)
        yield _judged(["bin"] * len(spread), list(spread), list(spread.values()), [[]] * len(spread))

    def _judged(kind: list, y: list, n: list, segments: list) -> pa.RecordBatch:
        return pa.record_batch({"kind": pa.array(kind, pa.string()), "y": pa.array(y, pa.int64()), "n": pa.array(n, pa.int64()), "s": pa.array(segments, pa.list_(pa.float64()))})

    seen = materialise(rows.mapInArrow(tidy(judge), "kind string, y bigint, n bigint, s array<double>"), "toxic-training")
    bins = seen.where("kind = 'bin'").groupBy("y").agg(F.sum("n").alias("n")).collect()
    model.decay = _decay(np.array([r.y / 50 for r in bins]), np.array([r.n for r in bins], float))
    clean = seen.where("kind = 'doc' and y = 0 and n > 0")
    found = clean.agg(F.count("*").alias("n"), F.sum(F.col("n") * F.exp(-model.decay * F.coalesce(F.array_max("s"), F.lit(0.0)))).alias("e")).first()
    model.scale = found.n / found.e if found.n and found.e else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [round(math.log1p(model.evidence(n, s)), 2) for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({"y": b.column(0), "x": pa.array(x, pa.float64())})

    weighed = seen.where("kind = 'doc'").select("y", "n", "s").mapInArrow(weigh, "y bigint, x double").groupBy("x").agg(F.sum("y").alias("t"), F.count("*").alias("n")).collect()
    model.bias, model.slope = _fit_line(np.array([r.x for r in weighed]), np.array([r.t for r in weighed], float), np.array([r.n for r in weighed], float), base)


def _decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The lambda > 0 at which the mean of exp(lambda * score) is 1; 20 at most, which is also given where no score is positive."""
    low, high = 1e-3, 20.0
    if not len(scores) or scores.max() <= 0:
        return high
    p = np.log(counts / counts.sum())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if np.logaddexp.reduce(p + middle * scores) > 0 else (middle, high)
    return low


def _fit_line(x: np.ndarray, toxic: np.ndarray, n: np.ndarray, base: float) -> tuple[float, float]:
    """Logistic regression of bins of x, with Platt's smoothed targets."""
    n1, n0 = toxic.sum(), n.sum() - toxic.sum()
    aim = (toxic * (n1 + 1) / (n1 + 2) + (n - toxic) / (n0 + 2)) / n
    w = np.array([math.log(base / (1 - base)), 0.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ (n * (aim - p)) - 1e-3 * w
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_toxicity(df: DataFrame, model: Model, text: str = "text", name: str = "toxicity", max_expected: float = 0.05) -> DataFrame:
    """All rows and columns of df with a struct `toxicity`: score (0 to 1), evidence, tokens, and passages, an array of (start,
    end in code points, score, expected): the maximal segments of which a clean text of this length has max_expected by chance at most.

    Null and empty texts, and those without a token, get the score of no evidence; equal texts get equal scores; an empty table
    gives none; a column of that name is replaced. Texts are scanned whole, a million characters at a time; nothing is shuffled.
    """
    df = df.drop(name)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.float64()), ("tokens", pa.int64()), ("passages", pa.list_(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                own = pa.array([judge_text(t or "", known, max_expected) for t in part.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, own], [*part.schema.names, name])

    passages = "array<struct<start: bigint, end: bigint, score: double, expected: double>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` struct<score: double, evidence: double, tokens: bigint, passages: {passages}>"
    return df.mapInArrow(tidy(run), schema)


def judge_text(text: str, model: Model, max_expected: float = 0.05) -> dict:
    """Score, evidence, number of tokens and significant passages of one text."""
    found = Segments()
    for piece in tokens_of(text):
        found.feed(model.scores_of(piece))
    spans, n = found.spans(), found.at
    evidence = model.evidence(n, [s for s, _, _ in spans])
    good = [(s, a, z) for s, a, z in spans if model.expected(n, s) <= max_expected]
    ends: dict[int, tuple[int, int]] = {}
    if good:
        wanted = {k for _, a, z in good for k in (a, z)}
        ends = {k: m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in wanted}
    passages = [{"start": ends[a][0], "end": ends[z][1], "score": s, "expected": model.expected(n, s)} for s, a, z in good]
    return {"score": model.score(evidence), "evidence": evidence, "tokens": n, "passages": passages}


def toxic_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, **options) -> DataFrame:
    """Per row of docs: its key, held_out, score, predicted (1 from the threshold on) and n_passages, by a model trained on the two tables."""
    model = train(docs, labels, key, text, label, **options)
    own = docs.select(F.col(key), F.col(text).alias(fresh(docs.select(key), "_nw_text")))
    out = score_toxicity(own, model, own.columns[1], fresh(own, "toxicity"))
    score = F.col(f"{out.columns[2]}.score")
    return out.select(key, held_out(key).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"), F.size(f"{out.columns[2]}.passages").cast("bigint").alias("n_passages"))
