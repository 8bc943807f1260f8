"""Toxic documents: segments against all intervals, counts against plain ones, and held-out accuracy of the query."""

import math
import random
import zlib

import numpy as np
import pytest

from nodewell.llm import queries as q, toxicity

DOCS, MARKS = "doc_id bigint, text string, lang string, toxicity int", "doc_id bigint, quality int, toxic int"


def plain_segments(scores):
    """By definition: the best interval (leftmost, shortest of equals), then the same left and right of it."""
    best = max(((sum(scores[a:z]), -a, -(z - a)) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[1]
    z = a - best[2]
    right = [(s, x + z, y + z) for s, x, y in plain_segments(scores[z:])]
    return [*plain_segments(scores[:a]), (best[0], a, z - 1), *right]


@pytest.mark.parametrize("seed", range(60))
def test_segments_equal_the_definition(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -1.25, -0.5, 0, 0.5, 1, 2.25]) + rng.random() / 1024 for _ in range(rng.randrange(0, 40))]
    found = toxicity.Segments()
    cut = rng.randrange(len(scores) + 1)
    found.feed(np.array(scores[:cut])).feed(np.array(scores[cut:]))
    assert [x[1:] for x in found.spans()] == [x[1:] for x in plain_segments(scores)]
    assert np.allclose([x[0] for x in found.spans()], [x[0] for x in plain_segments(scores)])


def test_many_falling_candidates_take_linear_time():
    scores = np.tile([1.0, -1.001], 200_000)
    assert len(toxicity.Segments().feed(scores).spans()) == 200_000
    rising = np.tile([1.0, -0.999], 200_000)
    (one,) = toxicity.Segments().feed(rising).spans()
    assert one[1:] == (0, 399_998)


def test_tokens_are_never_cut(monkeypatch):
    text = "one two_3 déjà 世界 x" * 50
    whole = toxicity.TOKEN.findall(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert [w for piece in toxicity.tokens_of(text) for w in piece] == whole


def test_decay_solves_its_equation():
    scores, counts = np.array([-2.0, -1.0, 1.5, 3.0]), np.array([800.0, 150.0, 40.0, 10.0])
    p = counts / counts.sum()
    assert math.isclose((p * np.exp(toxicity._decay(scores, counts) * scores)).sum(), 1, abs_tol=1e-9)
    assert toxicity._decay(np.array([-1.0]), np.array([5.0])) == 20


def test_scores_have_the_documents_own_vote_taken_out():
    counts = {"bad": (9, 1), "bade\n": (5, 0), "badge\n": (0, 8), "fine\n": (2, 40)}
    shares = toxicity._smoothed(counts, 0.1, 15)
    less_toxic = toxicity._smoothed({**counts, "bad": (8, 1), "bade\n": (4, 0)}, 0.1, 15)
    assert math.isclose(shares["bade\n"][1], less_toxic["bade\n"][0]) and shares["badge\n"][0] < shares["bad"][0] < shares["bade\n"][0]
    model = toxicity.Model(shares)
    assert model.token_score("BADminton") == shares["bad"][0] - 2 and model.token_score("Badge") == shares["badge\n"][0] - 2 and model.token_score("ok") == -2


def prose(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("rstuvwxyz") * rng.randrange(1, 4) for _ in range(n)]


def made(n=600):
    rng = random.Random(5)
    docs, marks = [], []
    for i in range(n):
        words, y = prose(rng, rng.randrange(20, 300)), int(i % 6 == 0)
        if y:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["Vile", "rotten", "filthy", "vermin"]) + rng.choice([",", "", "!"]) for _ in range(6)]
        docs.append((i, " ".join(words), "xx", 7))
        marks.append((i, 1, y))
    return docs, marks


def test_passages_are_found_in_held_out_texts(spark):
    docs, marks = made()
    docs += [(10_000, None, None, None), (10_001, "", None, None), (10_002, "...", None, None), (None, docs[0][1], None, None), (0, docs[0][1], None, None)]
    docs += [(10_003, " ".join(prose(random.Random(1), 200_000)) + " vile rotten filthy vermin vile rotten filthy", "xx", 1)]
    marks += [(10_004, None, None), (None, 1, 1), (0, 1, 1), (6, 0, None)]
    df, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, MARKS)
    got = toxicity.toxic_documents(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in marks if y is not None and i is not None}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] == (r.n_passages > 0) for r in held if r.doc_id < 10_000)
    by_id = {r.doc_id: r for r in got}
    assert by_id[10_000].score == by_id[10_001].score == by_id[10_002].score < 0.2 and by_id[10_003].predicted == 1 and by_id[None].predicted == 1
    model = toxicity.train(df, labels)
    own = toxicity.score_toxicity(df.where("doc_id = 12"), model).first()
    assert own.toxicity.tokens > 20 and own.text[own.toxicity.passages[0].start : own.toxicity.passages[0].end].split()[0].strip(",!") in ("Vile", "rotten", "filthy", "vermin")


def test_marks_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, marks = made(300)
    df = spark.createDataFrame(docs, DOCS)
    out = lambda d, m: sorted(map(tuple, toxicity.toxic_documents(d, spark.createDataFrame(m, MARKS)).collect()))
    plain = out(df, marks)
    other = [(i, 0, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in marks]
    assert out(df.selectExpr("doc_id", "text", "'zz' lang", "1 toxic"), other) == plain


def test_empty_tables_and_one_mark(spark):
    docs, marks = made(60)
    df, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, MARKS)
    assert toxicity.toxic_documents(df.limit(0), labels).count() == 0
    for m in (labels.limit(0), labels.where("toxic = 0")):
        assert len({r.score for r in toxicity.toxic_documents(df, m).collect()}) == 1


def test_the_sample_is_bounded(spark):
    labels = spark.range(20_000).selectExpr("id doc_id", "cast(id % 7 = 0 as int) toxic")
    n = toxicity._sample(labels, "doc_id", "toxic", 5000).count()
    assert 4900 <= n <= 5000 and toxicity._sample(labels, "doc_id", "toxic", 10**6).count() == labels.where(~toxicity.held_out("doc_id")).count()


def test_op11_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = q.op11_toxicity(spark, sf).join(q.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.9 * sum(r.toxic for r in rows) and sum(r.predicted for r in rows) <= 1.02 * hits
