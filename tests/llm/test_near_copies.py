"""Near copies against every pair, and in the pipeline's stage."""

import random
import sys
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from nodewell.llm import nearcopies
from nodewell.llm import queries as q

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_contracts import SF, WORD, docs, pairs, real, rows  # noqa: E402, F401


def plain_copies(nodes):
    """(key, component_id) by the Jaccard similarity of every pair of five-word sets."""
    sets = {}
    for i, t in nodes:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append(i)
    keys = list(sets)
    label = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if 5 * len(keys[a] & keys[b]) >= 4 * len(keys[a] | keys[b]) and label[a] != label[b]:
                label = [label[a] if x == label[b] else x for x in label]
    least = {}
    for k, own in zip(label, sets.values(), strict=True):
        least[k] = min([x for x in [*own, least.get(k)] if x is not None], default=None)
    return [(i, least[k]) for k, own in zip(label, sets.values(), strict=True) for i in own]


def test_near_copies_equal_every_pair(docs, rows, real):  # noqa: F811
    for df, nodes in ((docs, [(r[0], r[1]) for r in rows]), (real, pairs(real))):
        assert Counter(map(tuple, nearcopies.near_copies(df).collect())) == Counter(plain_copies(nodes))
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_the_stage_drops_copies_with_edited_words(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    edited = [w if i not in (20, 90, 150) else "other" for i, w in enumerate(base)]  # 15 of 196 shingles: 0.86
    far = [w if i % 30 else "other" for i, w in enumerate(base)]  # 0.70
    made = [(1, base), (2, edited), (3, far)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in made], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == {1, 3}
    kept = corpus_pipeline.near_duplicates(spark, q.table(spark, SF, "documents"), SF)
    assert not {145, 177} & {r.doc_id for r in kept.collect()}  # 0.83 like 6 and 1; fingerprints 7 and 11 bits apart


def test_texts_that_share_a_passage_meet_once_and_not_at_each_of_its_shingles(spark):
    """12 texts of as many groups with 20 shingles in common, others between them, and one text more in the main group."""
    rows = []
    for node in range(13):
        root = min(node, 11)
        codes = sorted([*range(0, 200, 10), *(node * 1000 + 10 * k + 5 for k in range(3)), *([7] if node in (3, 4) else [])])
        rows += [(c, root, (node, 400, at), 11) for at, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "code bigint, root bigint, s struct<node bigint, n int, at int>, main bigint")
    df = df.where("code < 1000 or code % 10 = 0")
    met = [tuple(r) for r in nearcopies._across(df, lambda a, b: F.lit(True)).collect()]
    assert sorted(met) == [(a, b) for a in range(13) for b in range(a + 1, 13) if (a, b) != (11, 12)]  # 2,642 rows before
