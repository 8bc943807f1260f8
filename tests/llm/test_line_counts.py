"""Lines that documents of a host share: one vote per distinct text, whatever else the text holds."""

import random
from collections import defaultdict

import pytest

from nodewell.llm import quality

SCHEMA = "doc_id bigint, text string, source string"


def plain_removed(rows, min_docs=20, max_share=0.05):
    """doc_id -> (words, words in lines above the limits), each document by itself."""
    texts = defaultdict(set)
    for _, t, h in rows:
        texts[h or ""].add(t or "")
    lines_of = lambda t: [n for n in (" ".join(x.lower().split()) for x in (t or "").split("\n")) if n]
    votes = defaultdict(int)
    for h, own in texts.items():
        for t in own:
            for x in set(lines_of(t)):
                votes[h, x] += 1
    gone = {k for k, n in votes.items() if n > min_docs and n > max_share * len(texts[k[0]])}
    return {i: (len((t or "").split()), sum(len(x.split()) for x in lines_of(t) if (h or "", x) in gone)) for i, t, h in rows}


def judged(spark, rows):
    return {r.doc_id: r.quality for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def prose(rng, n, words=10):
    return [" ".join(f"v{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def test_furniture_counts_every_document_that_holds_it(spark):
    rng = random.Random(4)
    block = [f"furniture {c} of this host" for c in "abcdefgh"]  # the smallest digest is one of them in most documents
    rows = [(i, "\n".join([*block[:4], *prose(rng, 3), *block[4:]]), "h") for i in range(40)]
    text = prose(rng, 9)
    rows += [(100 + i, "\n".join([*text, f"own line {i} a"]), "h") for i in range(40)]  # near copies vote each
    rows += [(200 + i, rows[0][1], "h") for i in range(30)] + [(300, None, "h"), (301, "", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.docs for r in quality.frequent_lines(df).collect()) == [40] * 17
    got = judged(spark, rows)
    assert {i: (q.n_words, q.removed_words) for i, q in got.items()} == plain_removed(rows)
    assert all(got[i].removed_words == 40 for i in range(40)) and all(got[100 + i].removed_words == 90 for i in range(40))
    assert not any(got[100 + i].kept for i in range(40)) and all(got[200 + i].removed_words == 40 for i in range(30))


def test_neither_a_lines_digest_nor_a_tie_decides(spark):
    rows = []
    for k in range(8):  # lines whose digests are high and low, each in 150 of 300 documents of a host of its own
        rows += [(1000 * k + i, f"line {k} of all\nown {k} {i} a b c d" if i < 150 else f"own {k} {i} a b c d", f"h{k}") for i in range(300)]
    for host, n, total in (("at twenty", 20, 100), ("above twenty", 21, 100), ("at five percent", 25, 500), ("above five percent", 26, 500)):
        rows += [(9000, ("shared\n" if i < n else "") + f"text {i} of its own", host) for i in range(total)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.host: r.docs for r in quality.frequent_lines(df).collect()}
    assert found == {**{f"h{k}": 150 for k in range(8)}, "above twenty": 21, "above five percent": 26}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_share_of_furniture_decides_from_nothing_to_all(spark, seed):
    """Documents with 10 to 100 % of their 40 words in a line that half of the host's 300 documents hold."""
    rng = random.Random(seed)
    rows = []
    for percent in range(10, 101, 5):
        n = 40 * percent // 100
        line = " ".join(f"w{k}" for k in range(n))
        for i in range(150):
            rows.append((1000 * percent + i, "\n".join([line, *prose(rng, 1, 40 - n)]).strip(), f"h{percent}"))
            rows.append((1000 * percent + 500 + i, prose(rng, 1, 40)[0], f"h{percent}"))
    got, plain = judged(spark, rows), plain_removed(rows)
    assert {i: (q.n_words, q.removed_words) for i, q in got.items()} == plain
    for percent in range(10, 96, 5):
        # Half of the words left is enough; less is not, however little is left.
        assert all(got[1000 * percent + i].kept == (percent <= 50) for i in range(150)), percent
        assert all(got[1000 * percent + 500 + i].kept for i in range(150))
    # 150 equal texts are one text, so their line has one vote.
    assert all(got[100_000 + i].kept and got[100_000 + i].removed_words == 0 for i in range(150))


def test_depletion_is_judged_by_hand_at_both_limits(spark):
    base = " ".join(f"c{k}" for k in range(20))  # 20 words of furniture
    rng = random.Random(3)
    rows = [(i, f"{base}\n{prose(rng, 1, 20 if i % 2 else 19)[0]}", "h") for i in range(60)]
    got = judged(spark, rows)
    assert all(q.removed_words == 20 and q.kept == bool(i % 2) and not q.base_failed for i, q in got.items())
    few = judged(spark, rows[:20])  # twenty documents are not above the limit
    assert all(q.removed_words == 0 and q.kept for q in few.values())


def test_lines_are_split_and_normalised_once(spark, monkeypatch):
    """What the lines are counted from and found again in is one written table of hashes."""
    calls, real = [], quality.normalised_line
    monkeypatch.setattr(quality, "normalised_line", lambda x: calls.append(x) or real(x))
    own = spark.createDataFrame([(i, f"Own words {i}\nThe  same line", "h") for i in range(30)], "doc_id bigint, text string, source string")
    gone = quality.removed_lines(own)
    assert len(calls) == 1 and [(r.removed_words, len(r.removed)) for r in gone.collect()] == [(3, 1)] * 30
