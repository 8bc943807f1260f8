"""The registered queries without SQL against plain versions on the smallest tables, and what the secret model adds."""

import hashlib
import random
import string
import sys
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import xxhash
from nodewell.llm import queries as q
from nodewell.llm import secrets, sharding

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_contracts import SF, pairs, plain_base, plain_bins, plain_components, plain_ids, same  # noqa: E402


def whole(spark):
    return pairs(q.table(spark, SF, "documents"))


def chained(*values):
    """XXH64 of values one after the other, each seeded by the hash so far."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h


def test_op3_shard(spark):
    docs = whole(spark)
    at = lambda h: (h - (h >> 63 << 64)) % 65536
    ring = sorted((at(chained("virtual node", s, v)), s) for s in range(40) for v in range(128))
    position = [p for p, _ in ring]
    by_arc = defaultdict(list)
    for i, _ in docs:
        by_arc[bisect_left(position, at(chained(i))) % len(ring)].append(i)
    placed = sharding.sweep([(s, len(by_arc[a])) for a, (_, s) in enumerate(ring)], sharding.capacities(len(docs), 40, 0.0))
    expected = defaultdict(list)
    for a, x, z, shard, slot in placed:
        expected[a] += [(shard, slot + k) for k in range(z - x)]
    got = {r.doc_id: r for r in q.op3_shard(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert (got[i].size, got[i].text_crc32, got[i].law) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows")
    for a, ids in ((a, ids) for a, ids in by_arc.items() if ids):
        assert sorted((got[i].shard, got[i].slot) for i in ids) == sorted(expected[a])
        assert {got[i].home_shard for i in ids} == {ring[a][1]}
    assert sorted((r.shard, r.slot) for r in got.values()) == [(s, k) for s in range(40) for k in range(len(docs) // 40 + (s < len(docs) % 40))]


def test_op5_simhash(spark):
    same([(r.doc_id, r.fingerprint, r.component_id) for r in q.op5_simhash(spark, SF).collect()], plain_components(whole(spark)))


def test_op7_pack(spark):
    expected, lengths = [], []
    for i, t in whole(spark):
        ids = plain_ids(t)
        for piece, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            lengths.append(len(own))
            expected.append((i, piece, a, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    got = q.op7_pack(spark, SF).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter(expected)
    assert len({r.sequence_id for r in got}) == plain_bins(lengths, 4096)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096


def test_op10_secrets(spark):
    got = {r.doc_id: r for r in q.op10_secrets(spark, SF).collect()}
    docs = whole(spark)
    assert len(got) == len(docs)
    for i, t in docs:
        base = plain_base(t)
        listed = [f"{kind}:{a}:{z}" for kind, a, z in base]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("crf:")] == listed
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts) and all(int(s.split(":")[2]) <= len(t) for s in spans)


def planted(rng):
    """Lines with a secret that no pattern catches: (line, secret)."""
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    kind = rng.randrange(6)
    secret = (
        "ghp_" + some(alnum, 36), "sk-" + some(alnum, 48), some(alnum + "-_", 43), f"xoxb-{some(string.digits, 11)}-{some(string.digits, 12)}-{some(alnum, 24)}",
        some("0123456789ABCDEF", 40), some(alnum + "+/", 40),
    )[kind]
    before = ("the key is", "curl -H Authorization Bearer", "export", "use", "old one was", "aws_secret_access_key")[rng.randrange(6)]
    return f"{before} {secret} {rng.choice(('for the test', 'today', 'and no other', 'please'))}", secret


def ordinary(rng):
    """Lines with tokens that look odd and are no secrets."""
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    return rng.choice(
        (
            f"see https://www.example{digits(2)}.org/a/b-{digits(4)}/c.html?page={digits(2)} for it", f"invoice INV-{digits(8)}-{digits(4)} was sent on 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}",
            f"call +49{digits(9)} or write to someone.{digits(2)}@mail.example.com", f"version v{digits(1)}.{digits(2)}.{digits(1)}-rc{digits(1)} of the Donaudampfschifffahrtsgesellschaft",
            f"ISBN 978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)} and ISO-{digits(4)}", f"the file /usr/local/share/doc{digits(2)}/readme_{digits(3)}.txt", f"from {digits(2)}:{digits(2)} to {digits(2)}:{digits(2)} in room B{digits(3)}",
        )
    )


def measured(model, seed=7, n=600):
    """(recall over the planted secrets, share of the added spans that are planted) of lines put between prose."""
    rng = random.Random(seed)
    prose = "the river runs slowly past the old mill and nobody minds"
    hit = added = 0
    for _ in range(n):
        line, secret = planted(rng)
        text = f"{prose}\n{line}\n{ordinary(rng)}\n{prose}\n{ordinary(rng)}"
        assert not plain_base(secret)
        spans = [(a, z) for kind, a, z in secrets.all_spans(text, model) if kind == "crf"]
        at = text.index(secret)
        good = [(a, z) for a, z in spans if a < at + len(secret) and z > at]
        added += len(spans)
        hit += any(a <= at and z >= at + len(secret) for a, z in good)
    return hit / n, hit / max(1, added)


def test_what_the_model_adds(spark):
    recall, precision = measured(secrets.train(q.table(spark, "/root/testdata/sf0.01", "documents")))
    assert recall >= 0.85 and precision >= 0.95
