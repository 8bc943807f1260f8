"""Each query's operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from nodewell.llm import chat, decontam, packing, quality, secrets, sharding, simhash, substring, urlfilter, warc
from nodewell.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string, h int, kept string, secrets int, listed int"


def _texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünïcode", "İ", "naïve,", "\u00a0x", "the", "the", "of"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))

    long, shared = prose(6000), prose(60)
    texts = [None, "", "   \n\t ", "one", "two words", "a b c", prose(30), prose(200), prose(200), long, shared, shared]
    texts += [prose(10) + " " + shared + " " + prose(10) for _ in range(6)]
    texts += ["spam " * 300, "x y z " * 50, prose(100) + " token = \"" + "0123456789abcdef" * 2 + "\" " + prose(20)]
    texts += ["AKIA" + "Z" * 20 + " password:hunter2x secret='a'", "line one two\n" * 9 + prose(40), "tail\x1cwith\x1dodd space", "\ud83d\ude00 emoji 1 2 3".encode("utf-16", "surrogatepass").decode("utf-16")]
    near = prose(400).split()
    for i in range(5):
        own = list(near)
        own[50 + i] = "changed"
        texts.append(" ".join(own))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, "en", ("hot" if i % 3 else "cold") if i % 7 else None, None if t is None else len(t), "x", 1, "k", 2, 3) for i, t in enumerate(texts)]
    return [*out, out[7], out[7], (None, texts[7], None, None, None, "x", 1, "k", 2, 3), (-5, texts[10], "en", "hot", 1, "x", 1, "k", 2, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return q.table(spark, SF, "documents")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(found, expected):
    assert Counter(map(tuple, found)) == Counter(map(tuple, expected))


# 1


def test_warc_round_trip(spark):
    rows = [(1, "http://a.b/c d\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "v", ""), (5, "w", "x" * 300_000), (-9, "z", "x" * 300_000), (None, "n", "x" * 300_000), (4, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    archives = warc.write_archives(df)
    got = [(warc.number_of(r.record_id), r.payload_bytes, r.payload_digest, r.type, warc.number_of(r.refers_to), r.payload) for r in warc.read_archives(archives).collect()]
    least = {}
    for k, _, h in rows:
        if k is not None:
            least[h or ""] = min(k, least.get(h or "", k))
    expected = []
    for k, _, h in rows:
        p = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        again = least[h or ""] != k
        expected.append((k, len(p), d, "revisit" if again else "response", least[h or ""] if again else None, None if again else p))
    same([(*g[:5], None if g[5] is None else bytes(g[5])) for g in got], expected)
    assert spark.createDataFrame([], "page_id bigint, url string, html string").transform(warc.write_archives).isEmpty()


def test_warc_uses_a_dictionary_and_rejects_damage(spark):
    records = [warc.write_record(f"http://h/{i}", f"<html>{i} {'common words ' * 60}</html>".encode(), warc.record_id(i, ""), None, "1970-01-01T00:00:00Z") for i in range(200)]
    archive = warc.write_archive(records)
    assert archive[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_archive(archive)) == records
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(archive[:-20]))
    for old, new in ((b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type", b"WARC-Kind"), (b"common", b"commen"), (b"WARC/1.1", b"WARC/9.1"), (b"WARC-Date:", b"WARC-Date")):
        with pytest.raises(warc.WarcError):
            warc.read_record(records[0].replace(old, new))


def test_op1_on_pages(spark):
    pages = q.table(spark, SF, "pages").collect()
    got = q.op1_warc(spark, SF).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(p.page_id, len(p.html.encode()), base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()) for p in pages}


# 2


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_leaks_exact_edited_and_clean(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    edited = [w if i % 9 else "other" for i, w in enumerate(item)]
    shuffled = rng.sample(item, 40)
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [(1, filler(50) + item + filler(9)), (2, filler(5) + edited), (3, filler(300)), (4, shuffled), (5, [w.upper() + "," for w in item]), (6, item[:12])]
    rows = [(i, " ".join(w)) for i, w in docs] + [(7, None), (8, ""), (1, " ".join(docs[0][1]))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "too short"), (3, " ".join(filler(30)))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 0)}
    assert got[1, 0] == got[5, 0] == 1.0
    assert got[2, 0] == pytest.approx(plain_alignment(item, edited) / 80)
    blocked = decontam.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, block_items=1)
    assert {(r.doc_id, r.item_id) for r in blocked.collect()} == set(got)


def test_leaks_against_every_alignment(spark):
    docs = [(r.doc_id, decontam.words_of(r.text)) for r in q.table(spark, SF, "documents").collect()]
    bench = [(r.item_id, decontam.words_of(r.text)) for r in q.table(spark, SF, "benchmark").collect()]
    expected = set()
    for d, w in docs:
        for i, item in bench:
            if len(set(item) & set(w)) < len(set(item)) / 4:
                continue  # a score of half needs a quarter of the distinct words at least
            for at in range(0, len(w), 100):
                if decontam.align([_numbers(item, item)], [_numbers(w[at : at + 200], item)])[0] >= len(item):
                    expected.add((d, i))
    assert {(r.doc_id, r.item_id) for r in q.op2_decontaminate(spark, SF).collect()} == expected


def _numbers(words, item):
    import numpy as np

    at = {w: n for n, w in enumerate(item, 1)}
    return np.array([at.get(w, 0) for w in words])


# 3


def test_shards_are_full_and_gapless(spark, docs, rows):
    for slack, vnodes in ((0.0, 128), (0.3, 4)):
        got = sharding.assign_shards(docs, 5, vnodes=vnodes, slack=slack).collect()
        same([(r.doc_id, r.size, r.text_crc32) for r in got], [(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows])
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[s]) for s in range(5)]
        assert max(sizes) - min(sizes) <= 1 if slack == 0 else max(sizes) <= -(-1.3 * len(rows) // 5)
    assert sharding.assign_shards(docs.limit(0), 5).count() == 0


def test_sweep_against_one_key_at_a_time():
    rng = random.Random(5)
    for _ in range(30):
        arcs = [*[(s, rng.randrange(6)) for s in range(4)], *[(rng.randrange(4), rng.randrange(6)) for _ in range(20)]]
        capacity = sharding.capacities(sum(n for _, n in arcs), 4, 0.0)
        used, overflow, expected = [0] * 4, [], {}
        for a, (s, n) in enumerate(arcs):
            for r in range(n):
                if used[s] < capacity[s]:
                    used[s] += 1
                    expected[a, r] = s
        queue = []
        for a, (s, n) in [*enumerate(arcs), *enumerate(arcs)]:
            queue += [(a, r) for r in range(n) if (a, r) not in expected and (a, r) not in queue]
            while queue and used[s] < capacity[s]:
                used[s] += 1
                expected[queue.pop(0)] = s
        got = {(a, r): s for a, x, y, s, _ in sharding.sweep(arcs, capacity) for r in range(x, y)}
        assert got == expected and not overflow


def test_few_rows_move_when_a_shard_is_added(spark, real):
    many = q.table(spark, "/root/testdata/sf0.01", "documents")
    for slack, most in ((0.0, 0.1), (0.25, 0.06)):  # a ring alone moves 0.029 of these
        one, two = ({r.doc_id: r.shard for r in sharding.assign_shards(many, n, slack=slack).collect()} for n in (40, 41))
        assert sum(one[d] != two[d] for d in one) < most * len(one)


# 4


def plain_statistics(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_quality_statistics(docs, rows):
    for df, expected in ((docs, [(r[0], r[1]) for r in rows]),):
        got = [(r.doc_id, *r.quality[:5], r.quality.base_failed) for r in quality.judge(df).collect()]
        plain = []
        for i, t in expected:
            s = plain_statistics(t)
            plain.append((i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
        same(got, plain)
    assert quality.judge(docs.limit(0)).count() == 0


def test_op4_statistics_of_real_texts(spark, real):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.op4_quality(spark, SF).collect()]
    same(got, [(i, *plain_statistics(t)) for i, t in pairs(real)])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    rng = random.Random(1)
    prose = lambda n: "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(10)) for _ in range(n))
    furniture = "Subscribe   to our\tnewsletter 2024 today and " + " ".join(f"f{c}" for c in "abcdefghijklmnopq")
    rows = [(i, f"{prose(8)}\n{furniture}", "h") for i in range(40)]
    rows += [(100 + i, f"{prose(1)}\n{furniture}\nx{i} " + " ".join("abcdefghij"), "h") for i in range(3)]
    text = prose(9)
    rows += [(200 + i, text + f"\nown line {i} a", "h") for i in range(20)]  # twenty near copies are not above the limit
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged = {r.doc_id: r.quality for r in quality.judge(df).collect()}
    assert all(judged[i].kept and judged[i].removed_words == 24 for i in range(40))
    assert all(not judged[100 + i].kept and not judged[100 + i].base_failed for i in range(3))
    assert all(judged[200 + i].kept and judged[200 + i].removed_words == 0 for i in range(20))
    cleaned = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert furniture not in cleaned[0] and cleaned[0] == rows[0][1].rsplit("\n", 1)[0] and cleaned[200] == rows[43][1]


# 5


def plain_fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes):
    fps = {}
    for i, t in nodes:
        fps.setdefault(plain_fingerprint(t), []).append(i)
    keys = list(fps)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        own = [i for i in fps[k] if i is not None]
        least[root(k)] = min([*own, *([least[root(k)]] if least.get(root(k)) is not None else [])], default=None)
    return [(i, f"{k:016x}", least[root(k)]) for k in keys for i in fps[k]]


def test_near_duplicates(spark, docs, rows, real):
    same(simhash.near_duplicates(docs).collect(), plain_components([(r[0], r[1]) for r in rows]))
    same(simhash.near_duplicates(real).collect(), plain_components(pairs(real)))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_clustered_fingerprints_make_no_large_leaf(spark):
    """Half of all lie within 8 bits of one of a few centres, too near for a tree that is fitted on a sample of all."""
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {rng.getrandbits(64) for _ in range(3000)}
    while len(fps) < 6000:
        x = centres[len(fps) % 3]
        for b in rng.sample(range(64), rng.randrange(5, 9)):
            x ^= 1 << b
        fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint").cache()
    trees, tree_of = simhash.fit_trees(df, 200, 64)
    sizes = [r["count"] for r in simhash._homes(df, trees).groupBy("shard").count().collect()]
    assert max(sizes) <= 400 and sum(sizes) == 2 * len(fps) and len(sizes) <= len(tree_of)
    found = [(r.a, r.b) for r in simhash.links(df, 200, 64).collect()]
    keys = np.array(sorted(fps), np.uint64)
    parent = {int(k): int(k) for k in keys}

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for k in keys:
        for o in keys[np.bitwise_count(keys ^ k) <= 3]:
            a, b = root(parent, int(k)), root(parent, int(o))
            parent[max(a, b)] = min(a, b)
    ours = {int(k): int(k) for k in keys}
    for a, b in found:
        a, b = root(ours, a & (1 << 64) - 1), root(ours, b & (1 << 64) - 1)
        ours[max(a, b)] = min(a, b)
    assert {k: root(ours, k) for k in ours} == {k: root(parent, k) for k in parent}
    assert len({root(ours, k) for k in ours}) < len(fps)


def test_links_over_many_shards(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(300)] + [rng.getrandbits(32) for _ in range(200)]
    fps = set(base)
    for b in base[:60]:
        for n in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            fps.add(x)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), shard_rows=20, fit_rows=400).collect()

    def classes(edges):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        out = defaultdict(set)
        for f in fps:
            out[root(f)].add(f)
        return sorted(map(sorted, out.values()))

    every = list(fps)
    truth = [(a, b) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 3]
    assert classes([(r.a % 2**64, r.b % 2**64) for r in got]) == classes(truth)


# 6


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<s><s>", None, "", " [/INST]", "[ROLE] a [TEXT] b [/ROLE]", "<</s>", "é\n<<SYS>>", "\\\\[\\INST]"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant"] * 4, nasty))]
    rows += [(2, 0, "assistant", "first"), (2, 1, "tool\n[TEXT] x", "odd"), (2, 2, None, "no role"), (None, 0, "user", "hi"), (None, 1, "assistant", "ho")]
    rows += [(3, 5, "user", "b"), (3, 5, "user", "b"), (3, None, "user", "a"), (-1, 0, "user", "q"), (-1, 1, "assistant", "r" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    segments = chat.format_conversations(df)
    got = {r.conv: r for r in chat.read_conversations(segments).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    formatted = defaultdict(str)
    for s in sorted(segments.collect(), key=lambda s: s.seg):
        formatted[s.conv] += s.text
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(formatted[c])
    assert got[-1].valid and got[None].valid and not got[1].valid and not got[2].valid and got[2].fault == "assistant after the start"
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_escaped_texts_hold_no_control_string():
    rng = random.Random(4)
    marks = chat.Marks(chat.Template())
    controls = marks.template.controls()
    for _ in range(3000):
        text = "".join(rng.choice([*controls, "\\", "<", "/", "s", ">", "[", "INST]", " ", "\n"]) for _ in range(8))
        escaped = marks.escape(text)
        assert marks.unescape(escaped) == text and not any(c in escaped for c in controls)


# 7


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = plain_ids.__dict__.setdefault("tokenizer", Tokenizer.from_file(q.tokenizer_path()))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(spark, docs, rows, real):
    for df, texts in ((docs, [(r[0], r[1]) for r in rows]), (real, pairs(real))):
        got = packing.pack(df, q.tokenizer_path()).collect()
        expected, lengths = [], []
        for i, t in texts:
            ids = plain_ids(t)
            for p, a in enumerate(range(0, len(ids), 4096)):
                own = ids[a : a + 4096]
                lengths.append(len(own))
                expected.append((i, p, a, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
        same([r[:5] for r in got], expected)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            assert own[-1][0] + own[-1][1] <= 4096
        assert len(bins) == plain_bins(lengths, 4096)
    assert packing.pack(docs.limit(0), q.tokenizer_path()).count() == 0


def plain_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_remembered_chunks_are_bounded_and_whole_texts_agree(spark, rows):
    tokenizer, _ = packing._tokenizer(q.tokenizer_path())
    small = packing.Chunks(tokenizer, 4000)
    texts = [r[1] or "" for r in rows] + ["<|ENDOFTEXT|> A <|endoftext|>b", "It's 12\u00a0x\u2028y e\u0301 \u0130"]
    for _ in range(2):
        for t in texts:
            chunks = set(t.split())
            known = small.ids(chunks)
            assert set(known) == chunks and small.size <= 2200
    for t, ids in zip(texts, packing.encode(texts, q.tokenizer_path()), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    other = packing.encode(["Hello  World"], q.tokenizer_path("byte_bpe_50k.json"))
    assert packing._tokenizer(q.tokenizer_path("byte_bpe_50k.json"))[1] is None and len(other[0]) == 3


def test_plan_places_every_item_once():
    rng = random.Random(6)
    for capacity in (7, 50, 300):
        lengths = [rng.randint(1, capacity) for _ in range(500)] + [3] * 200
        histogram = Counter(lengths)
        room, seen = defaultdict(list), Counter()
        plan = packing.plan_bins(dict(histogram), capacity)
        for n, a, z, first, each, offset in plan:
            for r in range(a, z):
                seen[n, r] += 1
                room[first + (r - a) // each].append((offset + (r - a) % each * n, n))
        assert seen == Counter({(n, r): 1 for n, c in histogram.items() for r in range(c)})
        for own in room.values():
            own.sort()
            assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and own[-1][0] + own[-1][1] <= capacity
        assert len(room) == plain_bins(lengths, capacity)


# 8


def plain_repeats(nodes):
    """Rows that repeat a key and text are one document; null keys come first."""
    order = sorted({(i is not None, i or 0, xxhash_of(t), t or "") for i, t in nodes}, key=lambda n: n[:3])
    first, out = {}, {}
    for has, i, _, t in order:
        words = WORD.findall(t)
        marked = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in first:
                marked.update(range(s, s + 20))
            else:
                first[w] = s
        kept = [w for k, w in enumerate(words) if k not in marked]
        out[i if has else None, t] = (len(words), len(marked), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [(i, *out[i, t or ""]) for i, t in nodes]


def xxhash_of(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def digests(df):
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()]


def test_windows_that_are_held_are_bounded(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i % 50}" for i in range(3000)).encode()
    kinds = pa.schema([("d", pa.int64()), ("v", pa.int64()), ("t", pa.binary()), ("m", pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])))])
    batch = pa.RecordBatch.from_pylist([{"d": d, "v": 0, "t": text, "m": [{"h": 1, "s": 0, "n": 2981}]} for d in (5, 3)], kinds)

    def least():
        parts = [b.to_pylist() for b in substring._whole_windows(iter([batch]))]
        found = {}
        for r in (r for p in parts for r in p):
            found[r["w"]] = min(found.get(r["w"], (9, 9, 9)), (r["d"], r["v"], r["s"]))
        return len(parts), max(map(len, parts)), found

    parts, _, whole = least()
    monkeypatch.setattr(substring, "HELD_BYTES", 5000)
    many, most, same_ = least()
    assert parts == 1 and many > 10 and most < 20 and same_ == whole and len(whole) == 50


@pytest.mark.parametrize("group_bytes", [1, substring.GROUP_BYTES])
def test_repeats(spark, docs, rows, group_bytes):
    same(digests(substring.remove_repeats(docs, group_bytes=group_bytes)), plain_repeats([(r[0], r[1]) for r in rows]))


@pytest.mark.parametrize("group_bytes", [1, 20_000, substring.GROUP_BYTES])
def test_repeats_of_repeated_rows_and_periodic_texts(spark, group_bytes):
    own = " ".join(f"w{i}" for i in range(30))
    rows = [(1, own), (1, own), (2, "other"), (3, own + " end"), (4, "x " * 3000), (5, "a b c " * 1000), (4, "x " * 3000), (6, "y " + "x " * 50)]
    rows += [(7, " ".join(f"v{i}" for i in range(40))), (7, " ".join(f"v{i}" for i in range(10, 40)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = digests(substring.remove_repeats(df, group_bytes=group_bytes))
    same(got, plain_repeats(rows))
    assert [r[2] for r in got if r[0] in (1, 2)] == [0, 0, 0]


def test_repeats_of_very_long_periodic_texts(spark):
    rows = [(i, f"{i} " + "x " * 100_000) for i in range(4)]
    same(digests(substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))), plain_repeats(rows))


def test_op8_on_real_texts(spark, real):
    same(q.op8_repeats(spark, SF).collect(), plain_repeats(pairs(real)))
    assert substring.remove_repeats(real.limit(0)).count() == 0


# 9


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, v in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def test_urls(spark):
    urls = ["http://A.example.ORG/en/1x?q#f", "x://example.org", "https://example.org/es/", None, "no scheme", "http://sub.com/fr/a", "http://com/de/", "http://notcom/de/", "a://b://c/d", "http://h?x://y/", "http://www.bad.net/p/?utm_source=1&b=2&a=1", "https://bad.net/p?a=1&b=2#z", "http://m.bad.net/p.html?a=1&b=2&ref=q", "http://bad.net/q", ""]
    df = spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)] + [(3, None, 1, "h"), (11, urls[11], 1, "h")], "page_id bigint, url string, listed int, host string")
    listed = spark.createDataFrame([("bad.net/p?a=1&b=2",), ("bad.net/p?a=1&b=2",), (None,), ("",)], "url string")
    got = urlfilter.judge_urls(df, listed).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, rule, verdict = plain_url(r.url)
        bad = r.page_id in (10, 11, 12)
        assert (r.host, r.path, r.rule, r.listed, r.verdict) == (host, path, rule, bad, verdict or ("block" if bad else "allow"))
    assert urlfilter.judge_urls(df, listed.limit(0)).where("listed").count() == 0 and urlfilter.judge_urls(df.limit(0), listed).count() == 0


def test_bloom_has_no_false_negative_and_few_positives(spark):
    from pyspark.sql import functions as F

    members = spark.range(5000).select(F.concat(F.lit("a.b/"), F.col("id")).alias("url"))
    others = spark.range(5000, 15000).select(F.concat(F.lit("http://a.b/"), F.col("id")).alias("url"))
    both = members.select(F.concat(F.lit("http://"), F.col("url")).alias("url")).union(others)
    out = urlfilter.match_listed(both, "url", members)
    assert out.where("listed").count() == 5000
    assert urlfilter.match_listed(both, "url", members, max_filter_mb=0).where("listed").count() == 5000


# 10


def plain_base(text):
    t, out = text or "", []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, t) if m.end() - m.start() >= least]
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


def test_secrets(spark, docs, rows, real):
    model = secrets.train(real)
    for df, texts in ((docs, [(r[0], r[1]) for r in rows]), (real, pairs(real))):
        got = secrets.find_secrets(df, model).collect()
        same([(r.doc_id, tuple(tuple(s) for s in r.secrets if s.kind != "crf")) for r in got], [(i, tuple(plain_base(t))) for i, t in texts])
    cleaned = secrets.redact(docs, model).where("doc_id = 21").first()
    assert "hunter2x" not in cleaned.text and cleaned.text.startswith("[SECRET]")
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_viterbi_equals_best_of_all_sequences():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(40):
        m = secrets.Model(*[rng.normal(size=(secrets.N_FEATURES, 3)) for _ in range(3)], rng.normal(size=(3, 3)), np.array([0.0, 0, 3]), 2 * rng.normal(size=(3, 3)))
        shapes, file = rng.integers(0, 1 << 16, 6), rng.integers(0, 2, 3).astype(float)
        e = m.emissions(shapes, file)
        score = lambda t: sum(e[i, x] for i, x in enumerate(t)) + sum(m.turn[a, b] for a, b in zip(t, t[1:]))
        best = max(itertools.product(range(3), repeat=6), key=score)
        assert tuple(m.tags(shapes, file)) == best


def test_model_on_held_out_lines(spark):
    model = secrets.train(q.table(spark, "/root/testdata/sf0.01", "documents"))
    found = lambda t: [k for k, _, _ in secrets.all_spans(t, model)]
    assert found("the key ghp_16C7e42F292c6912E7710c838347Ae178B4a is ours") == ["crf"]
    assert found("Bearer mF9b5f41JqM3xT7uVw2yZ0aB8cD6eG4h was sent") == ["crf"]
    for clean in ("see https://example.com/a/b?x=12 for more", "call 26691094489 or write 50@mail6.example.com", "an ordinary sentence, nothing else."):
        assert found(clean) == []
    other = q.table(spark, SF, "documents").where("doc_id % 2 = 1").collect()
    tagged = total = 0
    for r in other:
        parts = secrets.secret_parts(r.text)
        if parts:
            tags = model.tags(secrets.shapes_of(r.text.split()), secrets.file_features(r.text))
            at = [t.span() for t, g in zip(secrets.TOKEN.finditer(r.text), tags) if g != secrets.OUTSIDE]
            total += len(parts)
            tagged += sum(any(s < z and e > a for s, e in at) for a, z in parts)
    assert tagged >= 0.9 * total


def test_nothing_else_imports_this_subpackage():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "nodewell")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "nodewell.llm" not in open(os.path.join(folder, n)).read()
