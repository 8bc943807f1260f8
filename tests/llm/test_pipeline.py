"""The corpus pipeline against a plain version of its five stages."""

import sys
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from nodewell.llm import decontam, secrets
from nodewell.llm import queries as q

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_contracts import SF, _numbers, plain_bins, plain_ids, plain_statistics  # noqa: E402
from test_near_copies import plain_copies  # noqa: E402


def plain_quality(rows):
    """Rows that pass, without the lines that over 20 distinct texts of their source and over 5 % of them hold."""
    line = lambda x: " ".join(x.lower().split())
    texts = defaultdict(set)
    for r in rows:
        texts[r["source"]].add(r["text"])
    votes = Counter((h, x) for h, own in texts.items() for t in own for x in {line(y) for y in t.split("\n")} if x)
    gone = {k for k, n in votes.items() if n > 20 and 20 * n > len(texts[k[0]])}
    out = []
    for r in rows:
        n, _, _, _, repeated = plain_statistics(r["text"])
        left = [x for x in r["text"].split("\n") if (r["source"], line(x)) not in gone]
        if n >= 20 and 100 * repeated <= 30 * n and 100 * len(" ".join(left).split()) >= 50 * n:
            out.append({**r, "text": "\n".join(left)})
    return out


def leaks(text, bench):
    words = decontam.words_of(text)
    for item in bench:
        if len(set(item) & set(words)) >= len(set(item)) / 4:
            for at in range(0, len(words), 100):
                if decontam.align([_numbers(item, item)], [_numbers(words[at : at + 200], item)])[0] >= len(item):
                    return True
    return False


def test_pipeline_equals_the_plain_version(spark):
    compare(spark, SF)


def test_pipeline_removes_the_lines_that_many_documents_share(spark, tmp_path):
    """Real texts with a header and a footer on every second one, the footer longer than some of the texts."""
    docs = q.table(spark, SF, "documents").withColumn("source", F.lit("one"))
    footer = " ".join(f"Footer{k}" for k in range(60))
    own = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A  Header of all\n"), "text", F.lit(f"\n{footer}"))).otherwise(F.col("text")))
    own.write.parquet(f"{tmp_path}/documents.parquet")
    q.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [r.asDict() for r in own.collect()]
    kept = plain_quality(rows)
    before = {r["doc_id"]: r["text"] for r in rows}
    assert 0 < len(kept) < len(rows) and sum(r["text"] != before[r["doc_id"]] for r in kept) > 50
    compare(spark, str(tmp_path))


def compare(spark, SF):  # noqa: N803
    rows = plain_quality([r.asDict() for r in q.table(spark, SF, "documents").collect()])
    component = dict(plain_copies([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    bench = [decontam.words_of(r.text) for r in q.table(spark, SF, "benchmark").collect()]
    rows = [r for r in rows if not leaks(r["text"], bench)]
    model = secrets.train(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string"))
    expected, lengths = [], []
    for r in rows:
        ids = plain_ids(secrets._replaced(r["text"], secrets.all_spans(r["text"], model), "[SECRET]"))
        for piece, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            lengths.append(len(own))
            expected.append((r["doc_id"], piece, a, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter(expected)
    assert len({r.sequence_id for r in got}) == plain_bins(lengths, 4096)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, fp string, _nw_id int, _nw_maybe int"
    good = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40)) + ' token = "0123456789abcdef0123456789abcdef"'
    rows = [(1, good), (2, good), (None, good), (None, other), (3, None), (4, ""), (5, other), (5, other), (6, "short")]
    df = spark.createDataFrame([(i, t, "en", None, None, 1, "f", 2, 3) for i, t in rows], schema)
    for part in (df, df.limit(0)):
        docs = part
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        found = defaultdict(int)
        for r in docs.collect():
            found[r.doc_id] += 1
            assert r.n_chars == len(r.text) and "0123456789abcdef" not in r.text
        assert dict(found) == ({1: 1, 5: 1} if part is df else {})
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.count() == len(found)
