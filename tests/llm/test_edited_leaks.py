"""Edited copies of an item that has leaked often."""

from nodewell.llm import decontam


def test_an_edited_copy_is_found_among_many_plain_ones(spark):
    item = [f"t{i}" for i in range(36)]
    edited = [w if i % 6 else "other" for i, w in enumerate(item)]
    schema = "doc_id bigint, text string"
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    for plain, changed in ((100, 1), (10, 100)):
        docs = [(i, " ".join([f"a{i}", *item, f"b{i}"])) for i in range(plain)]
        docs += [(1000 + i, " ".join([f"a{i}", *edited, f"b{i}"])) for i in range(changed)]
        got = {r.doc_id for r in decontam.leaks(spark.createDataFrame(docs, schema), bench).collect()}
        assert got == {i for i, _ in docs}


def test_short_items_leak_as_they_are(spark):
    items = [(0, "rain falls softly"), (1, "Yes"), (2, "水はとても冷たくて青い川です"), (3, ""), (4, None), (5, "two words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(0, "When RAIN falls, softly, on"), (1, "yes!"), (2, "yes it does"), (3, "彼は言った水はとても冷たくて青い川ですよ"), (4, None), (5, ""), (6, "rain falls hard"), (7, "two words more")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for options in ({}, {"block_items": 2}, {"block_bytes": 20}):
        got = {(r.doc_id, r.item_id, r.score) for r in decontam.leaks(df, bench, **options).collect()}
        assert got == {(0, 0, 1.0), (1, 1, 1.0), (3, 2, 1.0)}
    assert decontam.leaks(df, bench.limit(0)).count() == 0 == decontam.leaks(df.limit(0), bench).count()
