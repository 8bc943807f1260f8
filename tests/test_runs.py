"""Run records: reading, grains, filters, percentiles, agreement."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from nodewell import schemas
from nodewell.functions import captions, scalars, vectors
from nodewell.operators import enrich, stability, stats
from nodewell.sources import runs as sources


def record(**own):
    base = {"model": "m", "device": "d", "image_id": "1", "task": "caption_brief", "outputs": [], "hw_stats": None}
    return base | own


@pytest.fixture()
def run_file(tmp_path):
    rows = [
        record(outputs=[{"run": 0, "text": "a", "count_accuracy": {"count_exact_accuracy": 0.5}, "gen_latency_s": 1.0, "gen_len": 10, "tokens_per_sec": 0, "tokens_per_second": 5.0, "entity_recall": 1.0}, {"run": 1, "error": "x"}], hw_stats={"energy_joules_est": 20.0, "source": "b"}),
        record(image_id="2", outputs=[{"run": 0, "error": "bad"}], hw_stats={"energy_joules_est": 40.0, "source": "a"}),
        record(image_id="3", hw_stats={"energy_joules_est": 1000.0, "source": "0"}),
        record(image_id="x7", device="e", outputs=[{"run": 0, "text": "b", "gen_latency_s": 3.0, "gen_len": 30, "tokens_per_sec": 8.0}]),
    ]
    path = tmp_path / "runs.jsonl"
    path.write_text("\n".join([json.dumps(rows[0]), "", "{not json", *map(json.dumps, rows[1:])]))
    return str(path)


def test_reading_skips_bad_lines_and_keeps_grains_apart(spark, run_file):
    runs = sources.read_runs(spark, run_file)
    assert runs.count() == 4
    got = {r.device: r for r in stats.model_device_summary(runs).collect()}
    d = got["d"]
    assert (d.n_records, d.n_outputs, d.n_recall_valid) == (3, 3, 1)  # of the record without outputs nothing else counts
    assert d.energy_joules_mean == 30.0 and d.energy_per_token_mj_mean == 3000.0 and d.hw_source == "a"
    assert d.count_exact_mean is None and len(d) == 26
    assert d.tokens_per_sec_mean == 5.0  # zero falls through to the other name
    ids = {r.image_id for r in sources.identified(runs).collect()}
    assert ids == {1, 2, 3, None}


def test_tags_globs_and_paths(spark, run_file, tmp_path):
    tagged = sources.tag_runs(spark, [f"A:x:{run_file}", f"B:y:{run_file}"])
    assert {(r.model, r.device) for r in tagged.collect()} == {("A", "x"), ("B", "y")}
    assert len(sources.input_files(spark, [str(tmp_path / "*.jsonl"), run_file])) == 1
    with pytest.raises(FileNotFoundError):
        sources.input_files(spark, [str(tmp_path / "*.none")])
    assert sources.enriched_path("a/runs_enriched.jsonl", "rescored") == "a/runs_rescored.jsonl"
    out = str(tmp_path / "out")
    sources.write_enriched(tagged.select("model", "device", "image_id"), out)
    sources.write_enriched(tagged.limit(0).select("model", "device", "image_id"), out)  # is there, so it stays
    assert spark.read.json(out).count() == 8
    sources.write_report_csv(tagged.groupBy("model").count(), str(tmp_path / "r.csv"))
    sources.write_report_json(tagged.groupBy("model").count(), str(tmp_path / "r.json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == ["model", "count"]


def test_ground_truth_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"categories": [{"id": 1, "name": "dog"}], "annotations": [{"image_id": 5, "category_id": 1, "caption": "c1"}, {"image_id": 5, "category_id": 1, "caption": "c2"}]}))
    assert [tuple(r) for r in sources.read_annotations(spark, str(tmp_path / "a.json")).collect()] == [(5, "dog", 2)]
    assert [r.caption for r in sources.read_captions(spark, str(tmp_path / "a.json")).orderBy("caption_no").collect()] == ["c1", "c2"]
    (tmp_path / "m.txt").write_text("/x/000012.jpg\n\n/x/name.jpg\n7\n")
    assert [r.image_id for r in sources.read_manifest(spark, str(tmp_path / "m.txt")).collect()] == [12, 7]
    (tmp_path / "t.json").write_text(json.dumps([{"image_id": 3, "file_name": "f", "expected_entities": ["cup"]}]))
    assert sources.read_testset(spark, str(tmp_path / "t.json")).first().expected_entities == ["cup"]


def test_outputs_explode_and_filters(spark, run_file):
    e = enrich.explode_outputs(sources.read_runs(spark, run_file))
    assert e.count() == 5 and e.where("pos is null").count() == 1
    assert enrich.valid_outputs(e).count() == 0  # none has a vector
    rows = [("m", "d", None, " ", 1.0), ("m", None, "t", "x", 0.0), ("m", "d", "t", "x", None), ("m", "d", "t", "x", 2.0), ("m", "d", "t", "", 2.0)]
    o = spark.createDataFrame(rows, "model string, device string, task string, text string, latency double")
    assert enrich.usable_latencies(o).count() == 1
    lenient = enrich.usable_latencies(o, "lenient").collect()
    assert len(lenient) == 3 and {(r.device, r.task) for r in lenient} == {("d", "caption"), ("unknown", "t"), ("d", "t")}
    lat = spark.createDataFrame([(None, None, 4.0), (None, 2.0, 4.0)], "gen_latency_s double, total_latency_s double, latency_s double").select(F.struct("*").alias("o"))
    assert [r[0] for r in lat.select(scalars.latency_of()).collect()] == [4.0, 2.0]
    audit = stats.load_audit(o).first()
    assert (audit.total, audit.excluded_empty, audit.excluded_no_latency, audit.kept, audit.groups) == (5, 2, 2, 1, 1)


def test_two_percentiles_and_two_deviations(spark):
    values = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, latency double")
    t = stats.latency_tail(df, ["g"], variant="plain").first()
    assert t.p50 == 2.5 and t.std == pytest.approx(math.sqrt(1.25))
    zero = stats.latency_tail(df.withColumn("latency", F.lit(0.0)), ["g"], variant="plain").first()
    assert zero.tail_ratio is None
    d = stats.filter_describe(df.withColumnsRenamed({"g": "filter", "latency": "fps"})).first()
    assert d.std == pytest.approx(math.sqrt(5 / 3)) and d.p25 == 1.75
    arr = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "v array<double>")
    # rank 2.5 rounds half to even: index 2
    assert arr.select(scalars.nearest_rank(F.col("v"), 50)).first()[0] == 3.0
    rng = random.Random(3)
    many = [(g, rng.choice([1.0, 2.0, 2.5, rng.random() * 9])) for g, n in (("a", 1), ("b", 2), ("c", 257), ("d", 1000)) for _ in range(n)] + [("e", 4.0)] * 300 + [("a", None)]
    df = spark.createDataFrame(many, "g string, v double")
    names = {"lo": 0.0, "p50": 50.0, "p99": 99.0, "hi": 100.0}
    exact = {r.g: r for r in df.groupBy("g").agg(F.percentile("v", [p / 100 for p in names.values()]).alias("p")).collect()}
    for bins in (2, 100):
        for r in stats.ranked_percentiles(df, ["g"], "v", names, bins=bins).collect():
            assert [r[n] for n in names] == pytest.approx(exact[r.g].p)
        for r in stats.ranked_percentiles(df, ["g"], "v", names, nearest=True, bins=bins).collect():
            own = sorted(v for g, v in many if g == r.g and v is not None)
            assert [r[n] for n in names] == [own[round(p / 100 * (len(own) - 1))] for p in names.values()]
    runs = spark.createDataFrame([("g", None, float(v), 1.0 / v) for v in range(1, 7)] + [("g", "err", 99.0, None)], "run_group string, error string, latency_ms double, images_per_second double")
    s = stats.deployment_summary(runs).first()
    assert (s.records, s.errors, s.latency_p50, s.latency_max, s.latency_mean) == (7, 1, 3.0, 6.0, 3.5)


def test_stability_equals_the_mean_over_pairs(spark):
    rng = random.Random(0)
    rows = [(i, [[rng.gauss(0, 1) if i < 3 or j else 0.0 for _ in range(4)] for j in range(n)]) for i, n in ((1, 5), (2, 2), (3, 3), (4, 1))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, v array<array<double>>").select("i", vectors.mean_pair_cosine(F.col("v")).alias("s")).collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for i, vs in rows:
        pairs = [cos(a, b) for k, a in enumerate(vs) for b in vs[k + 1 :]]
        assert got[i] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)


def test_cross_device_uses_the_first_repeat_only(spark):
    rows = [("m", 1, "t", d, p, "x" * 300, e, [1.0, float(p)]) for d, p, e in (("a", 0, None), ("a", 1, None), ("b", 0, "failed"), ("b", 1, None), ("c", 0, ""))]
    o = spark.createDataFrame(rows, "model string, image_id int, task string, device string, pos int, text string, error string, embedding array<double>")
    first = stability.cross_device_pairs(o).collect()
    assert [(r.device_a, r.device_b, len(r.text_a)) for r in first] == [("a", "c", 200)]
    assert stability.cross_device_pairs(o, "mean").count() == 3


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_vectors_equal_brute_force(spark, block):
    rng = random.Random(1)
    c = [(i, [rng.randint(0, 3) * 1.0 for _ in range(3)]) for i in range(40)]
    q = [(100 + i, [rng.randint(0, 3) * 1.0 for _ in range(3)]) for i in range(7)]
    got = {(r.query_id, r.rank): (r.corpus_id, r.distance) for r in vectors.topk_l2(spark.createDataFrame(q, "query_id int, embedding array<double>"), spark.createDataFrame([*c, (99, None)], "corpus_id int, embedding array<double>"), 4, block_rows=block).collect()}
    for i, v in q:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in c)[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, d) for d, j in near]


def test_semantic_duplicates_over_blocks(spark):
    rng = random.Random(2)
    rows = [("g", i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, i int, embedding array<double>")
    one, many = ({r.i: (r.links, round(r.total, 6)) for r in stability.semantic_duplicates(df, ["g"], "i", limit=0.8, block_rows=b).collect()} for b in (1000, 4))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    near = {i: [c for _, j, b in rows if j != i and (c := cos(a, b)) >= 0.8] for _, i, a in rows}
    assert one == many == {i: (len(c), round(sum(c), 6)) for i, c in near.items() if c}


def test_entity_recall_and_counts(spark):
    def recall(text, expected):
        return spark.createDataFrame([(text, expected)], "t string, e array<string>").select(captions.entity_recall(F.col("t"), F.col("e"))).first()[0]

    assert recall("Two Women and a CARD", ["person", "car"]) == 0.0  # neither women nor card
    assert recall("a woman, cars and a dinner table", ["person", "car", "dining table"]) == 1.0
    assert recall("tvset", ["tv"]) == 0.0 and recall("zebras. (a.b)", ["zebra", "a.b"]) == 1.0
    assert recall("x", []) is None and recall("", ["cup"]) == 0.0 and recall(None, ["cup"]) == 0.0 and recall("x", None) is None

    def counts(text, expected):
        return spark.createDataFrame([(text, expected)], "t string, e map<string, int>").select(captions.count_accuracy(F.col("t"), F.col("e"))).first()[0]

    c = counts("- puppy: 2\n* Cars = 3\ndog: 9\npuppy: 7\nx: 1", {"dog": 3, "car": 3})
    assert (c.n_categories_mentioned, c.n_categories_present, c.n_categories_correct) == (3, 2, 0)  # `Cars` is no alias; two labels may hit one category
    assert c.count_mae == 3.5 and c.count_exact_accuracy == 0.0
    empty = counts("nothing", {"dog": 1})
    assert empty.count_exact_accuracy == 0.0 and empty.count_mae is None and counts("dog: 1", {}) is None
    assert counts("cell-phone: 1", {"cell phone": 1}).n_categories_correct == 1


def test_pending_and_completed_work(spark):
    images = spark.createDataFrame([(1,), (2,), (2,)], "image_id int")
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "z")], "image_id int, task string")
    assert [tuple(r) for r in enrich.pending_work(images, ["a", "b"], done).collect()] == [(2, "b")]
    assert [r[0] for r in enrich.completed_images(done, ["a", "b"]).collect()] == [1]


def test_caption_and_clip_similarity(spark):
    o = spark.createDataFrame([(1, [1.0, 0.0], "x", None), (2, [1.0, 0.0], "x", None), (1, None, "x", None), (1, [1.0, 0.0], " ", None), (1, [0.0, -1.0], "x", None)], "image_id int, embedding array<double>, text string, error string")
    refs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "image_id int, embedding array<double>")
    s = enrich.caption_similarity(o, refs).collect()
    assert sorted([(r.caption_similarity_max, r.caption_similarity_mean) for r in s if r.caption_similarity_max is not None]) == [pytest.approx((0.0, -0.5)), pytest.approx((1.0, 0.5)), pytest.approx((1.0, 0.5))]
    clip = enrich.clip_scores(o, refs.limit(1).union(spark.createDataFrame([(9, [1.0, 1.0])], refs.schema))).collect()
    assert sorted(r.clipscore for r in clip if r.clipscore is not None) == [0.0, 2.5]


def test_embedding_hook(spark):
    import numpy as np

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.embedding for r in vectors.embed(df, "t", lambda b: np.array([[len(x), 1] for x in b])).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_schemas_parse(spark):
    for s in (schemas.RUN, schemas.DEPLOYMENT, schemas.JUDGED, schemas.MOVEMENT, schemas.ANNOTATIONS):
        assert spark.createDataFrame([], s).count() == 0


def test_percentiles_by_ranks_equal_those_by_maps(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.5, 1.0, 2.0, rng.random()]), rng.random()) for _ in range(900)] + [("c", None, 1.0), ("d", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, latency double, fps double")
    key = lambda r: str(r[0])

    def close(a, b):
        assert len(a) == len(b) == 5
        for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
            assert all(u == v or u is not None and v is not None and abs(u - v) < 1e-9 for u, v in zip(x[1:], y[1:])), (x, y)

    for job in (
        lambda n: stats.latency_tail(df, ["g"], variant="plain", map_rows=n), lambda n: stats.filter_describe(df, "g", "fps", map_rows=n),
        lambda n: stability.stability_summary(df.withColumnRenamed("fps", "stability"), ("g",), map_rows=n),
    ):
        close(job(10**6).collect(), job(0).collect())
