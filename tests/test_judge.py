"""Caption claims and the rules that judge them."""

from pyspark.sql import functions as F

from nodewell.functions import captions
from nodewell.operators import judge


def claims(spark, text, edition=2):
    return spark.createDataFrame([(text,)], "c string").select(captions.parse_caption(F.col("c"), edition).alias("c")).first().c


def test_second_edition(spark):
    c = claims(spark, "Two men near a dining table with 3 red chairs, a table and potted plants.")
    assert c.objects == ["potted plant", "dining table", "person", "chair"]  # longest phrase first; the weaker table goes
    assert c.raw_objects == ["potted plants", "dining table", "men", "chairs", "table"]
    assert c.colors == ["red"] and [(x.word, x.value) for x in c["counts"]] == [("two", 2)]
    assert claims(spark, "a dog,cat\nbird").objects == []  # deleted signs glue words
    assert claims(spark, "trees and walls").objects == ["tree", "wall"]
    assert claims(spark, "").objects == [] and claims(spark, None) is None


def test_first_edition(spark):
    assert claims(spark, "dining tables and trees", 1).objects == ["dining table", "tree"]
    c = claims(spark, "stop signs near a child", 1)
    assert c.objects == ["stop sign", "person"] and c.raw_objects is None


def verdict(spark, objects, seen, edition=2):
    return spark.createDataFrame([(objects, seen)], "o array<string>, s array<string>").select(judge.rule_judge(F.col("o"), F.col("s"), edition).alias("r")).first().r


def test_rules(spark):
    r = verdict(spark, ["person", "table", "tree"], ["Man", " Table ", "", None])
    assert (r.checked, r.supported, r.unsupported) == (2, 1, 1) and r.unsupported_claims == ["table"]  # the detected one became dining table
    assert r.hallucination == 0.5 and r.grounding == 0.5
    none = verdict(spark, ["tree"], ["dog"])
    assert none.hallucination == 0.0 and none.grounding == 0.0 and none.checked == 0
    many = verdict(spark, list("pqrstuvw"), ["p"])
    assert many.too_many_claims and many.hallucination == 7 / 8
    assert verdict(spark, ["table"], ["TABLE"], 1).supported == 1


def test_labels(spark):
    df = spark.createDataFrame([(["T.V.", "  Mobile   Phone", "scene", "unicorn", "cats", "cat", None],)], "l array<string>")
    assert df.select(captions.normalize_claims(F.col("l")).alias("c")).first().c == ["cell phone", "cat"]
    s = lambda c: spark.createDataFrame([(c,)], "l array<string>").select(captions.detection_caption(F.col("l"))).first()[0]
    assert s(["dog", "Person", "dog", "person", "bus"]) == "The image shows 2 dogs, 2 people, 1 bus."
    assert s(["bus", "bus"]) == "The image shows 2 bus." and s([]) == s(None) == "I could not detect any recognizable objects."


def test_violations_and_evaluation(spark):
    schema = "image string, model string, caption string, detected_classes array<string>, violations array<struct<type: string, claim: string, claim_raw: string, claim_normalized: string>>, claims array<string>, hallucination double, grounding double"
    v = lambda c, n=None: ("object_not_detected", c, None, n)
    rows = [
        ("1", "m", "Nobody here, a tram passes", ["Car", None], [v("dog"), v("x", "bus"), v("wall"), v("person"), v("car"), ("too_many_claims", "cat", None, None)], ["a", "b"], 1.0, None),
        ("2", "m", "a dog that is not here", ["Bus"], [v("bus"), v("dog"), v(" Person "), (None, None, None, None)], [], 0.5, 0.5),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.image, r.claim): r.category for r in judge.categorised_violations(df).collect()}
    assert got == {
        ("1", "dog"): "unverified_object", ("1", "bus"): "vehicle_type_confusion", ("1", "wall"): "out_of_label_space", ("1", "person"): "caption_negation_conflict", ("1", "car"): "semantic_mismatch_train_car",
        ("2", "bus"): "unverified_object", ("2", "dog"): "unverified_object", ("2", "person"): "unverified_object",
    }
    plain = df.limit(1).withColumn("violations", F.array(F.lit("cup"), F.lit("")))
    assert [r.claim for r in judge.violation_claims(plain, ["image"]).collect()] == ["cup"]
    e = judge.judge_eval(df).first()
    assert (e.n, e.coverage, e.claims_per_caption, e.hallucination, e.grounding, e.grounding_covered) == (2, 0.5, 1.0, 0.75, 0.25, 0.0)
    assert [(r.claim, r.n) for r in judge.top_claims(judge.categorised_violations(df), 2).collect()] == [("bus", 2), ("dog", 2)]
    h = {r.bin: r.n for r in judge.score_histogram(df).collect()}
    assert h == {0.5: 1, 0.75: 1}
    s = judge.hybrid_summary(df.select(*[F.col("hallucination").alias(f"{k}_{x}") for k in ("rule", "retrieval", "hybrid") for x in ("hallucination", "grounding")])).first()
    assert s.rule_grounding == 0.75


def test_retrieval_without_neighbours(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0], " ", 0.5, 0.5)], "corpus_id int, embedding array<double>, caption string, hallucination double, grounding double")
    r = judge.retrieval_scores(q, c).first()
    assert (r.retrieval_hallucination, r.retrieval_grounding) == (1.0, 0.0)
