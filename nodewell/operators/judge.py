"""Caption judging: rules, retrieval, their mix, and evaluation of judged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nodewell.functions import captions, vectors


def rule_judge(claims: Column, detected: Column, edition: int = 2) -> Column:
    """Struct of a caption's claims against detected classes: checked, supported and unsupported claims, hallucination and
    grounding (shares of the checked claims, 0 if there are none), unsupported labels, and too_many_claims (8 or more checked,
    2 classes or fewer). Edition 2 normalises the detected labels, edition 1 only lowers them; claims stay as they are."""
    raw = F.filter(F.transform(F.coalesce(detected, F.array().cast("array<string>")), lambda c: F.trim(F.lower(c)) if edition == 2 else F.lower(c)), lambda c: c != "")
    classes = F.array_sort(F.array_distinct(F.transform(raw, captions.normalize_label) if edition == 2 else raw))
    skipped = F.array(*[F.lit(x) for x in [*captions.CLAIM_STOP, *captions.NON_DETECTABLE]])
    checked = F.filter(claims, lambda c: ~F.array_contains(skipped, c))

    def verdict(s: Column) -> Column:
        n = F.size(s["checked"])
        good = F.size(F.array_intersect(s["checked"], s["classes"]))
        bad = F.array_except(s["checked"], s["classes"])
        return F.struct(
            n.alias("checked"),
            good.alias("supported"),
            (n - good).alias("unsupported"),
            F.coalesce(F.try_divide(n - good, n), F.lit(0.0)).alias("hallucination"),
            F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("grounding"),
            bad.alias("unsupported_claims"),
            ((n >= 8) & (F.size(s["classes"]) <= 2)).alias("too_many_claims"),
            s["classes"].alias("detected_classes"),
        )

    return F.transform(F.array(F.struct(checked.alias("checked"), classes.alias("classes"))), verdict)[0]


def judge_captions(records: DataFrame, caption: str = "caption", detections: str = "detections", edition: int = 2) -> DataFrame:
    """records with claims (see captions.parse_caption) and judged."""
    parsed = records.withColumn("claims", captions.parse_caption(F.col(caption), edition))
    return parsed.withColumn("judged", rule_judge(F.col("claims.objects"), F.transform(detections, lambda d: d["class"]), edition))


def retrieval_scores(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id", corpus_id: str = "corpus_id") -> DataFrame:
    """(query_id, retrieval_hallucination, retrieval_grounding): means over the k nearest captions, nulls skipped; without any,
    hallucination is 1 and grounding 0. Corpus rows with an empty caption are not searched."""
    indexed = corpus.where("trim(coalesce(caption, '')) <> ''")
    near = vectors.topk_l2(queries, indexed, k, query_id, corpus_id)
    scored = near.join(indexed.select(corpus_id, "hallucination", "grounding"), corpus_id)
    means = scored.groupBy(query_id).agg(F.avg("hallucination").alias("h"), F.avg("grounding").alias("g"))
    return queries.select(query_id).join(means, query_id, "left").select(
        query_id, F.coalesce("h", F.lit(1.0)).alias("retrieval_hallucination"), F.coalesce("g", F.lit(0.0)).alias("retrieval_grounding")
    )


def hybrid(rule: Column, retrieval: Column, weight: float = 0.7) -> Column:
    return weight * rule + (1 - weight) * retrieval


def judge_eval(records: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per model: captions, share with a claim, claims per caption, hallucination and grounding over all and over captions
    with a claim. A null score counts as 0."""
    n = F.coalesce(F.size("claims"), F.lit(0))
    h, g = (F.coalesce(c, F.lit(0.0)) for c in ("hallucination", "grounding"))
    return records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((n > 0).cast("int")).alias("coverage"), F.avg(n).alias("claims_per_caption"), F.avg(h).alias("hallucination"), F.avg(g).alias("grounding"),
        F.avg(F.when(n > 0, h)).alias("hallucination_covered"), F.avg(F.when(n > 0, g)).alias("grounding_covered"), F.count_if(n > 0).alias("with_claims"), F.count_if(n == 0).alias("without_claims"),
    )


def judge_compare(evaluated: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model."""
    metrics = [c for c in evaluated.columns if c != "model"]
    long = evaluated.select("model", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("model", metrics, "metric", "value")
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def hybrid_summary(records: DataFrame) -> DataFrame:
    """One row: means of rule, retrieval and hybrid scores, rounded to 4."""
    return records.agg(*[F.round(F.round(F.avg(f"{kind}_{s}"), 9), 4).alias(f"{kind}_{s}") for kind in ("rule", "retrieval", "hybrid") for s in ("hallucination", "grounding")])


def claim_of(violation: Column) -> Column:
    """A violation's label: normalised, else raw, else plain, whichever is not empty; counted once."""
    return F.coalesce(*[F.nullif(violation[n], F.lit("")) for n in ("claim_normalized", "claim_raw", "claim")])


# The categories of unsupported claims and what tells them.
LABEL_SPACE, TRAIN_CAR, NEGATED, VEHICLE_TYPE, UNVERIFIED = "out_of_label_space", "semantic_mismatch_train_car", "caption_negation_conflict", "vehicle_type_confusion", "unverified_object"
RAILS = ("train", "rail", "tram")
NOBODY = ("no people", "no person", "nobody")
VEHICLES = ("car", "truck", "bus", "motorcycle", "bicycle")
# End of the fixed values.


def violation_category(claim: Column, caption: Column, detected: Column, classes: tuple[str, ...] = tuple(captions.CATEGORIES)) -> Column:
    """Why a claim is unsupported, the first that holds: it is none of the detector's classes; it is a car and the caption tells
    of rails; it is a person and the caption says there is none; it is a vehicle and another one, but not it, was detected;
    or it can't be told. Claim and classes in lower case."""
    family = F.array(*[F.lit(v) for v in VEHICLES])
    said = F.lower(F.coalesce(caption, F.lit("")))
    seen = F.transform(F.coalesce(detected, F.array().cast("array<string>")), lambda x: F.lower(x))

    def says(words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(said, w))

    return (
        F.when(~F.array_contains(F.array(*[F.lit(c) for c in classes]), claim), LABEL_SPACE)
        .when((claim == "car") & says(RAILS), TRAIN_CAR)
        .when((claim == "person") & says(NOBODY), NEGATED)
        .when(F.array_contains(family, claim) & F.arrays_overlap(F.array_compact(seen), family) & ~F.coalesce(F.array_contains(seen, claim), F.lit(False)), VEHICLE_TYPE)
        .otherwise(UNVERIFIED)
    )


def violation_claims(records: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, claim, type) of every violation that has a label. Violations are structs, or plain strings, whose type is null."""
    each = records.select(*keep, F.explode("violations").alias("v"))
    plain = each.schema["v"].dataType.simpleString() == "string"
    claim = F.nullif("v", F.lit("")) if plain else claim_of(F.col("v"))
    return each.select(*keep, claim.alias("claim"), (F.lit(None).cast("string") if plain else F.col("v.type")).alias("type")).where("claim is not null")


def categorised_violations(records: DataFrame, classes: tuple[str, ...] = tuple(captions.CATEGORIES)) -> DataFrame:
    """(image, model, claim, category) of every claim whose object was not detected, in lower case."""
    named = violation_claims(records, ["image", "model", "caption", "detected_classes"]).where("type = 'object_not_detected'")
    named = named.withColumn("claim", F.trim(F.lower("claim")))
    return named.select("image", "model", "claim", violation_category(F.col("claim"), F.col("caption"), F.col("detected_classes"), classes).alias("category"))


def violation_report(violations: DataFrame) -> DataFrame:
    return violations.groupBy("model", "category").agg(F.count("*").alias("n"))


def violation_examples(violations: DataFrame, per_category: int = 5) -> DataFrame:
    order = W.partitionBy("model", "category").orderBy("image", "claim")
    return violations.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_category)


def top_claims(violations: DataFrame, n: int = 10) -> DataFrame:
    return violations.groupBy("claim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "claim").limit(n)


BINS = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)


def score_histogram(records: DataFrame, score: str = "hallucination", keys: tuple[str, ...] = ("model",), bins: tuple[float, ...] = BINS) -> DataFrame:
    """Rows per bin [low, high), the last one closed."""
    c = F.col(score)
    low = F.lit(None).cast("double")
    for a, b in zip(bins, bins[1:]):
        low = F.when((c >= a) & ((c <= b) if b == bins[-1] else (c < b)), F.lit(a)).otherwise(low)
    return records.withColumn("bin", low).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))
