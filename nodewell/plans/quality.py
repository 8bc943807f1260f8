"""Queries on vectors, captions and judged records."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodewell.functions import captions, vectors as V
from nodewell.operators import enrich, judge, stability
from nodewell.plans.inputs import JUDGED, judged, outputs, rounded, table, vectors

ONE_RUN = "(select label as image_id, vec_id % 3 as device, embedding as v from embeddings)"


def _stable(spark, sf):
    v = vectors(spark, sf)
    nested = v.groupBy("model", "device", "image_id", "task").agg(F.collect_list(F.struct("embedding", F.lit(None).cast("array<float>").alias("text_embedding"), "error", "text")).alias("outputs"))
    return stability.repeat_stability(nested)


def repeat_stability(spark, sf):
    return rounded(_stable(spark, sf).withColumn("texts", F.array_join(F.array_sort("texts"), ",")), 5)


def stability_summary(spark, sf):
    return rounded(stability.stability_summary(_stable(spark, sf)), 5)


def least_stable_examples(spark, sf):
    return rounded(stability.least_stable_examples(_stable(spark, sf).withColumns({"stability": F.round("stability", 5), "texts": F.array_join(F.array_sort("texts"), ",")}), 0.99, 3), 5)


def cross_device_pairs(spark, sf):
    v = vectors(spark, sf)
    one = v.groupBy("model", "image_id", "task", "device").agg(F.min_by(F.struct("text", "embedding"), "vec_id").alias("m"))
    return rounded(stability.cross_device_pairs(one.select("model", "image_id", "task", "device", "m.text", "m.embedding", F.lit(0).alias("pos"), F.lit("").alias("error"))), 5)


def cross_device_agreement(spark, sf):
    return rounded(stability.cross_device_agreement(stability.cross_device_pairs(vectors(spark, sf), "mean")), 5)


def semantic_duplicates(spark, sf):
    found = stability.semantic_duplicates(vectors(spark, sf), ["image_id"], "vec_id", limit=0.3)
    return found.groupBy("image_id").agg(F.count("*").alias("rows"), F.max("links").alias("most_links"), (F.sum("links") / 2).cast("bigint").alias("pairs"), F.round(F.sum("total") / 2, 3).alias("total"))


def knn_captions(spark, sf):
    e = table(spark, sf, "embeddings")
    near = V.topk_l2(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "corpus_id"))
    return near.select("query_id", "rank", "corpus_id", F.round("distance", 4).alias("distance"))


def caption_similarity(spark, sf):
    v = vectors(spark, sf)
    refs = v.where("pos = 0").select("image_id", "embedding")
    out = enrich.caption_similarity(v.select("vec_id", "image_id", "embedding"), refs)
    return rounded(out.drop("embedding"), 5)


def clip_scores(spark, sf):
    v = vectors(spark, sf)
    images = v.groupBy("image_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    out = enrich.clip_scores(v.select("vec_id", "image_id", "embedding", "text", F.when(F.col("vec_id") % 7 == 0, "failed").alias("error")), images)
    return rounded(out.select("vec_id", "clipscore_cos", "clipscore"), 5)


def entity_recall(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", captions.entity_recall(F.col("text"), ["the", "train", "and", "person", "on the"]).alias("recall"))


SCENES = ("near dining tables", "with a dog", "by parked trucks", "and potted plants, a plant")


def caption_claims(spark, sf):
    """Captions made of each part's name, type and one of four scenes, by its size, parsed into claims."""
    p = table(spark, sf, "part")
    scene = F.element_at(F.array(*[F.lit(x) for x in SCENES]), (F.col("p_size") % 4 + 1).cast("int"))
    said = F.concat_ws(" ", F.lit("Two men and a"), "p_name", scene, F.lit(", with 3 chairs on"), "p_type", F.lit("street"))
    two, one = captions.parse_caption(said), captions.parse_caption(said, 1)
    return p.select("p_partkey", F.array_join(two["objects"], ",").alias("objects"), F.array_join(one["objects"], ",").alias("objects_1"), F.array_join(two["colors"], ",").alias("colors"), F.size(two["counts"]).alias("n_counts"))


def rule_judge(spark, sf):
    j = judged(spark, sf).select("image", F.transform("claims", F.lower).alias("claims"), F.transform("detected_classes", F.lower).alias("seen"))
    r = j.select("image", judge.rule_judge(F.col("claims"), F.col("seen")).alias("r"))
    return rounded(r.select("image", "r.checked", "r.supported", "r.unsupported", "r.hallucination", "r.grounding", F.array_join("r.unsupported_claims", ",").alias("unsupported_claims")))


def judge_eval(spark, sf):
    return rounded(judge.judge_eval(judged(spark, sf).withColumn("claims", F.when(F.size("claims") > 1, F.col("claims")))))


MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def judge_compare(spark, sf):
    return rounded(judge.judge_compare(judge_eval(spark, sf), MODELS))


#: What a part's type stands for, as a class, and what an image's caption says, by its number.
CLASSES = {"ECONOMY": "car", "STANDARD": "Person", "PROMO": "bus", "LARGE": "train", "SMALL": "unicorn", "MEDIUM": "truck"}
SAYINGS = ("A tram passes", "nobody here", "a car that is not here", None)


def _violations(spark, sf):
    none = F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    called = lambda c: F.try_element_at(names, c)
    number = F.col("image").cast("bigint")
    v = F.transform("bad", lambda c, i: F.struct(F.when((number + i) % 5 == 0, "too_many_claims").otherwise("object_not_detected").alias("type"), called(c).alias("claim"), F.when(number % 2 == 0, called(c)).alias("claim_raw"), none.alias("claim_normalized")))
    caption = F.element_at(F.array(*[F.lit(x) for x in SAYINGS]), (number % 4 + 1).cast("int"))
    return judge.categorised_violations(judged(spark, sf).select("image", "model", caption.alias("caption"), F.transform("detected_classes", called).alias("detected_classes"), v.alias("violations")))


def violation_report(spark, sf):
    return judge.violation_report(_violations(spark, sf))


def violation_examples(spark, sf):
    return judge.violation_examples(_violations(spark, sf))


def top_claims(spark, sf):
    return judge.top_claims(_violations(spark, sf), 4)


def hybrid_summary(spark, sf):
    j = judged(spark, sf)
    return judge.hybrid_summary(j.select(*[(F.col(s) * w).alias(f"{kind}_{s}") for kind, w in (("rule", 1.0), ("retrieval", 0.5), ("hybrid", 0.25)) for s in ("hallucination", "grounding")]))


def score_histogram(spark, sf):
    return judge.score_histogram(judged(spark, sf))


def hybrid_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    corpus = e.select(F.col("vec_id").alias("corpus_id"), "embedding", F.when(F.col("vec_id") % 11 != 0, "a caption").otherwise(" ").alias("caption"), F.when(F.col("vec_id") % 3 != 0, F.col("label") / 10.0).alias("hallucination"), (1 - F.col("label") / 10.0).alias("grounding"))
    r = judge.retrieval_scores(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), corpus)
    mixed = judge.hybrid(F.lit(0.5), F.col("retrieval_hallucination"))
    return rounded(r.withColumn("hybrid_hallucination", mixed))


QUERIES = [
    repeat_stability, stability_summary, least_stable_examples, cross_device_pairs, cross_device_agreement, semantic_duplicates, knn_captions, caption_similarity, clip_scores,
    entity_recall, caption_claims, rule_judge, judge_eval, judge_compare, violation_report, violation_examples, top_claims, hybrid_summary, score_histogram, hybrid_scores,
]

E = "(select vec_id, label as image_id, cast(embedding as double[]) as v from embeddings)"
STABLE = f"""
    select 'm' as model, 'd' || d as device, cast(image_id as bigint) as image_id, 't' as task, cast(n as int) as repeats, s as stability, texts from (
      select a.vec_id % 3 as d, a.image_id, avg(list_cosine_similarity(a.v, b.v)) as s from {E} a join {E} b on a.image_id = b.image_id and a.vec_id % 3 = b.vec_id % 3 and a.vec_id < b.vec_id group by all)
      join (select vec_id % 3 as d, image_id, count(*) as n, array_to_string(list_sort(list('text ' || vec_id)), ',') as texts from {E} group by all) using (d, image_id)"""
FIRST = f"(select image_id, 'd' || (vec_id % 3) as device, min_by(v, vec_id) as v, 'text ' || min(vec_id) as text from {E} group by all)"
MEAN = f"""(select image_id, device, list(x order by k) as v from (select image_id, 'd' || (vec_id % 3) as device, k, avg(v[k]) as x from {E}, range(1, 65) t(k) group by all) group by all)"""
EVAL = f"""
    select model, count(*) as n, round(avg(cast(len(claims) > 1 as int)), 6) as coverage, round(avg(case when len(claims) > 1 then len(claims) else 0 end), 6) as claims_per_caption,
           round(avg(coalesce(hallucination, 0)), 6) as hallucination, round(avg(coalesce(grounding, 0)), 6) as grounding,
           round(avg(coalesce(hallucination, 0)) filter (where len(claims) > 1), 6) as hallucination_covered, round(avg(coalesce(grounding, 0)) filter (where len(claims) > 1), 6) as grounding_covered,
           count(*) filter (where len(claims) > 1) as with_claims, count(*) filter (where len(claims) <= 1) as without_claims
    from ({JUDGED}) group by model"""
NAMES = "map {{{}}}".format(", ".join(f"'{a}': '{b.lower()}'" for a, b in CLASSES.items()))
FAMILY = "['car', 'truck', 'bus', 'motorcycle', 'bicycle']"
VIOLATIONS = f"""
    select image, model, claim, case when claim = 'unicorn' then 'out_of_label_space' when claim = 'car' and n % 4 = 0 then 'semantic_mismatch_train_car'
               when claim = 'person' and n % 4 = 1 then 'caption_negation_conflict' when list_contains({FAMILY}, claim) and list_has_any({FAMILY}, seen) and not list_contains(seen, claim) then 'vehicle_type_confusion'
               else 'unverified_object' end as category
    from (select *, {NAMES}[b] as claim, cast(image as bigint) as n from (
      select image, model, unnest(bad) as b, unnest(range(len(bad))) as i, list_transform(detected, lambda d: {NAMES}[d]) as seen from ({JUDGED})))
    where (n + i) % 5 <> 0 and claim is not null"""
METRICS = "n coverage claims_per_caption hallucination grounding hallucination_covered grounding_covered with_claims without_claims".split()
KNN = f"""
    select q.vec_id as query_id, c.vec_id as corpus_id, list_distance(q.v, c.v) ** 2 as d, c.image_id as label,
           row_number() over (partition by q.vec_id order by round(list_distance(q.v, c.v) ** 2, 12), c.vec_id) as rank
    from {E} q, {E} c where q.vec_id % 20 = 0"""

ORACLE = {
    "repeat_stability": f"select * replace (round(stability, 5) as stability) from ({STABLE})",
    "stability_summary": f"""
        select model, device, count(*) as n, round(avg(stability), 5) as mean, round(quantile_cont(stability, 0.5), 5) as median, round(quantile_cont(stability, 0.05), 5) as p5,
               round(quantile_cont(stability, 0.1), 5) as p10, round(min(stability), 5) as min, round(avg(cast(stability < 0.85 as int)), 5) as share_below_85,
               round(avg(cast(stability < 0.9 as int)), 5) as share_below_90, round(avg(cast(stability < 0.95 as int)), 5) as share_below_95 from ({STABLE}) group by all""",
    "least_stable_examples": f"""
        select * from (select * replace (round(stability, 5) as stability), cast(row_number() over (partition by model, device order by round(stability, 5), image_id, task) as int) as rank
                       from ({STABLE}) where stability < 0.99) where rank <= 3""",
    "cross_device_pairs": f"""
        select 'm' as model, cast(a.image_id as bigint) as image_id, 't' as task, a.device as device_a, b.device as device_b, a.text as text_a, b.text as text_b,
               round(list_cosine_similarity(a.v, b.v), 5) as cosine from {FIRST} a join {FIRST} b on a.image_id = b.image_id and a.device < b.device""",
    "cross_device_agreement": f"""
        select 'm' as model, round(avg(c), 5) as mean, round(min(c), 5) as min, round(stddev_pop(c), 5) as std, count(*) as n_pairs
        from (select list_cosine_similarity(a.v, b.v) as c from {MEAN} a join {MEAN} b on a.image_id = b.image_id and a.device < b.device)""",
    "semantic_duplicates": f"""
        select cast(image_id as bigint) as image_id, count(*) as rows, max(n) as most_links, cast(sum(n) / 2 as bigint) as pairs, round(sum(c) / 2, 3) as total from (
          select image_id, vec_id, count(*) as n, sum(c) as c from (
            select a.image_id, a.vec_id, list_cosine_similarity(a.v, b.v) as c from {E} a join {E} b on a.image_id = b.image_id and a.vec_id <> b.vec_id) where c >= 0.3 group by all) group by 1""",
    "knn_captions": f"select query_id, cast(rank as int) as rank, corpus_id, round(d, 4) as distance from ({KNN}) where rank <= 5",
    "caption_similarity": f"""
        select a.vec_id, cast(a.image_id as bigint) as image_id, round(max(list_cosine_similarity(a.v, b.v)), 5) as caption_similarity_max, round(avg(list_cosine_similarity(a.v, b.v)), 5) as caption_similarity_mean
        from {E} a left join (select * from {E} where vec_id % 5 = 0) b on a.image_id = b.image_id group by 1, 2""",
    "clip_scores": f"""
        select vec_id, round(c, 5) as clipscore_cos, case when c is not null then round(greatest(0, 2.5 * c), 5) end as clipscore from (
          select a.vec_id, case when a.vec_id % 7 <> 0 then list_cosine_similarity(a.v, b.v) end as c
          from {E} a join (select image_id, min_by(v, vec_id) as v from {E} group by 1) b on a.image_id = b.image_id)""",
    "entity_recall": """
        select doc_id, case when text = '' then 0.0 else round((cast(regexp_matches(t, '\\bthes?\\b') as int) + cast(regexp_matches(t, '\\btrains?\\b|\\blocomotives?\\b') as int)
               + cast(regexp_matches(t, '\\bands?\\b') as int) + cast(contains(t, 'on the') as int)
               + cast(regexp_matches(t, '\\b(person|man|woman|boy|girl|child|kid|people|individual|human|lady|gentleman|guy)s?\\b') as int)) / 5, 4) end as recall
        from (select doc_id, text, lower(text) as t from documents)""",
    "caption_claims": """
        select p_partkey, case p_size % 4 when 0 then 'dining table,person,chair,street' when 1 then 'person,dog,chair,street' when 2 then 'person,truck,chair,street' else 'potted plant,person,chair,street' end as objects,
               case p_size % 4 when 0 then 'dining table,person,chair,street' when 1 then 'person,dog,chair,street' when 2 then 'person,truck,chair,street' else 'potted plant,person,plant,chair,street' end as objects_1,
               case when regexp_matches(p_name, '\\b(red|blue|green|yellow|black|white|gray|grey|brown|orange|pink|purple)\\b')
               then regexp_extract(p_name, '\\b(red|blue|green|yellow|black|white|gray|grey|brown|orange|pink|purple)\\b', 1) else '' end as colors, cast(1 as int) as n_counts from part""",
    "rule_judge": f"""
        select image, cast(len(claims) as int) as checked, cast(len(claims) - len(bad) as int) as supported, cast(len(bad) as int) as unsupported, round(len(bad) / len(claims), 6) as hallucination,
               round((len(claims) - len(bad)) / len(claims), 6) as grounding, lower(array_to_string(bad, ',')) as unsupported_claims from ({JUDGED})""",
    "judge_eval": EVAL,
    "judge_compare": "select metric, "
    + ", ".join(f"round(max(value) filter (where model = '{m}'), 6) as \"{m}\"" for m in MODELS)
    + f" from (select model, unnest({METRICS}) as metric, unnest([{', '.join(f'cast({m} as double)' for m in METRICS)}]) as value from ({EVAL})) group by metric",
    "violation_report": f"select model, category, count(*) as n from ({VIOLATIONS}) group by all",
    "violation_examples": f"select * from (select *, cast(row_number() over (partition by model, category order by image, claim) as int) as rank from ({VIOLATIONS})) where rank <= 5",
    "top_claims": f"select claim, count(*) as n from ({VIOLATIONS}) group by 1 order by n desc, claim limit 4",
    "hybrid_summary": "select "
    + ", ".join(f"cast(round(cast(avg({s} * {w}) as decimal(18, 9)), 4) as double) as {kind}_{s}" for kind, w in (("rule", 1), ("retrieval", 0.5), ("hybrid", 0.25)) for s in ("hallucination", "grounding"))
    + f" from ({JUDGED})",
    "score_histogram": f"""
        select model, bin, count(*) as n from (select model, case when hallucination < 0.01 then 0.0 when hallucination < 0.25 then 0.01 when hallucination < 0.5 then 0.25
               when hallucination < 0.75 then 0.5 else 0.75 end::double as bin from ({JUDGED})) group by all""",
    "hybrid_scores": f"""
        with near as (select *, row_number() over (partition by query_id order by rank) as r from ({KNN}) where corpus_id % 11 <> 0)
        select query_id, round(h, 6) as retrieval_hallucination, round(g, 6) as retrieval_grounding, round(0.7 * 0.5 + 0.3 * h, 6) as hybrid_hallucination from (
          select query_id, coalesce(avg(case when corpus_id % 3 <> 0 then label / 10 end), 1) as h, coalesce(avg(1 - label / 10), 0) as g from near where r <= 5 group by 1)""",
}
