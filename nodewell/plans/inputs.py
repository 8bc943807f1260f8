"""How the given tables stand in for the jobs' inputs: the same projection as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order of additions."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs: line items, their order as the record, priority as model, status as device, part type as task."""
    items, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    flat = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    return flat.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("part_id"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("device"),
        F.col("p_type").alias("task"),
        F.when(F.col("l_returnflag") != "R", F.col("p_name")).otherwise(" ").alias("text"),
        F.when(F.col("l_quantity") > 2, F.col("l_quantity") / 10).alias("latency"),
        F.col("l_discount").alias("entity_recall"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("count_exact_accuracy"),
        (F.col("l_tax") * 10).alias("count_mae"),
        (F.col("l_extendedprice") / 1000).alias("tokens_per_sec"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("gen_len"),
        F.when(F.col("l_tax") > 0.07, "failed").alias("error"),
    )


OUTPUTS = """
    select l_orderkey as image_id, l_linenumber as pos, l_partkey as part_id, o_orderpriority as model, o_orderstatus as device, p_type as task,
           case when l_returnflag <> 'R' then p_name else ' ' end as text, case when l_quantity > 2 then l_quantity / 10 end as latency,
           l_discount as entity_recall, case when l_linestatus = 'O' then l_tax end as count_exact_accuracy, l_tax * 10 as count_mae,
           l_extendedprice / 1000 as tokens_per_sec, cast(floor(l_extendedprice / 100) as int) as gen_len, case when l_tax > 0.07 then 'failed' end as error
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested run records, one per order, with or without items: the outputs as an array, the order's price as its power and task."""
    o = outputs(spark, sf_dir)
    fields = [
        F.col("pos").alias("run"), "text", F.col("latency").alias("gen_latency_s"), "gen_len", F.lit(10).alias("input_len"), F.when(F.col("entity_recall") > 0, F.col("tokens_per_sec")).alias("tokens_per_sec"),
        F.when(F.col("count_mae") > 0, F.lit(1.5)).alias("tokens_per_second"), "error", "entity_recall", F.struct("count_exact_accuracy", "count_mae").alias("count_accuracy"),
        F.col("entity_recall").alias("caption_similarity_max"), (F.col("entity_recall") / 2).alias("caption_similarity_mean"), F.col("count_mae").alias("clipscore_cos"),
        F.col("count_mae").alias("clipscore"),
    ]
    nested = o.groupBy("image_id").agg(F.collect_list(F.struct(*fields)).alias("outputs"))
    price = F.col("o_totalprice")
    hw = F.struct(
        (price / 10000).alias("power_watts_avg"), (price / 5000).alias("power_watts_peak"), F.when(price > 50000, price / 1000).alias("energy_joules_est"),
        F.lit(None).cast("double").alias("gpu_mem_alloc_gb_peak"), F.lit(50.0).alias("cpu_percent_avg"), (price / 7).alias("duration_seconds"), F.when(price > 100000, "meter").otherwise("board").alias("source"),
    )
    task = F.when(price > 150000, "objects_and_counts").otherwise("caption_brief")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("device"), task.alias("task"), hw.alias("hw_stats"))
    return orders.join(nested, "image_id", "left")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points: events, the user as the track, the event number as the frame, k of the properties as the place."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_type").alias("source"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), "ts", (k * 5).alias("cx"),
        k.cast("int").alias("x1"), (k + 7).cast("int").alias("y1"), (k * 2 + 10).cast("int").alias("x2"), (k * 3 + 20).cast("int").alias("y2"),
    )


POINTS = """
    select event_type as source, user_id as track_id, event_id as frame_idx, ts, k * 5 as cx, k as x1, k + 7 as y1, k * 2 + 10 as x2, k * 3 + 20 as y2
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement events: the type gives the direction, value the telemetry, small values the missing mark -1."""
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("event_type").isin("view", "click"), "Right").when(F.col("event_type") != "error", "Left")
    v = F.when(F.col("value") < 5, F.lit(-1.0)).otherwise(F.col("value"))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"), side.alias("Direction"), v.alias("CPU_usage"),
        (F.col("value") / 2).alias("GPU_usage"), (F.col("value") * 3).alias("mem_usage"), v.alias("CPU_temp"), F.lit(-1.0).alias("GPU_temp"),
    )


MINUTES = """
    select strftime(ts, '%Y-%m-%d') as Date, strftime(ts, '%H:%M') as Time,
           coalesce(cast(round(cast(avg(case when value >= 5 then value end) as decimal(18, 9)), 2) as double), -1) as CPU_usage, coalesce(cast(round(cast(avg(value / 2) as decimal(18, 9)), 2) as double), -1) as GPU_usage,
           coalesce(cast(round(cast(avg(value * 3) as decimal(18, 9)), 2) as double), -1) as mem_usage, coalesce(cast(round(cast(avg(case when value >= 5 then value end) as decimal(18, 9)), 2) as double), -1) as CPU_temp, cast(-1 as double) as GPU_temp,
           count(*) filter (where event_type in ('signup', 'purchase')) as direction_left, count(*) filter (where event_type in ('view', 'click')) as direction_right
    from events group by 1, 2"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged captions: orders as images, priority as model, the part types of their items as claims against those of returned items."""
    o = outputs(spark, sf_dir)
    g = o.groupBy(F.col("image_id").cast("string").alias("image"), "model").agg(
        F.array_sort(F.collect_set("task")).alias("claims"), F.array_sort(F.collect_set(F.when(F.col("text") == " ", F.col("task")))).alias("detected_classes")
    )
    bad = F.array_except("claims", "detected_classes")
    return g.withColumns({"bad": bad, "hallucination": F.size(bad) / F.size("claims"), "grounding": F.when(F.size("claims") > 2, 1 - F.size(bad) / F.size("claims"))})


JUDGED = f"""
    select *, len(bad) / len(claims) as hallucination, case when len(claims) > 2 then 1 - len(bad) / len(claims) end as grounding from (
      select *, list_filter(claims, lambda c: not list_contains(detected, c)) as bad from (
        select cast(image_id as varchar) as image, model, list_sort(list_distinct(list(task))) as claims,
               coalesce(list_sort(list_distinct(list(task) filter (where text = ' '))), []) as detected
        from ({OUTPUTS}) group by 1, 2))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded outputs: the label as image, vec_id % 5 as repeat, % 3 as device."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "embedding", F.col("label").cast("bigint").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("pos"), F.concat(F.lit("d"), F.col("vec_id") % 3).alias("device"),
        F.lit("m").alias("model"), F.lit("t").alias("task"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"),
    )
