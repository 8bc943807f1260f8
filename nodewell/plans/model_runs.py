"""Queries on model runs: latency, summaries, deployments, power, trade-offs, reports, pending work."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodewell.functions import scalars
from nodewell.operators import enrich, stats
from nodewell.plans.inputs import OUTPUTS, outputs, rounded, runs, table

KEYS = ["model", "device", "task"]
STRICT = f"select * from ({OUTPUTS}) where trim(text) <> '' and latency > 0"


def _to(value: str, places: int) -> str:
    """Rounded in decimals, so that a tie is rounded up as in Spark."""
    return f"cast(round(cast({value} as decimal(18, 9)), {places}) as double)"


P = "quantile_cont(latency, {})".format
TAIL = f"""
    select model, device, task, count(*) as n, {_to(P(0.5), 4)} as p50, {_to(P(0.95), 4)} as p95, {_to(P(0.99), 4)} as p99, {_to('max(latency)', 4)} as max,
           {_to('avg(latency)', 4)} as mean, {_to('stddev_pop(latency)', 4)} as std, {_to(f"{P(0.99)} / {P(0.5)}", 3)} as tail_ratio
    from ({STRICT}) group by all"""


def latency_tail(spark, sf):
    return stats.latency_tail(enrich.usable_latencies(outputs(spark, sf)), KEYS)


def latency_tail_ranks(spark, sf):
    return stats.latency_tail(enrich.usable_latencies(outputs(spark, sf)), KEYS, map_rows=0)


def latency_tail_plain(spark, sf):
    return rounded(stats.latency_tail(enrich.usable_latencies(outputs(spark, sf), "lenient"), KEYS[:2], variant="plain"))


def tail_by_model(spark, sf):
    return rounded(stats.tail_by_model(latency_tail(spark, sf)))


def headline_tails(spark, sf):
    return stats.headline_tails(latency_tail(spark, sf), 1.9)


def load_audit(spark, sf):
    return stats.load_audit(outputs(spark, sf))


def model_device_summary(spark, sf):
    return rounded(stats.model_device_summary(runs(spark, sf)))


def output_latencies(spark, sf):
    """Outputs of the records, numbered, with the asked latency or whichever is there; valid tells those without an error."""
    o = F.transform("outputs", lambda x: F.struct(x["run"].alias("run"), x["error"].alias("error"), F.when(x["run"] % 2 == 0, x["gen_latency_s"]).alias("gen_latency_s"), F.when(x["run"] % 3 == 0, x["gen_latency_s"] * 2).alias("total_latency_s"), (x["gen_latency_s"] * 3).alias("latency_s"), F.when(x["run"] > 1, F.array(F.lit(1.0))).alias("embedding"), F.lit(None).cast("array<double>").alias("text_embedding")))
    each = enrich.explode_outputs(runs(spark, sf).withColumn("outputs", F.array_sort(o))).withColumn("seconds", scalars.latency_of("o", "total_latency_s"))
    valid = enrich.valid_outputs(each).groupBy("image_id").agg(F.count("*").alias("n_valid"))
    g = each.groupBy("image_id").agg(F.count("pos").alias("n"), F.count_if(F.col("pos").isNull()).alias("without"), F.round(F.sum("seconds"), 4).alias("seconds"), F.round(F.sum(F.col("pos") * F.col("seconds")), 4).alias("weighed"))
    return g.join(valid, "image_id", "left")


def task_breakdown(spark, sf):
    return rounded(stats.task_breakdown(outputs(spark, sf).withColumn("task", F.when(F.col("task") == "ECONOMY", "objects_and_counts").otherwise(F.col("task")))))


def deployment_summary(spark, sf):
    o = outputs(spark, sf)
    runs_ = o.select(F.concat_ws("|", "model", "device").alias("run_group"), "error", (F.col("latency") * 1000).alias("latency_ms"), F.round(F.try_divide(F.lit(1.0), F.col("latency")), 4).alias("images_per_second"))
    return rounded(stats.deployment_summary(runs_), 3)


def _rail_samples(spark, sf):
    """Events as samples of a user's board: the type tells which rails a sample has, so runs differ in what they have of each."""
    e = table(spark, sf, "events")
    kind, v = F.col("event_type"), F.col("value")
    own = {"VIN": F.when((kind == "click") & (F.col("user_id") % 3 == 0), v), "VDD_GPU_SOC": F.when(kind != "view", v / 2), "VDD_CPU_CV": F.when((kind == "view") & (F.col("user_id") % 3 == 1), v / 4), "VIN_SYS_5V0": F.when(kind == "purchase", v / 8)}
    rails = F.map_filter(F.create_map(*[x for n, c in own.items() for x in (F.lit(n), c)]), lambda _, x: x.isNotNull())
    return e.select(F.col("user_id").alias("run"), "ts", rails.alias("rails"))


def power_summary(spark, sf):
    return stats.power_summary(_rail_samples(spark, sf))


def gpu_power_summary(spark, sf):
    return stats.power_summary(_rail_samples(spark, sf), edition="gpu").drop("power_watts_peak")


def meter_summary(spark, sf):
    return stats.meter_summary(table(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", F.col("value").alias("watts")))


def rail_summary(spark, sf):
    e = table(spark, sf, "events")
    return rounded(stats.rail_summary(e.select(F.col("user_id").alias("run"), F.create_map(F.col("event_type"), F.col("value")).alias("rails"))))


def filter_describe(spark, sf):
    return rounded(stats.filter_describe(table(spark, sf, "events").select(F.col("event_type").alias("filter"), F.col("value").alias("fps"))))


def resource_curve(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("filter"), (F.col("event_id") % 100).alias("frame_index"), F.col("value").alias("cpu_percent"), F.when(F.col("value") > 50, F.col("value")).alias("gpu_percent"))
    return rounded(stats.resource_curve(e, ["cpu_percent", "gpu_percent"]))


def frame_rate(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return stats.frame_rate(e.withColumn("seconds", F.floor("seconds")), "user_id", "seconds", ("event_id",)).select("event_id", F.round("fps", 2).alias("fps"))


def tradeoff_table(spark, sf):
    o = outputs(spark, sf).withColumn("power_watts", F.col("count_mae"))
    agreement = o.groupBy("model").agg(F.max("entity_recall").alias("min_agreement"))
    return rounded(stats.tradeoff_table(o, agreement))


def spreads(spark, sf):
    return rounded(stats.spreads(tradeoff_table(spark, sf), ["latency", "tokens_per_sec", "recall"]))


def hallucination_report(spark, sf):
    o = outputs(spark, sf)
    return rounded(stats.hallucination_report(o.withColumn("text", F.when(F.col("error").isNotNull(), F.concat(F.lit("I'm sorry, no "), "text")).otherwise(F.col("text"))), min_chars=8))


def flagged_outputs(spark, sf):
    o = outputs(spark, sf).withColumn("text", F.when(F.col("error").isNotNull(), F.concat(F.lit("As an AI, "), "text")).otherwise(F.col("text")))
    return stats.flagged_outputs(o, ["image_id", "pos", "part_id"], min_chars=8).distinct()


def tokens_per_second(spark, sf):
    o = outputs(spark, sf)
    return o.select("image_id", "pos", "part_id", "gen_len", scalars.tokens_per_second(F.col("gen_len"), F.col("latency")).alias("tps")).groupBy("image_id").agg(F.count("tps").alias("n"), F.round(F.sum("tps"), 3).alias("tps"))


TASKS = ["ECONOMY", "STANDARD", "PROMO", "LARGE"]


def pending_work(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return enrich.pending_work(images, TASKS, outputs(spark, sf))


def completed_images(spark, sf):
    return enrich.completed_images(outputs(spark, sf), TASKS[:2])


def ground_truth(spark, sf):
    counts = outputs(spark, sf).groupBy("image_id", F.col("task").alias("category")).agg(F.count("*").alias("n"))
    joined = enrich.attach_ground_truth(table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")), counts)
    listed = F.transform("expected_entities", lambda c: F.concat_ws(":", c, F.try_element_at("expected_counts", c).cast("string")))
    return joined.select("image_id", F.array_join("expected_entities", ",").alias("entities"), F.array_join(listed, ",").alias("counts"))


def run_union(spark, sf):
    from nodewell.sources.runs import union_runs

    o = outputs(spark, sf)
    a = o.where("device = 'F'").select("model", "latency")
    b = o.where("device = 'O'").select("model", "gen_len")
    return rounded(union_runs(a, b).groupBy("model").agg(F.count("*").alias("n"), F.avg("latency").alias("latency"), F.avg("gen_len").alias("gen_len")))


QUERIES = [
    latency_tail, latency_tail_ranks, latency_tail_plain, tail_by_model, headline_tails, load_audit, model_device_summary, task_breakdown, deployment_summary, power_summary, gpu_power_summary, meter_summary, output_latencies, rail_summary,
    filter_describe, resource_curve, frame_rate, tradeoff_table, spreads, hallucination_report, flagged_outputs, tokens_per_second, pending_work, completed_images, ground_truth, run_union,
]

TRADEOFF = f"""
    select g.model || '|' || g.device as name, g.*, min_agreement < 0.98 as drift from (
      select model, device, count(distinct image_id) as images, avg(entity_recall) as recall, avg(tokens_per_sec) as tokens_per_sec, avg(latency) as latency,
             avg(count_mae) as power_watts from ({OUTPUTS}) group by all) g
    left join (select model, max(entity_recall) as min_agreement from ({OUTPUTS}) group by all) a on a.model = g.model"""


def _nearest(value: str, name: str) -> str:
    ranks = ", ".join(_to(f"list_sort(list(v))[1 + cast(round_even({p} / 100 * (count(*) - 1), 0) as int)]", 3) + f" as {name}_p{p}" for p in (50, 90, 99))
    return f"select g, {_to('avg(v)', 3)} as {name}_mean, {_to('min(v)', 3)} as {name}_min, {_to('max(v)', 3)} as {name}_max, {ranks} from (select model || '|' || device as g, {value} as v from ({OUTPUTS}) where error is null) where v is not null group by g"


RAILS = """
    select user_id as run, avg(value) filter (where event_type = 'click' and user_id % 3 = 0) as vin, max(value) filter (where event_type = 'click' and user_id % 3 = 0) as peak,
           avg(value / 2) filter (where event_type <> 'view') as gpu, avg(value / 4) filter (where event_type = 'view' and user_id % 3 = 1) as cpu, avg(value / 8) filter (where event_type = 'purchase') as sys,
           count(*) as sample_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s from events group by 1"""

ORACLE = {
    "latency_tail": TAIL,
    "latency_tail_ranks": TAIL,
    "latency_tail_plain": f"""
        select model, device, count(*) as n, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(quantile_cont(latency, 0.99), 6) as p99,
               round(max(latency), 6) as max, round(avg(latency), 6) as mean, round(stddev_pop(latency), 6) as std, round(quantile_cont(latency, 0.99) / quantile_cont(latency, 0.5), 6) as tail_ratio,
               count(*) filter (where latency > 5) as over_5s, count(*) filter (where latency > 6) as over_6s, count(*) filter (where latency > 7) as over_7s
        from ({OUTPUTS}) where text <> '' and latency is not null group by all""",
    "tail_by_model": f"select model, round(avg(tail_ratio), 6) as mean_tail_ratio, round(max(tail_ratio), 6) as max_tail_ratio, count(*) as groups from ({TAIL}) group by model",
    "headline_tails": f"select *, tail_ratio > 1.9 as flag from ({TAIL})",
    "load_audit": f"""
        select cast(sum(t) as bigint) as total, cast(sum(e) as bigint) as excluded_empty, cast(sum(s) as bigint) as excluded_no_latency, cast(sum(t - e - s) as bigint) as kept,
               count(*) filter (where t > e + s) as groups
        from (select count(*) as t, count(*) filter (where trim(text) = '') as e, count(*) filter (where trim(text) <> '' and not coalesce(latency > 0, false)) as s
              from ({OUTPUTS}) group by model, device, task)""",
    "model_device_summary": f"""
        with o as (select * from ({OUTPUTS})), p as (select o_orderkey as id, o_orderpriority as model, o_orderstatus as device, o_totalprice as price from orders),
        n as (select image_id, count(*) as c from o group by 1),
        r as (select p.*, coalesce(c, 0) as c, c is not null as has from p left join n on image_id = id),
        a as (select model, device, count(*) as n_records, cast(sum(c) as bigint) as n_outputs, round(avg(price / 10000) filter (where has), 6) as power_watts_avg_mean,
                     round(avg(price / 5000) filter (where has), 6) as power_watts_peak_mean, avg(price / 1000) filter (where has and price > 50000) as energy, cast(null as double) as gpu_mem_gb_peak_mean,
                     round(avg(price / 7) filter (where has), 6) as duration_seconds_mean, case when bool_or(has) then 50::double end as cpu_percent_avg_mean,
                     min(case when price > 100000 then 'meter' else 'board' end) filter (where has) as hw_source from r group by 1, 2),
        b as (select o.model, o.device, count(entity_recall) as k, round(avg(entity_recall), 6) as entity_recall_mean, round(avg(count_exact_accuracy) filter (where price > 150000), 6) as count_exact_mean,
                     round(avg(count_mae) filter (where price > 150000), 6) as count_mae_mean, round(avg(entity_recall), 6) as caption_sim_max_mean, round(median(entity_recall), 6) as caption_sim_max_median,
                     round(avg(entity_recall / 2), 6) as caption_sim_mean_mean, round(avg(count_mae), 6) as clipscore_cos_mean, round(avg(latency * 1000), 6) as latency_ms_mean,
                     round(quantile_cont(latency * 1000, 0.5), 6) as latency_ms_p50, round(quantile_cont(latency * 1000, 0.9), 6) as latency_ms_p90, round(quantile_cont(latency * 1000, 0.99), 6) as latency_ms_p99,
                     avg(gen_len) as g, round(avg(case when entity_recall > 0 and tokens_per_sec <> 0 then tokens_per_sec when count_mae > 0 then 1.5 end), 6) as tokens_per_sec_mean
              from o join p on id = image_id where error is null group by 1, 2)
        select a.* exclude (energy), round(energy, 6) as energy_joules_mean, b.* exclude (model, device, g, k), coalesce(k, 0) as n_recall_valid, round(g, 6) as gen_len_mean,
               case when g <> 0 then round(1000 * energy / g, 6) end as energy_per_token_mj_mean
        from a left join b on a.model = b.model and a.device = b.device""",
    "output_latencies": f"""
        with o as (select image_id, pos, latency, error, row_number() over (partition by image_id order by pos, error nulls first, case when pos % 2 = 0 then latency end nulls first, latency nulls first) - 1 as p from ({OUTPUTS})),
        s as (select *, coalesce(case when pos % 3 = 0 then latency * 2 end, case when pos % 2 = 0 then latency end, latency * 3) as seconds from o)
        select o_orderkey as image_id, count(p) as n, count(*) - count(p) as without, round(sum(seconds), 4) as seconds, round(sum(p * seconds), 4) as weighed,
               nullif(count(*) filter (where p is not null and error is null and pos > 1), 0) as n_valid
        from orders left join s on image_id = o_orderkey group by 1""",
    "task_breakdown": f"""
        select model, device, case when task = 'ECONOMY' then 'objects_and_counts' else task end as task, count(entity_recall) as n, round(avg(entity_recall), 6) as entity_recall_mean,
               round(avg(case when task = 'ECONOMY' then count_exact_accuracy end), 6) as count_exact_mean, round(avg(case when task = 'ECONOMY' then count_mae end), 6) as count_mae_mean
        from ({OUTPUTS}) group by all""",
    "deployment_summary": f"""
        select b.g as run_group, records, errors, l.* exclude (g), t.* exclude (g) from
          (select model || '|' || device as g, count(*) as records, count(error) as errors from ({OUTPUTS}) group by 1) b
          left join ({_nearest('latency * 1000', 'latency')}) l on l.g = b.g left join ({_nearest('round(1 / latency, 4)', 'throughput')}) t on t.g = b.g""",
    "power_summary": f"""
        select run, {_to('w', 3)} as power_watts_avg, {_to('peak', 3)} as power_watts_peak, sample_count, {_to('s', 3)} as duration_seconds, case when w <> 0 and s <> 0 then {_to('w * s', 2)} end as energy_joules_est
        from (select run, coalesce(vin, gpu + cpu + coalesce(sys, 0), sys) as w, peak, sample_count, s from ({RAILS}))""",
    "gpu_power_summary": f"""
        select run, w as power_watts_avg, sample_count, {_to('s', 3)} as duration_seconds, case when w <> 0 and s <> 0 then {_to('w * s', 2)} end as energy_joules_est
        from (select run, {_to('gpu', 2)} as w, sample_count, s from ({RAILS}))""",
    "meter_summary": f"""
        select run, {_to('w', 2)} as power_watts_avg, {_to('p', 2)} as power_watts_peak, {_to('l', 2)} as power_watts_min, {_to('w * s', 2)} as energy_joules_est, sample_count, {_to('s', 3)} as duration_seconds
        from (select user_id as run, avg(value) as w, max(value) as p, min(value) as l, count(value) as sample_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s from events group by 1)""",
    "rail_summary": "select user_id as run, event_type as rail, round(avg(value), 6) as avg, round(max(value), 6) as peak, round(min(value), 6) as min from events group by all",
    "filter_describe": """
        select event_type as filter, count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as p25,
               round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, round(max(value), 6) as max from events group by 1""",
    "resource_curve": "select event_type as filter, event_id % 100 as frame_index, round(avg(value), 6) as cpu_percent, round(avg(case when value > 50 then value end), 6) as gpu_percent from events group by all",
    "frame_rate": """
        select event_id, case when d <= 0 then 0 else round(1 / d, 2) end as fps from (
          select event_id, cast(s - lag(s) over (partition by user_id order by s, event_id) as double) as d from (select event_id, user_id, epoch_us(ts) // 1000000 as s from events))""",
    "tradeoff_table": f"select * replace (round(recall, 6) as recall, round(tokens_per_sec, 6) as tokens_per_sec, round(latency, 6) as latency, round(power_watts, 6) as power_watts) from ({TRADEOFF})",
    "spreads": f"""
        select round(max(round(latency, 6)) / min(round(latency, 6)), 6) as latency_spread, round(max(round(tokens_per_sec, 6)) / min(round(tokens_per_sec, 6)), 6) as tokens_per_sec_spread,
               round(max(round(recall, 6)) / min(round(recall, 6)), 6) as recall_spread from ({TRADEOFF})""",
    "hallucination_report": f"""
        select * exclude (z), case when (empty + refusals + z) / outputs > 0.1 then 'high' when (empty + refusals + z) / outputs > 0.02 then 'medium' else 'low' end as severity from (
          select model, device, cast(sum(n) as bigint) as outputs, cast(coalesce(sum(n) filter (where t = ''), 0) as bigint) as empty, cast(coalesce(sum(n) filter (where t like 'I''m sorry%'), 0) as bigint) as refusals,
                 cast(coalesce(sum(n) filter (where length(t) >= 8 and n > 1), 0) as bigint) as surface_duplicates, round(sum(r) / sum(c), 6) as recall_mean, round(sum(z) / sum(c), 6) as recall_zero_rate, sum(z) as z
          from (select model, device, trim(case when error is not null then 'I''m sorry, no ' || text else text end) as t, count(*) as n, sum(entity_recall) as r, count(entity_recall) as c, count(*) filter (where entity_recall <= 0) as z from ({OUTPUTS}) group by all) group by all)""",
    "flagged_outputs": f"""
        with o as (select model, device, image_id, pos, part_id, entity_recall, trim(case when error is not null then 'As an AI, ' || text else text end) as text from ({OUTPUTS})),
        n as (select *, count(*) over (partition by model, device, text) as n from o),
        f as (select *, 'empty' as flag from n where text = '' union all select *, 'refusal' from n where text like 'As an AI%' union all select *, 'surface_duplicate' from n where length(text) >= 8 and n > 1
              union all select *, 'recall_zero' from n where entity_recall <= 0)
        select distinct model, device, flag, image_id, pos, part_id, text, cast(rank as int) as rank from (select *, row_number() over (partition by model, device, flag order by image_id, pos, part_id, text) as rank from f) where rank <= 5""",
    "tokens_per_second": f"select image_id, count(tps) as n, round(sum(tps), 3) as tps from (select image_id, case when gen_len > 0 and latency > 0 then round(round(gen_len / latency, 9), 3) end as tps from ({OUTPUTS})) group by 1",
    "pending_work": f"""
        select o_orderkey as image_id, task from orders, (values ('ECONOMY'), ('STANDARD'), ('PROMO'), ('LARGE')) t(task)
        where not exists (select 1 from ({OUTPUTS}) d where d.image_id = o_orderkey and d.task = t.task)""",
    "completed_images": f"select image_id from ({OUTPUTS}) where task in ('ECONOMY', 'STANDARD') group by 1 having count(distinct task) = 2",
    "ground_truth": f"""
        select o_orderkey as image_id, coalesce(string_agg(task, ',' order by task), '') as entities, coalesce(string_agg(task || ':' || n, ',' order by task), '') as counts
        from orders left join (select image_id, task, count(*) as n from ({OUTPUTS}) group by all) on image_id = o_orderkey group by 1""",
    "run_union": f"""
        select model, count(*) as n, round(avg(latency), 6) as latency, round(avg(gen_len), 6) as gen_len from (
          select model, latency, null as gen_len from ({OUTPUTS}) where device = 'F' union all select model, null, gen_len from ({OUTPUTS}) where device = 'O') group by 1""",
}
