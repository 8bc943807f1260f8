"""Group statistics of run outputs: summaries, tails, deployments, power, trade-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nodewell.functions.scalars import falsy_or


def percentile(c: Column, p: float, approx: bool = False) -> Column:
    """Linear interpolation between ranks, exact unless approx. The exact form keeps a map of values and counts per group."""
    return F.percentile_approx(c, p, 10_000) if approx else F.percentile(c, p)


def _matched(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b by keys, nulls being keys like others."""
    named = b.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    same = [a[k].eqNullSafe(named[f"_k{n}"]) for n, k in enumerate(keys)]
    return a.join(named, same, how).drop(*[f"_k{n}" for n in range(len(keys))])


def with_percentiles(groups: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], approx: bool = False, map_rows: int = 1_000_000) -> DataFrame:
    """groups, which has a row per keys, with the percentiles of df by name: (column of df, 0 to 100); exact unless approx.

    Counts the rows of the largest group, which is a job. Up to map_rows of them a group's values and counts are held as a map;
    beyond, ranked_percentiles is used, which holds no group. Both interpolate between the same two values."""
    columns = dict.fromkeys(c for c, _ in wanted.values())
    if not approx and (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > map_rows:
        for c in columns:
            groups = _matched(groups, ranked_percentiles(df, keys, c, {n: p for n, (own, p) in wanted.items() if own == c}), keys, "left")
        return groups
    each = [percentile(F.col(c), p / 100, approx).alias(n) for n, (c, p) in wanted.items()]
    return _matched(groups, df.groupBy(*keys).agg(*each), keys, "left")


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float], nearest: bool = False, bins: int = 100) -> DataFrame:
    """(keys, one column per name of percents, from 0 to 100) by exact ranks, interpolated, or of the nearest rank, halves to even.

    For groups of any size: equal values are counted first, approximate quantiles part a group into bins, counts tell which bins
    hold the wanted ranks, and only the values in these are put in order, a hundredth of a group at a time. Nulls don't count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    values = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_v", [(b + 1) / bins for b in range(bins - 1)], 10 * bins).alias("_cuts"), F.sum("_c").alias("_all"))
    placed = _matched(values, cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    running = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b"))
    counts = placed.groupBy(*keys, "_b", "_all").agg(F.sum("_c").alias("_n")).withColumn("_from", running - F.col("_n"))

    def ranks(percent: float) -> tuple[Column, Column, Column]:
        at = F.lit(percent / 100.0) * (F.col("_all") - 1)
        return (F.rint(at), F.rint(at), at) if nearest else (F.floor(at), F.ceil(at), at)

    wanted = [r for p in percents.values() for r in ranks(p)[:2]]
    holds = F.exists(F.array(*[w.cast("bigint") for w in wanted]), lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    some = _matched(placed, counts.where(holds).select(*keys, "_b", "_from"), [*keys, "_b"])
    upto = F.col("_from") + F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    some = some.withColumn("_to", upto)

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col("_v")))

    found = some.groupBy(*keys, "_all").agg(*[at_rank(r).alias(f"_{side}_{n}") for n, p in percents.items() for side, r in zip(("low", "high"), ranks(p), strict=False)])
    out = []
    for n, p in percents.items():
        low, high, at = F.col(f"_low_{n}"), F.col(f"_high_{n}"), ranks(p)[2]
        out.append((low if nearest else low + (high - low) * (at - F.floor(at))).alias(n))
    return found.select(*keys, *out)


def model_device_summary(runs: DataFrame, approx: bool = False, map_rows: int = 1_000_000) -> DataFrame:
    """One row per (model, device) of nested run records, at two grains: hardware values count once per record with an
    output, quality and latency once per output without error; n_records and n_outputs count all. Count metrics are of the task
    objects_and_counts alone; hw_source is the least of a group's, for want of an order."""
    has = F.coalesce(F.size("outputs"), F.lit(0)) > 0

    def hw(field: str):
        return F.when(has, F.col(f"hw_stats.{field}"))

    records = runs.groupBy("model", "device").agg(
        F.count("*").alias("n_records"),
        F.sum(F.when(has, F.size("outputs")).otherwise(0)).alias("n_outputs"),
        F.avg(hw("power_watts_avg")).alias("power_watts_avg_mean"),
        F.avg(hw("power_watts_peak")).alias("power_watts_peak_mean"),
        F.avg(hw("energy_joules_est")).alias("energy_joules_mean"),
        F.avg(hw("gpu_mem_alloc_gb_peak")).alias("gpu_mem_gb_peak_mean"),
        F.avg(hw("duration_seconds")).alias("duration_seconds_mean"),
        F.avg(hw("cpu_percent_avg")).alias("cpu_percent_avg_mean"),
        F.min(F.nullif(hw("source"), F.lit(""))).alias("hw_source"),
    )
    each = runs.where(has).select("model", "device", "task", F.explode("outputs").alias("o")).where("coalesce(o.error, '') = ''")
    latency = F.col("o.gen_latency_s") * 1000
    counted = F.col("task") == "objects_and_counts"
    outputs = each.groupBy("model", "device").agg(
        F.count("o.entity_recall").alias("n_recall_valid"),
        F.avg("o.entity_recall").alias("entity_recall_mean"),
        F.avg(F.when(counted, F.col("o.count_accuracy.count_exact_accuracy"))).alias("count_exact_mean"),
        F.avg(F.when(counted, F.col("o.count_accuracy.count_mae"))).alias("count_mae_mean"),
        F.avg("o.caption_similarity_max").alias("caption_sim_max_mean"),
        F.avg("o.caption_similarity_mean").alias("caption_sim_mean_mean"),
        F.avg("o.clipscore_cos").alias("clipscore_cos_mean"),
        F.avg(latency).alias("latency_ms_mean"),
        F.avg("o.gen_len").alias("gen_len_mean"),
        F.avg(falsy_or(F.col("o.tokens_per_sec"), F.col("o.tokens_per_second"))).alias("tokens_per_sec_mean"),
    )
    values = each.select("model", "device", F.col("o.caption_similarity_max").alias("_similarity"), latency.alias("_latency"))
    wanted = {"caption_sim_max_median": ("_similarity", 50.0), **{f"latency_ms_p{p}": ("_latency", float(p)) for p in (50, 90, 99)}}
    outputs = with_percentiles(outputs, values, ["model", "device"], wanted, approx, map_rows)
    joined = _matched(records, outputs, ["model", "device"], "left").withColumn("n_recall_valid", F.coalesce("n_recall_valid", F.lit(0)))
    return joined.withColumn("energy_per_token_mj_mean", F.try_divide(1000 * F.col("energy_joules_mean"), F.col("gen_len_mean")))


def task_breakdown(outputs: DataFrame) -> DataFrame:
    """Per (model, device, task); count metrics for the task objects_and_counts alone. n counts the outputs with a recall."""
    counted = F.col("task") == "objects_and_counts"
    return outputs.groupBy("model", "device", "task").agg(
        F.count("entity_recall").alias("n"),
        F.avg("entity_recall").alias("entity_recall_mean"),
        F.avg(F.when(counted, F.col("count_exact_accuracy"))).alias("count_exact_mean"),
        F.avg(F.when(counted, F.col("count_mae"))).alias("count_mae_mean"),
    )


def latency_tail(outputs: DataFrame, keys: list[str], latency: str = "latency", variant: str = "rounded", approx: bool = False, map_rows: int = 1_000_000) -> DataFrame:
    """n, p50, p95, p99, max, mean, population std and tail ratio p99 / p50 of the unrounded values. rounded: 4 and 3
    places; plain: unrounded, with counts above 5, 6 and 7 seconds; the ratio is null where p50 is 0. Percentiles: see with_percentiles."""
    c = F.col(latency)
    g = outputs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), *[F.count_if(c > s).alias(f"over_{s}s") for s in (5, 6, 7)],
    )
    g = with_percentiles(g, outputs.select(*keys, latency), keys, {f"p{p}": (latency, float(p)) for p in (50, 95, 99)}, approx, map_rows)
    g = g.withColumn("tail_ratio", F.try_divide("p99", "p50"))
    if variant == "rounded":
        four = {n: F.round(F.round(n, 9), 4) for n in ("p50", "p95", "p99", "max", "mean", "std")}
        return g.withColumns(four | {"tail_ratio": F.round(F.round("tail_ratio", 9), 3)}).select(*keys, "n", *four, "tail_ratio")
    return g.select(*keys, "n", "p50", "p95", "p99", "max", "mean", "std", "tail_ratio", "over_5s", "over_6s", "over_7s")


def tail_by_model(tails: DataFrame) -> DataFrame:
    out = tails.groupBy("model").agg(F.avg("tail_ratio").alias("mean_tail_ratio"), F.max("tail_ratio").alias("max_tail_ratio"), F.count("*").alias("groups"))
    return out.orderBy(F.desc("mean_tail_ratio"), "model")


def headline_tails(tails: DataFrame, limit: float = 2.0) -> DataFrame:
    """Groups by falling tail ratio, flagged above the limit."""
    return tails.withColumn("flag", F.col("tail_ratio") > limit).orderBy(F.desc_nulls_last("tail_ratio"), "model", "device")


def load_audit(outputs: DataFrame) -> DataFrame:
    """One row: outputs, those excluded as empty or without latency, those kept and their groups."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    slow = ~empty & ~F.coalesce(F.col("latency") > 0, F.lit(False))
    per = outputs.groupBy("model", "device", "task").agg(F.count("*").alias("t"), F.count_if(empty).alias("e"), F.count_if(slow).alias("s"))
    return per.agg(
        F.sum("t").alias("total"), F.sum("e").alias("excluded_empty"), F.sum("s").alias("excluded_no_latency"),
        F.sum(F.expr("t - e - s")).alias("kept"), F.count_if(F.expr("t > e + s")).alias("groups"),
    )


def deployment_summary(runs: DataFrame, key: str = "run_group") -> DataFrame:
    """Per run group: records, errors, and of the others latency and throughput (mean, min, max and nearest-rank p50, p90,
    p99), rounded to 3 places."""
    ok = F.coalesce("error", F.lit("")) == ""
    named = {"latency": "latency_ms", "throughput": "images_per_second"}
    both = F.array(*[F.struct(F.lit(n).alias("m"), F.when(ok, F.col(c).cast("double")).alias("v")) for n, c in named.items()])
    long = runs.select(key, F.inline(both)).where("v is not null")
    marks = ranked_percentiles(long, [key, "m"], "v", {"p50": 50.0, "p90": 90.0, "p99": 99.0}, nearest=True)
    stats = long.groupBy(key, "m").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).join(marks, [key, "m"])
    near = lambda m, c: F.round(F.round(F.max(F.when(F.col("m") == m, F.col(c))), 9), 3).alias(f"{m}_{c}")
    wide = stats.groupBy(key).agg(*[near(m, c) for m in named for c in ("mean", "min", "max", "p50", "p90", "p99")])
    return runs.groupBy(key).agg(F.count("*").alias("records"), F.count_if(~ok).alias("errors")).join(wide, key, "left")


def headline_watts(rails: str, edition: str = "board") -> tuple[Column, Column]:
    """(mean, peak) of a run's headline power, as aggregates over its samples' maps of rails. board: the mean of VIN, else
    those of GPU and CPU with the system's if it is there, else the system's alone; the peak is VIN's. gpu: the mean of the
    GPU's rail under its newer or older name, rounded to 2, and no peak."""

    def mean(rail: str) -> Column:
        return F.avg(F.try_element_at(rails, F.lit(rail)))

    if edition == "gpu":
        return F.round(F.round(F.coalesce(mean("VDD_GPU_SOC"), mean("VDD_GPU")), 9), 2), F.lit(None).cast("double")
    system = mean("VIN_SYS_5V0")
    watts = F.coalesce(mean("VIN"), mean("VDD_GPU_SOC") + mean("VDD_CPU_CV") + F.coalesce(system, F.lit(0.0)), system)
    return watts, F.max(F.try_element_at(rails, F.lit("VIN")))


def _duration(ts: str) -> Column:
    return (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6


def power_summary(samples: DataFrame, run: str = "run", rails: str = "rails", ts: str = "ts", edition: str = "board") -> DataFrame:
    """Per run: headline watts (see headline_watts) and their peak, rounded to 3 (edition gpu: 2), energy = watts times
    duration, rounded to 2, null where either is zero, duration in seconds, rounded to 3, and the number of samples."""
    watts, peak = headline_watts(rails, edition)
    g = samples.groupBy(run).agg(watts.alias("_w"), peak.alias("_p"), F.count("*").alias("sample_count"), _duration(ts).alias("_s"))
    energy = F.when((F.col("_w") != 0) & (F.col("_s") != 0), F.col("_w") * F.col("_s"))
    near = lambda c, n: F.round(F.round(c, 9), n)
    return g.select(run, near("_w", 3).alias("power_watts_avg"), near("_p", 3).alias("power_watts_peak"), "sample_count", near("_s", 3).alias("duration_seconds"), near(energy, 2).alias("energy_joules_est"))


def meter_summary(samples: DataFrame, run: str = "run", watts: str = "watts", ts: str = "ts") -> DataFrame:
    """Per run of a meter with one reading a sample: mean, peak and least watts and energy, rounded to 2, duration, samples."""
    g = samples.groupBy(run).agg(F.avg(watts).alias("_w"), F.max(watts).alias("_p"), F.min(watts).alias("_l"), F.count(watts).alias("sample_count"), _duration(ts).alias("_s"))
    near = lambda c, n: F.round(F.round(c, 9), n)
    return g.select(
        run, near("_w", 2).alias("power_watts_avg"), near("_p", 2).alias("power_watts_peak"), near("_l", 2).alias("power_watts_min"), near(F.col("_w") * F.col("_s"), 2).alias("energy_joules_est"),
        "sample_count", near("_s", 3).alias("duration_seconds"),
    )


def rail_summary(samples: DataFrame, run: str = "run", rails: str = "rails") -> DataFrame:
    each = samples.select(run, F.explode(rails).alias("rail", "watts"))
    return each.groupBy(run, "rail").agg(F.avg("watts").alias("avg"), F.max("watts").alias("peak"), F.min("watts").alias("min"))


def filter_describe(metrics: DataFrame, key: str = "filter", value: str = "fps", map_rows: int = 1_000_000) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per filter, the largest mean first."""
    v = F.col(value)
    known = metrics.where(v.isNotNull()).select(key, value)
    g = known.groupBy(key).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    g = with_percentiles(g, known, [key], {f"p{p}": (value, float(p)) for p in (25, 50, 75)}, map_rows=map_rows)
    return g.select(key, "count", "mean", "std", "min", "p25", "p50", "p75", "max").orderBy(F.desc("mean"), key)


def resource_curve(metrics: DataFrame, columns: list[str], keys: tuple[str, ...] = ("filter", "frame_index")) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def frame_rate(frames: DataFrame, key: str, ts_seconds: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """frames with fps = 1 / seconds since the one before, rounded to 2; 0 where no time has passed, null for the first.
    ties: columns that order frames of one time."""
    gap = F.col(ts_seconds) - F.lag(ts_seconds).over(W.partitionBy(key).orderBy(ts_seconds, *ties))
    return frames.withColumn("fps", F.when(gap <= 0, F.lit(0.0)).when(gap > 0, F.round(1 / gap, 2)))


def tradeoff_table(outputs: DataFrame, agreement: DataFrame, drift_below: float = 0.98) -> DataFrame:
    """Per model|device: images, recall, tokens per second, latency, power; drift where the model's least cross-device
    agreement is below the limit. agreement: (model, min_agreement)."""
    g = outputs.groupBy("model", "device").agg(
        F.count_distinct("image_id").alias("images"), F.avg("entity_recall").alias("recall"), F.avg("tokens_per_sec").alias("tokens_per_sec"),
        F.avg("latency").alias("latency"), F.avg("power_watts").alias("power_watts"),
    )
    joined = g.join(agreement, "model", "left")
    return joined.select(F.concat_ws("|", "model", "device").alias("name"), *[c for c in g.columns], (F.col("min_agreement") < drift_below).alias("drift"))


def spreads(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the largest value over the smallest above zero of each column."""
    return table.agg(*[F.try_divide(F.max(c), F.min(F.when(F.col(c) > 0, F.col(c)))).alias(f"{c}_spread") for c in columns])


REFUSAL = r"(?i)\b(i cannot|i can't|i am unable|i'm unable|as an ai|i am sorry|i'm sorry|cannot assist)\b"


def hallucination_report(outputs: DataFrame, keys: tuple[str, ...] = ("model", "device"), min_chars: int = 20, recall_zero: float = 0.0) -> DataFrame:
    """Per group: outputs, empty texts, refusals, surface duplicates (texts of min_chars or more that occur again), mean
    recall, share of zero recall, and severity: high if empty, refused and zero recall together pass a tenth of the
    outputs, medium above a fiftieth, else low (an own definition; see the README)."""
    text = F.trim(F.coalesce("text", F.lit("")))
    counted = outputs.select(*keys, text.alias("_t"), "entity_recall").groupBy(*keys, "_t").agg(F.count("*").alias("n"), F.sum("entity_recall").alias("r"), F.count("entity_recall").alias("rn"), F.count_if(F.col("entity_recall") <= recall_zero).alias("z"))
    g = counted.groupBy(*keys).agg(
        F.sum("n").alias("outputs"),
        F.coalesce(F.sum(F.when(F.col("_t") == "", F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(F.col("_t").rlike(REFUSAL), F.col("n"))), F.lit(0)).alias("refusals"),
        F.coalesce(F.sum(F.when((F.length("_t") >= min_chars) & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("surface_duplicates"),
        F.try_divide(F.sum("r"), F.sum("rn")).alias("recall_mean"),
        F.try_divide(F.sum("z"), F.sum("rn")).alias("recall_zero_rate"),
        F.sum("z").alias("_z"),
    )
    share = (F.col("empty") + F.col("refusals") + F.col("_z")) / F.col("outputs")
    return g.withColumn("severity", F.when(share > 0.1, "high").when(share > 0.02, "medium").otherwise("low")).drop("_z")


def flagged_outputs(outputs: DataFrame, order: list[str], keys: tuple[str, ...] = ("model", "device"), min_chars: int = 20, recall_zero: float = 0.0, per_flag: int = 5) -> DataFrame:
    """(keys, flag, rank, order, text): examples of what hallucination_report counts, per_flag of each flag and group, the first by
    the columns of order. Flags: empty, refusal, surface_duplicate, recall_zero; an output may have several."""
    text = F.trim(F.coalesce("text", F.lit("")))
    again = outputs.groupBy(*keys, text.alias("_t")).agg(F.count("*").alias("_n")).where((F.length("_t") >= min_chars) & (F.col("_n") > 1))
    marked = outputs.withColumn("_t", text).join(again, [*keys, "_t"], "left")
    tests = {"empty": F.col("_t") == "", "refusal": F.col("_t").rlike(REFUSAL), "surface_duplicate": F.col("_n").isNotNull(), "recall_zero": F.col("entity_recall") <= recall_zero}
    flags = F.array_compact(F.array(*[F.when(test, flag) for flag, test in tests.items()]))
    each = marked.select(*keys, F.explode(flags).alias("flag"), *order, F.col("_t").alias("text"))
    rank = F.row_number().over(W.partitionBy(*keys, "flag").orderBy(*order, "text"))
    return each.withColumn("rank", rank).where(F.col("rank") <= per_flag)
