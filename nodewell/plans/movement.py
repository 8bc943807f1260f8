"""Queries on foot traffic, the camera archive and photo labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodewell.functions import scalars, telemetry
from nodewell.operators import archive, traffic
from nodewell.plans.inputs import MINUTES, POINTS, movements, points, rounded, table
from nodewell.sources import logs
from nodewell.streaming import streams

NOON = "2024-01-20 12:00:00"


def _minutes(spark, sf):
    return traffic.minute_rollup(movements(spark, sf))


def track_sessions(spark, sf):
    return traffic.track_sessions(points(spark, sf), 400).groupBy("source", "track_id").agg(F.max("session").cast("bigint").alias("sessions"), F.count("*").alias("points"))


def track_direction(spark, sf):
    found = traffic.track_direction(points(spark, sf), threshold=50, patience=800, history=6, least=4)
    return found.select("source", "track_id", F.col("session").cast("bigint").alias("session"), "points", "x_start", "x_end", "last_frame", "dx", "direction")


def smooth_boxes(spark, sf):
    s = traffic.smooth_boxes(points(spark, sf))
    return s.select("frame_idx", "s_x1", "s_y1", "s_x2", "s_y2")


def box_centers(spark, sf):
    p = points(spark, sf)
    c = scalars.box_center(*[F.col(n) for n in ("x1", "y1", "x2", "y2")])
    b = scalars.padded_box(*[F.col(n) for n in ("x1", "y1", "x2", "y2")], 0.1, F.lit(150), F.lit(120))
    sampled = scalars.sample_every(p, 3)
    return sampled.select("frame_idx", c["cx"].alias("center_x"), c["cy"].alias("center_y"), b["x1"].alias("px1"), b["y1"].alias("py1"), b["x2"].alias("px2"), b["y2"].alias("py2"))


def running_counts(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("source"), "ts", F.when(F.col("value") > 20, "Left").when(F.col("value") > 5, "Right").alias("direction"))
    return traffic.running_counts(e, order=("ts", "event_id")).select("event_id", "left", "right", "total")


def attach_telemetry(spark, sf):
    e = table(spark, sf, "events")
    ev = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("source"), "ts")
    samples = e.where("event_type = 'view'").select(F.col("user_id").alias("source"), "ts", F.col("value").alias("CPU_usage"))
    return traffic.attach_telemetry(ev, samples, columns=("CPU_usage",)).select("event_id", "CPU_usage")


def minute_rollup(spark, sf):
    return rounded(_minutes(spark, sf), 2)


def daily_totals(spark, sf):
    return traffic.daily_totals(_minutes(spark, sf))


def traffic_dashboard(spark, sf):
    return traffic.traffic_dashboard(_minutes(spark, sf), NOON)


def period_rollup(spark, sf):
    return traffic.period_rollup(_minutes(spark, sf), metrics=("CPU_usage", "GPU_temp")).select("month", "week", "left", "right", "CPU_usage", "GPU_temp")


def change_feed(spark, sf):
    days = traffic.daily_totals(_minutes(spark, sf)).select("Date", (F.col("left") > F.col("right")).alias("more_left"))
    return traffic.change_feed(days, ("Date",), ["more_left"])


def latest_minute(spark, sf):
    return rounded(traffic.latest_minute(_minutes(spark, sf)), 2)


def merged_minutes(spark, sf):
    known = _minutes(spark, sf).select("Date", "Time", "direction_left")
    new = known.where("direction_left > 0").withColumn("direction_left", F.col("direction_left") + 100)
    return traffic.merged_minutes(known, new)


def day_rollup(spark, sf):
    """Events as the nine lines of a log, some with exceptions between, read back into blocks and days."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    side = F.when(kind == "click", "Direction: Right").when(kind == "signup", "Direction:Right").otherwise("Direction: Left")
    fields = [
        F.concat(F.lit("Date: "), F.date_format("ts", "yyyy-MM-dd")), F.concat(F.lit("Time: "), F.date_format("ts", "HH:mm:ss")), F.when(kind == "error", "Encountered exception!").otherwise(""),
        F.concat(F.lit("CPU Usage: "), "value", F.lit("%")), F.lit("Mem Usage: 12.5%,x"), F.concat(F.lit("Swp Usage: "), (F.col("user_id") % 5).cast("string"), F.lit("%")),
        F.concat(F.lit("CPU Temp: "), "value", F.lit("C")), F.lit("GPU Temp: n/aC"), F.lit("X Position: 3->9"), side,
    ]
    lines = e.select(F.col("user_id").cast("string").alias("file"), F.posexplode(F.array(*fields)).alias("i", "line"), (F.col("event_id") * 10).alias("_p")).select("file", (F.col("_p") + F.col("i")).alias("pos"), "line")
    return traffic.day_rollup(logs.legacy_blocks(lines)).withColumn("run", F.col("run").cast("bigint"))


def movement_payload(spark, sf):
    e = table(spark, sf, "events")
    payload = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), "event_type", F.lit("12"), F.lit(""), F.col("value").cast("string"), F.lit("x"), F.lit("3.5"), F.lit("9"), F.lit("40"), F.lit("41"))
    p = scalars.parse_movement_payload(payload)
    return e.select("event_id", *[p[n].alias(n) for n in ("Date", "Time", "Direction", "x_start", "x_end", "CPU_usage", "GPU_usage", "mem_usage", "CPU_temp", "GPU_temp")])


def telemetry_lines(spark, sf):
    """Telemetry in the forms of three devices, told by the event's type."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    full = F.format_string("RAM %d/2000MB CPU [%d%%@1200,%d%%@1300,off] EMC_FREQ 5%% GR3D_FREQ %d%%@[%d,300] VIN %dmW/1mW VDD_GPU_SOC 500mW/1mW tj@51.5C cpu@%d.5C", k + 1000, k, k + 10, k, k + 200, k * 100, k)
    mixed = F.format_string("GR3D_FREQ @[%d,314,%d] Vdd_Gpu  %dmW/7mW GPU@%dC", k, k + 1, k, k)
    line = F.when(F.col("event_type") == "click", full).when(F.col("event_type") == "view", mixed).when(F.col("event_type") == "error", "junk").otherwise(F.format_string("GR3D_FREQ %d%%@%d CPU [off,off]", k, k))
    t, n = telemetry.parse_telemetry(line), telemetry.parse_node_stats(line)
    return e.select("event_id", t["ram_used_mb"].alias("ram"), t["cpu_percent"].alias("cpu"), t["cpu_mhz"].alias("mhz"), t["gpu_percent"].alias("gpu"), F.round(t["gpu_mhz"], 6).alias("gpu_mhz"), t["gpu_mhz_peak"].alias("gpu_mhz_peak"), t["emc_percent"].alias("emc"), t["junction_c"].alias("tj"), F.try_element_at(t["rails"], F.lit("VIN")).alias("vin"), F.size(t["rails"]).alias("n_rails"), n["cpu_c"].alias("cpu_c"), n["gpu_c"].alias("gpu_c"))


DAY_US, BEGIN_US = 86_400_000_000, 1_704_067_200_000_000


def _frames(spark, sf, kind="click"):
    """Events (of one kind, or all) as frames of an archive, in which a path occurs once: every second day, each from midnight to noon, as a click's day counts twice and its time of day half."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - BEGIN_US
    at = F.timestamp_micros(F.floor(us / DAY_US) * 2 * DAY_US + F.floor(us % DAY_US / 2) + BEGIN_US)
    e = table(spark, sf, "events")
    e = (e if kind is None else e.where(F.col("event_type") == kind)).select(F.date_trunc("second", at).alias("at")).distinct()
    path = F.concat(F.lit("/a/"), F.date_format("at", "yyyy-MM-dd"), F.lit("/top_"), F.date_format("at", "yyyy-MM-dd_HH-mm-ss"), F.lit(".jpg"))
    return e.select(path.alias("path")).withColumns({"ts": scalars.image_timestamp(F.col("path")), "camera": scalars.camera_of(F.col("path"))})


def nearest_frame(spark, sf):
    """Purchases ask within the frames' days, sign-ups from 40 days later on."""
    e = table(spark, sf, "events").where("event_type in ('purchase', 'signup')")
    at = F.when(F.col("event_type") == "signup", F.col("ts") + F.expr("interval 40 days")).otherwise(F.col("ts"))
    return archive.nearest_frame(e.select(F.col("event_id").alias("request_id"), at.alias("at")), _frames(spark, sf)).select("request_id", "stage", "path")


def frames_in_range(spark, sf):
    return archive.frames_in_range(_frames(spark, sf, None), "2024-01-05 00:00:00", "2024-01-07 06:00:00")


def playback_sequence(spark, sf):
    f = _frames(spark, sf, None).select("path", "ts", "camera")
    for mode in ("day", "hour", "full", "none"):
        f = archive.playback_sequence(f, mode).withColumnRenamed("next_path", mode)
    return f.drop("ts", "camera")


def time_bounds(spark, sf):
    e = table(spark, sf, "events")
    own = {unit: scalars.bounds(F.col("ts"), unit) for unit in ("hour", "day", "month")}
    return e.select("event_id", *[b[side].alias(f"{unit}_{side}") for unit, b in own.items() for side in ("start", "end")])


def newest_first(spark, sf):
    return rounded(traffic.newest_first(_minutes(spark, sf)), 2)


def _photos(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.concat("source", F.lit("-"), "doc_id").alias("filename"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("datetime"), F.col("lang").alias("weather"), F.col("source").alias("people"), F.when(F.col("n_chars") > 1000, "good").alias("visibility"), (F.col("doc_id") % 24).cast("string").alias("time"))


def search_photos(spark, sf):
    return archive.search_photos(_photos(spark, sf), 500, weather="en", visibility="good").select("filename", "datetime", "time")


def top_categories(spark, sf):
    return archive.top_categories(_photos(spark, sf))


def viewer_sessions(spark, sf):
    return streams.viewer_sessions(table(spark, sf, "events").select("user_id", "ts"), idle="5 hours")


def sliding_chunks(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("audio_id"), "ts")
    return streams.sliding_chunks(e, "6 hours", "2 hours")


QUERIES = [
    track_sessions, track_direction, smooth_boxes, box_centers, running_counts, attach_telemetry, minute_rollup, daily_totals, traffic_dashboard, period_rollup, change_feed,
    latest_minute, newest_first, time_bounds, merged_minutes, day_rollup, movement_payload, telemetry_lines, nearest_frame, frames_in_range, playback_sequence, search_photos, top_categories, viewer_sessions, sliding_chunks,
]

DAYS = f"select Date, cast(sum(direction_left) as bigint) as left, cast(sum(direction_right) as bigint) as right, cast(sum(direction_left + direction_right) as bigint) as total from ({MINUTES}) group by 1"
SESSIONS = f"""
    select *, cast(sum(new) over (partition by source, track_id order by frame_idx) as bigint) as session from (
      select *, case when frame_idx - lag(frame_idx) over (partition by source, track_id order by frame_idx) - 1 > {{patience}} then 1 else 0 end as new from ({POINTS}))"""
ALL_FRAMES = f"""
    select '/a/' || strftime(ts, '%Y-%m-%d') || '/top_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.jpg' as path, ts, 'top' as camera from (
      select distinct date_trunc('second', timestamp '2024-01-01' + to_microseconds(2 * {DAY_US} * (us // {DAY_US}) + (us % {DAY_US}) // 2)) as ts from (select epoch_us(ts) - {BEGIN_US} as us from events))"""
FRAMES = ALL_FRAMES.replace("as us from events", "as us from events where event_type = 'click'")
NEAREST = f"""
    with f as (select * from ({FRAMES})), r as (select event_id as request_id, case when event_type = 'signup' then ts + interval 40 days else ts end as t0 from events where event_type in ('purchase', 'signup')),
    a as (select request_id, t0, epoch_us(t0) as s from r), g as (select ts, path, epoch_us(ts) as s, cast(ts as date) as d from f),
    near as (select request_id, path, row_number() over (partition by request_id order by abs(g.s - a.s), g.ts, path) as n from a join g on g.s between a.s - 900000000 and a.s + 1800000000),
    one as (select request_id, 1 as stage, path from near where n = 1),
    days as (select distinct d from g),
    rest as (select a.request_id, a.s, d, d - cast(t0 as date) as gap, row_number() over (partition by a.request_id order by abs(d - cast(t0 as date)), d desc) as n
             from a, days where abs(d - cast(t0 as date)) <= 30 and a.request_id not in (select request_id from one)),
    far as (select request_id, case when gap = 0 then 2 else 3 end as stage, path, row_number() over (partition by request_id order by abs(g.s - rest.s), g.ts, path) as n
            from rest join g using (d) where n = 1)
    select r.request_id, cast(stage as int) as stage, path from r left join (select * from one union all select request_id, stage, path from far where n = 1) using (request_id)"""

ORACLE = {
    "track_sessions": f"select source, track_id, max(session) as sessions, count(*) as points from ({SESSIONS.format(patience=400)}) group by all",
    "track_direction": f"""
        with s as ({SESSIONS.format(patience=800)}), l as (select *, row_number() over (partition by source, track_id, session order by frame_idx desc) as r from s),
        g as (select source, track_id, session, count(*) as points, min_by(cx, frame_idx) as x_start, max_by(cx, frame_idx) as x_end, max(frame_idx) as last_frame from l where r <= 6 group by all having count(*) >= 4)
        select g.*, x_end - x_start as dx, case when x_end - x_start > 50 then 'Right' when x_end - x_start < -50 then 'Left' end as direction
        from g join (select source, max(frame_idx) as m from s group by 1) using (source) where m - last_frame > 800""".replace("select g.*, x_end", "select g.source, track_id, session, points, x_start, x_end, last_frame, x_end"),
    "smooth_boxes": f"select frame_idx, {', '.join(f'cast(trunc(avg({c}) over w) as int) as s_{c}' for c in ('x1', 'y1', 'x2', 'y2'))} from ({POINTS}) window w as (partition by source, track_id order by frame_idx rows 4 preceding)",
    "box_centers": f"""
        select frame_idx, cast((x1 + x2) // 2 as int) as center_x, cast((y1 + y2) // 2 as int) as center_y, case when ok then px1 end as px1, case when ok then py1 end as py1, case when ok then px2 end as px2, case when ok then py2 end as py2
        from (select *, px2 > px1 and py2 > py1 as ok from (select *, cast(greatest(0, x1 - trunc((x2 - x1) * 0.1)) as int) as px1, cast(greatest(0, y1 - trunc((y2 - y1) * 0.1)) as int) as py1,
              cast(least(150, x2 + trunc((x2 - x1) * 0.1)) as int) as px2, cast(least(120, y2 + trunc((y2 - y1) * 0.1)) as int) as py2 from ({POINTS}) where frame_idx % 3 = 0))""",
    "running_counts": """
        select event_id, cast(sum(cast(value > 20 as int)) over w as bigint) as left, cast(sum(cast(value > 5 and value <= 20 as int)) over w as bigint) as right, count(*) over w as total
        from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "attach_telemetry": """
        select e.event_id, s.value as CPU_usage from (select * from events where event_type = 'purchase') e
        asof left join (select * from events where event_type = 'view') s on e.user_id = s.user_id and e.ts >= s.ts""",
    "minute_rollup": MINUTES,
    "daily_totals": DAYS,
    "traffic_dashboard": f"""
        with p as (select cast(Date as date) as d, "left" as l, "right" as r, total from ({DAYS}) where cast(Date as date) >= date '2024-01-15'), v as (select * from p where total > 0)
        select (select cast(coalesce(sum(l), 0) as bigint) from p where d = date '2024-01-20') as today_left, (select cast(coalesce(sum(r), 0) as bigint) from p where d = date '2024-01-20') as today_right,
               (select cast(floor(avg(l) filter (where l > 0) + 0.5) as bigint) from v) as avg_left, (select cast(floor(avg(r) filter (where r > 0) + 0.5) as bigint) from v) as avg_right,
               (select cast(floor(avg(total) + 0.5) as bigint) from v) as avg_daily_total,
               (select strftime(d, '%Y-%m-%d') from v order by total desc, d limit 1) as peak_day, (select max(total) from v) as peak_total""",
    "period_rollup": f"""
        select cast(date_trunc('month', cast(Date as date)) as date) as month, cast(date_trunc('week', cast(Date as date)) as date) as week, cast(sum(direction_left) as bigint) as left, cast(sum(direction_right) as bigint) as right,
               cast(round(cast(avg(CPU_usage) filter (where CPU_usage <> -1) as decimal(18, 9)), 2) as double) as CPU_usage, avg(GPU_temp) filter (where GPU_temp <> -1) as GPU_temp
        from ({MINUTES}) group by rollup(1, 2)""",
    "change_feed": f"""
        select Date, more_left from (select Date, "left" > "right" as more_left, lag("left" > "right") over (order by Date) as b from ({DAYS})) where more_left is distinct from b""",
    "latest_minute": f"select * from ({MINUTES}) order by Date desc, Time desc limit 1",
    "merged_minutes": f"select Date, Time, case when direction_left > 0 then direction_left + 100 else direction_left end as direction_left from ({MINUTES})",
    "day_rollup": """
        select file, run, date, cast(round(cast(avg(value) as decimal(18, 9)), 2) as double) as cpu, 12.5::double as mem, cast(user_id % 5 as double) as swap, cast(round(cast(avg(value) as decimal(18, 9)), 2) as double) as cpu_temp,
               cast(null as double) as gpu_temp, count(*) filter (where event_type <> 'click') as left, count(*) filter (where event_type = 'click') as right from (
          select *, cast(sum(new) over (partition by file order by event_id) as bigint) as run from (
            select cast(user_id as varchar) as file, user_id, event_id, event_type, value, strftime(ts, '%Y-%m-%d') as date,
                   case when strftime(ts, '%Y-%m-%d') = lag(strftime(ts, '%Y-%m-%d')) over (partition by user_id order by event_id) then 0 else 1 end as new from events)) group by all""".replace("group by all", "group by file, user_id, run, date"),
    "movement_payload": """
        select event_id, strftime(ts, '%Y-%m-%d') as Date, strftime(ts, '%H:%M:%S') as Time, event_type as Direction, 12.0::double as x_start, 0.0::double as x_end, value as CPU_usage, 0.0::double as GPU_usage,
               3.5::double as mem_usage, 40.0::double as CPU_temp, 41.0::double as GPU_temp from events""",
    "telemetry_lines": """
        select event_id, case when f then k + 1000.0 end::double as ram, case when f then k + 5.0 end::double as cpu, case when f then 1250.0 end::double as mhz, case when f or o then k end::double as gpu,
               round(case when f then (k + 500) / 2 when v then (2 * k + 315) / 3 when o then k end::double, 6) as gpu_mhz, case when f then greatest(k + 200, 300) when v then greatest(k + 1, 314) when o then k end::double as gpu_mhz_peak,
               case when f then 5.0 end::double as emc, case when f then 51.5 end::double as tj, case when f then k * 100 / 1000 end as vin, cast(case when f then 2 when v then 1 else 0 end as int) as n_rails,
               case when f then k + 0.5 end::double as cpu_c, case when v then k end::double as gpu_c
        from (select event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type = 'click' as f, event_type = 'view' as v, event_type not in ('click', 'view', 'error') as o from events)""",
    "nearest_frame": NEAREST,
    "frames_in_range": f"select * from ({ALL_FRAMES}) where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-07 06:00:00'",
    "playback_sequence": f"""
        select path, coalesce(lead(path) over d, first_value(path) over d) as day, coalesce(lead(path) over h, first_value(path) over h) as hour, coalesce(lead(path) over w, first_value(path) over w) as "full", lead(path) over w as none
        from ({ALL_FRAMES}) window d as (partition by cast(ts as date) order by path), h as (partition by date_trunc('hour', ts) order by path), w as (order by path)""",
    "time_bounds": "select event_id, " + ", ".join(f"cast(date_trunc('{u}', ts) as timestamp) as {u}_start, cast(date_trunc('{u}', ts) as timestamp) + interval 1 {u} as {u}_end" for u in ("hour", "day", "month")) + " from events",
    "newest_first": f"select * from ({MINUTES})",
    "search_photos": """
        select source || '-' || doc_id as filename, lpad(cast(n_chars as varchar), 9, '0') as datetime, cast(doc_id % 24 as varchar) as time from documents where lang = 'en' and n_chars > 1000 order by datetime, filename limit 200""",
    "top_categories": """
        select label, value, n, cast(rank as int) as rank, total from (select *, row_number() over (partition by label order by n desc, value) as rank, cast(sum(n) over (partition by label) as bigint) as total from (
          select label, value, count(*) as n from (select unnest(['weather', 'people', 'time']) as label, unnest([lang, source, cast(doc_id % 24 as varchar)]) as value from documents) where value is not null group by all)) where rank <= 5""",
    "viewer_sessions": """
        select user_id, min(ts) as start, max(ts) + interval 5 hours as end, count(*) as events from (select *, sum(new) over (partition by user_id order by ts) as s from (
          select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 hours then 0 else 1 end as new from events)) group by user_id, s""",
    "sliding_chunks": """
        select event_type as audio_id, start, start + interval 6 hours as end, count(*) as n from (select event_type, unnest([time_bucket(interval 2 hours, ts), time_bucket(interval 2 hours, ts) - interval 2 hours, time_bucket(interval 2 hours, ts) - interval 4 hours]) as start from events) group by all""",
}
