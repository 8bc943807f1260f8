"""Queries that write a given table in an input's format into the shared folder, and read it by the library's reader or as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nodewell.functions import scalars
from nodewell.operators import traffic
from nodewell.plans.inputs import MINUTES, POINTS, movements, points, rounded, table
from nodewell.sources import logs, runs, sqlite
from nodewell.sources.shared import shared_dir
from nodewell.sources.snapshots import Snapshots
from nodewell.streaming import streams


def _folder(spark, name):
    """A new folder below the shared one, whose owner clears it."""
    return f"{shared_dir(spark)}/nodewell/{name}-{uuid.uuid4().hex}"


def _records(spark, sf):
    """Orders as run records, some under alias names, in JSON lines; every hundredth line is cut off, and one more is blank."""
    o = table(spark, sf, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("image_id"), F.when(odd, F.col("o_orderpriority")).alias("model"), F.when(~odd, F.col("o_orderpriority")).alias("model_name"),
        F.when(odd, F.col("o_orderstatus")).alias("device"), F.when(~odd, F.col("o_orderstatus")).alias("device_name"), F.array(F.struct((F.col("o_totalprice") / 1000).alias("latency_s"))).alias("outputs"),
    )
    line = F.to_json(record)
    cut = F.when(F.col("o_orderkey") % 100 == 0, F.substring(line, 1, 20)).otherwise(line)
    return o.select(F.explode(F.array(cut, F.when(F.col("o_orderkey") % 100 == 1, F.lit(" ")))).alias("value"), F.col("o_orderstatus").alias("status")).where("value is not null")


def read_runs(spark, sf):
    path = _folder(spark, "runs")
    _records(spark, sf).select("value").write.text(path)
    out = runs.identified(runs.read_runs(spark, path)).where("image_id is not null")
    return out.select("image_id", "model", "device", F.round(F.col("outputs")[0]["latency_s"], 6).alias("latency"), F.col("file").contains("/runs-").alias("has_file"))


def tag_runs(spark, sf):
    """The records in folders by status, each told its model and device by a spec."""
    path = _folder(spark, "tagged")
    _records(spark, sf).write.partitionBy("status").text(path)
    out = runs.tag_runs(spark, [f"m{s}:d{s}:{path}/status={s}" for s in ("F", "O", "P")])
    return out.where("image_id is not null").select(F.col("image_id").cast("bigint").alias("image_id"), "model", "device")


def input_files(spark, sf):
    """Folders by status met by two patterns that overlap: each file once, in the order of the patterns."""
    path = _folder(spark, "inputs")
    _records(spark, sf).write.partitionBy("status").text(path)
    files = runs.input_files(spark, [f"{path}/status=[OP]/part-*", f"{path}/*/part-*"])
    return runs.read_runs(spark, files).where("image_id is not null").select(F.col("image_id").cast("bigint").alias("image_id"))


def _documents_of(df, path, key, content):
    """Whole JSON documents, one a file, of the rows of 20,000 keys at most."""
    df.groupBy(F.expr(f"{key} div 20000").alias("part")).agg(F.to_json(content).alias("value")).write.partitionBy("part").text(path)
    return f"{path}/part=*"


def read_annotations(spark, sf):
    path = _folder(spark, "annotations")
    each = F.struct(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("category_id"))
    names = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(("dog", "cat", "bird"))])
    content = F.struct(F.first(names).alias("categories"), F.collect_list(each).alias("annotations"))
    return runs.read_annotations(spark, _documents_of(table(spark, sf, "lineitem"), path, "l_orderkey", content))


def read_captions(spark, sf):
    path = _folder(spark, "captions")
    each = F.struct(F.col("c_custkey").alias("image_id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("caption"))
    content = F.struct(F.array_sort(F.collect_list(each), lambda a, b: F.when(a["image_id"] < b["image_id"], -1).otherwise(1)).alias("annotations"))
    return runs.read_captions(spark, _documents_of(table(spark, sf, "customer"), path, "c_custkey", content))


def read_testset(spark, sf):
    path = _folder(spark, "testset")
    each = F.struct(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("file_name"), F.split("p_name", " ").alias("expected_entities"))
    found = runs.read_testset(spark, _documents_of(table(spark, sf, "part"), path, "p_partkey", F.collect_list(each)))
    return found.select("image_id", "file_name", F.size("expected_entities").alias("entities"))


def read_manifest(spark, sf):
    """Parts as image paths, some indented or empty, some whose names are no numbers."""
    path = _folder(spark, "manifest")
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("/a/x"), k, F.lit(".jpg"))).when(k % 5 == 1, F.lit(" ")).otherwise(F.concat(F.lit("  /a.b/"), F.lpad(k.cast("string"), 12, "0"), F.when(k % 2 == 0, ".jpg").otherwise("")))
    table(spark, sf, "part").select(name.alias("value")).write.text(path)
    return runs.read_manifest(spark, path)


def read_movement(spark, sf):
    """Events as movement logs of two kinds of headers, some values missing or no numbers."""
    path = _folder(spark, "movement")
    e = table(spark, sf, "events")
    own = [F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"), F.col("event_type").alias("Direction"), F.col("event_id").alias("X_start"), F.when(F.col("value") > 5, F.col("value")).alias("X_end"), F.when(F.col("user_id") % 2 == 0, "n/a").otherwise("7.5").alias("CPU%")]
    for kind, columns in ((0, own), (1, [*reversed(own[1:]), own[0]])):
        e.where(F.col("event_id") % 2 == kind).select(*columns).write.mode("append").option("header", True).csv(path)
    return logs.read_movement(spark, path).select("Date", "Time", "Direction", "X_start", "X_end", "CPU%", "GPU%")


def read_filter_metrics(spark, sf):
    path = _folder(spark, "metrics")
    e = table(spark, sf, "events")
    own = e.select(F.col("event_id").alias("frame_index"), F.col("event_type").alias("filter"), F.when(F.col("value") > 2, F.col("value").cast("string")).otherwise("-").alias("fps"), F.date_format("ts", "HH:mm:ss").alias("timestamp"))
    own.write.option("header", True).csv(path)
    return logs.read_filter_metrics(spark, path).select("timestamp", "filter", "frame_index", "fps", "gpu_percent")


def read_telemetry_text(spark, sf):
    path = _folder(spark, "telemetry")
    table(spark, sf, "events").select(F.concat(F.lit("VIN "), "event_id", F.lit("mW")).alias("value")).write.text(path)
    return logs.read_telemetry_text(spark, path)


def read_reference_lines(spark, sf):
    path = _folder(spark, "references")
    table(spark, sf, "part").select(F.concat(F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(""), "p_partkey", F.lit("   "), "p_name").alias("value")).write.text(path)
    return logs.read_reference_lines(spark, path)


def read_sqlite(spark, sf):
    """Minutes in SQLite files of several devices, of which those of two days with events to the left are asked for."""
    path = _folder(spark, "directional")
    minutes = traffic.minute_rollup(movements(spark, sf)).select("Date", "Time", "direction_left", "direction_right")
    sqlite.write_sqlite(minutes, path, "directional_data")
    return sqlite.read_sqlite(spark, path, "directional_data").where("Date in ('2024-01-03', '2024-01-04') and direction_left > 0")


def write_enriched(spark, sf):
    """Orders written by model and device; a second write that may not overwrite changes nothing."""
    path = runs.enriched_path(_folder(spark, "orders") + "_enriched.json", "rescored")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.translate("o_orderpriority", " -", "__").alias("model"), F.col("o_orderstatus").alias("device"))
    runs.write_enriched(o, path)
    runs.write_enriched(o.where("image_id < 10"), path)
    return spark.read.json(path).select("image_id", "model", "device", F.lit(path.endswith("_rescored.json")).alias("named"))


def write_reports(spark, sf):
    """Totals a brand as CSV and as JSON, read back and joined."""
    totals = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
    path = _folder(spark, "reports")
    runs.write_report_csv(totals, f"{path}/csv")
    runs.write_report_json(totals, f"{path}/json")
    csv = spark.read.option("header", True).schema("p_brand string, n bigint, total double").csv(f"{path}/csv")
    return csv.join(spark.read.schema("p_brand string, n bigint").json(f"{path}/json").withColumnRenamed("n", "n_json"), "p_brand")


def upserted_minutes(spark, sf):
    """Three batches of minutes, one of them twice, merged into snapshots: all, those with events to the left, and new days."""
    path = _folder(spark, "minutes")
    known = traffic.minute_rollup(movements(spark, sf)).select("Date", "Time", "direction_left")
    changed = known.where("direction_left > 0").withColumn("direction_left", F.col("direction_left") + 100)
    later = known.where("direction_left > 1").withColumn("Date", F.concat(F.lit("x"), "Date"))
    for n, batch in ((0, known), (1, changed), (1, known), (2, later)):
        traffic.upsert_minutes(spark, batch, path, ("query", n))
    return traffic.read_minutes(spark, path)


def _ended(query):
    query.trigger(availableNow=True).start().awaitTermination()


def _source(spark, df, path):
    """df as files, and a stream of them."""
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in")


def _sent(spark, stream, path):
    """What a stream appends, as a table."""
    _ended(stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out"))
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def streamed_minutes(spark, sf):
    path = _folder(spark, "streamed-minutes")
    own = movements(spark, sf).withColumn("ts", F.to_timestamp(F.concat("Date", F.lit(" "), "Time")))
    rollup = streams.stream_minute_rollup(_source(spark, own, path))
    _ended(streams.start_minute_upsert(rollup, f"{path}/minutes", f"{path}/checkpoint"))
    return rounded(traffic.read_minutes(spark, f"{path}/minutes"), 2)


def streamed_history(spark, sf):
    """Minutes merged as a stream; the report of the last ten days."""
    path = _folder(spark, "streamed-history")
    minutes = traffic.minute_rollup(movements(spark, sf)).select("Date", "Time", "direction_left")
    _ended(streams.start_history_merge(_source(spark, minutes, path), f"{path}/minutes", f"{path}/checkpoint", days=10))
    return Snapshots(spark, f"{path}/minutes-recent").read()


def streamed_directions(spark, sf):
    path = _folder(spark, "streamed-directions")
    own = points(spark, sf).select("source", "track_id", "frame_idx", F.timestamp_millis(F.col("frame_idx") * 33).alias("ts"), "cx")
    found = streams.stream_track_direction(_source(spark, own, path), threshold=50, patience=800, history=6, least=4, late="0 seconds")
    return _sent(spark, found, path)


def streamed_changes(spark, sf):
    path = _folder(spark, "streamed-changes")
    own = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _sent(spark, streams.stream_change_feed(_source(spark, own, path), "user_id", ["event_type", "value"], ["event_id"], "ts"), path)


def streamed_power(spark, sf):
    """Telemetry lines of a run each event type; the windows that the watermark has passed."""
    path = _folder(spark, "streamed-power")
    e = table(spark, sf, "events")
    own = e.select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("VIN "), F.col("user_id") * 8, F.lit("mW/1mW")).alias("value"))
    sent = _sent(spark, streams.stream_power(_source(spark, own, path), width="1 hour", late="0 seconds"), path)
    return rounded(sent.withColumn("start", F.col("start").cast("timestamp_ntz")))


def image_times(spark, sf):
    """Frames of an archive by their names alone, listed by day."""
    e = table(spark, sf, "events")
    name = F.concat(F.lit("/a/top_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(".jpg"))
    return e.select("event_id", scalars.image_timestamp(name).alias("at"), scalars.camera_of(name).alias("camera"))


QUERIES = [
    read_runs, tag_runs, input_files, read_annotations, read_captions, read_testset, read_manifest, read_movement, read_filter_metrics, read_telemetry_text, read_reference_lines, read_sqlite,
    write_enriched, write_reports, upserted_minutes, streamed_minutes, streamed_history, streamed_directions, streamed_changes, streamed_power, image_times,
]

ORACLE = {
    "read_runs": "select o_orderkey as image_id, o_orderpriority as model, o_orderstatus as device, round(o_totalprice / 1000, 6) as latency, true as has_file from orders where o_orderkey % 100 > 0",
    "tag_runs": "select o_orderkey as image_id, 'm' || o_orderstatus as model, 'd' || o_orderstatus as device from orders where o_orderkey % 100 > 0",
    "input_files": "select o_orderkey as image_id from orders where o_orderkey % 100 > 0",
    "read_annotations": "select l_orderkey as image_id, ['dog', 'cat', 'bird'][l_linenumber % 3 + 1] as category, count(*) as n from lineitem group by all",
    "read_captions": "select image_id, caption_no, caption from (select c_custkey as image_id, cast(row_number() over (partition by c_custkey // 20000 order by c_custkey) - 1 as int) as caption_no, c_name as caption from customer) where image_id % 7 <> 0",
    "read_testset": "select p_partkey as image_id, p_name as file_name, cast(len(string_split(p_name, ' ')) as int) as entities from part",
    "read_manifest": "select p_partkey as image_id, '/a.b/' || lpad(cast(p_partkey as varchar), 12, '0') || case when p_partkey % 2 = 0 then '.jpg' else '' end as path from part where p_partkey % 5 > 1",
    "read_movement": """
        select strftime(ts, '%Y-%m-%d') as Date, strftime(ts, '%H:%M:%S') as Time, event_type as Direction, cast(event_id as double) as X_start, case when value > 5 then value end as X_end,
               case when user_id % 2 = 1 then 7.5::double end as "CPU%", cast(null as double) as "GPU%" from events""",
    "read_filter_metrics": "select strftime(ts, '%H:%M:%S') as timestamp, event_type as filter, cast(event_id as int) as frame_index, case when value > 2 then value end as fps, cast(null as double) as gpu_percent from events",
    "read_telemetry_text": "select 'VIN ' || event_id || 'mW' as value from events",
    "read_reference_lines": "select cast(p_partkey as varchar) as code, p_name as text from part where p_partkey % 9 > 0",
    "read_sqlite": f"select Date, Time, direction_left, direction_right from ({MINUTES}) where Date in ('2024-01-03', '2024-01-04') and direction_left > 0",
    "write_enriched": "select o_orderkey as image_id, translate(o_orderpriority, ' -', '__') as model, o_orderstatus as device, true as named from orders",
    "write_reports": "select p_brand, count(*) as n, round(sum(p_retailprice), 2) as total, count(*) as n_json from part group by 1",
    "upserted_minutes": f"""
        select Date, Time, case when direction_left > 0 then direction_left + 100 else direction_left end as direction_left from ({MINUTES})
        union all select 'x' || Date, Time, direction_left from ({MINUTES}) where direction_left > 1""",
    "streamed_minutes": MINUTES,
    "streamed_history": f"with m as ({MINUTES}) select Date, Time, direction_left from m where cast(Date as date) > (select max(cast(Date as date)) from m) - 10",
    "streamed_directions": f"""
        with p as ({POINTS}), s as (
          select *, cast(sum(new) over (partition by source, track_id order by frame_idx) as int) as session from (
            select *, case when frame_idx - lag(frame_idx) over (partition by source, track_id order by frame_idx) - 1 > 800 then 1 else 0 end as new from p)),
        l as (select *, row_number() over (partition by source, track_id, session order by frame_idx desc) as r from s),
        g as (select source, track_id, session, cast(count(*) as int) as points, min_by(cx, frame_idx) as x_start, max_by(cx, frame_idx) as x_end, max(frame_idx) as last_frame from l where r <= 6 group by all having count(*) >= 4)
        select *, x_end - x_start as dx, case when x_end - x_start > 50 then 'Right' when x_end - x_start < -50 then 'Left' end as direction from g where (select max(frame_idx) from p) - last_frame > 801""",
    "streamed_changes": "select user_id, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value from events group by 1",
    "streamed_power": """
        select event_type as run, date_trunc('hour', ts) as start, round(avg(user_id * 8 / 1000), 6) as watts_avg, round(max(user_id * 8 / 1000), 6) as watts_peak, count(*) as samples, round(avg(user_id * 8 / 1000) * 3600, 6) as energy_joules
        from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) group by 1, 2""",
    "image_times": "select event_id, date_trunc('second', ts) as at, 'top' as camera from events",
}
