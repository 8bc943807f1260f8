"""Tracks, rollups, archive and photos."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from nodewell.functions import scalars, telemetry
from nodewell.operators import archive, stats, traffic
from nodewell.sources import logs

POINT = "source string, track_id long, frame_idx long, cx long"


def track(t, frames, xs, source="s"):
    return [(source, t, f, x) for f, x in zip(frames, xs)]


def directions(spark, rows, **options):
    return {(r.track_id, r.session): r for r in traffic.track_direction(spark.createDataFrame(rows, POINT), **options).collect()}


def test_sessions_end_after_more_than_120_absent_frames(spark):
    late = track(9, [100_000], [0])
    frames = [*range(20), *range(140, 160)]  # 120 absent frames: one session
    apart = [*range(20), *range(141, 161)]  # 121: two
    got = directions(spark, track(1, frames, range(0, 4000, 100)) + track(2, apart, range(0, 4000, 100)) + late)
    assert set(got) == {(1, 0), (2, 0), (2, 1)}
    assert got[2, 0].x_start == 0 and got[2, 0].x_end == 1900 and got[2, 0].direction == "Right"


def test_direction_fine_print(spark):
    late = track(9, [1000], [0])
    rows = track(1, range(14), range(0, 1400, 100)) + track(2, range(15), range(0, 1500, 100)) + track(3, range(200), range(0, 2000, 10)) + late
    got = directions(spark, rows)
    assert (1, 0) not in got and got[2, 0].points == 15
    assert got[3, 0].points == 120 and got[3, 0].x_start == 800  # the first of the last 120 points
    exact = directions(spark, track(1, range(15), [0] * 14 + [100]) + track(2, range(15), [0] * 14 + [-101]) + late)
    assert exact[1, 0].direction is None and exact[2, 0].direction == "Left"
    still = track(1, range(15), range(0, 1500, 100)) + track(9, [134], [0])  # 120 frames later is not enough
    assert directions(spark, still) == {} and len(directions(spark, still, closed_only=False)) == 1


def test_boxes_and_counters(spark):
    rows = [("s", 1, i, 10 * i, 0, 10 * i + 5, 7) for i in range(7)]
    b = traffic.smooth_boxes(spark.createDataFrame(rows, "source string, track_id int, frame_idx int, x1 int, y1 int, x2 int, y2 int"))
    assert [r.s_x1 for r in b.orderBy("frame_idx").collect()] == [0, 5, 10, 15, 20, 30, 40]
    box = spark.createDataFrame([(0, 0, 10, 10), (5, 5, 5, 5)], "a int, b int, c int, d int")
    padded = box.select(scalars.padded_box(*map(F.col, "abcd"), 0.5, F.lit(12), F.lit(12)).alias("p")).collect()
    assert tuple(padded[0].p) == (0, 0, 12, 12) and padded[1].p is None
    assert tuple(box.select(scalars.head_box(*map(F.col, "abcd")).alias("h")).first().h) == (0, 0, 10, 2)


MOVE = "Date string, Time string, Direction string, CPU_usage double, GPU_usage double, mem_usage double, CPU_temp double, GPU_temp double"


def test_minutes(spark):
    rows = [("2024-01-01", "10:00:01", "Right", 1.0, -1.0, 0.0, 2.0, -1.0), ("2024-01-01", "10:00:59", "Up", -1.0, -1.0, 1.0, 2.005, -1.0), ("2024-01-01", "10:00:30", None, 2.0, -1.0, 1.0, 2.0, -1.0), ("2024-01-01", "10:01:00", "Left", 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.Time: r for r in traffic.minute_rollup(spark.createDataFrame(rows, MOVE)).collect()}
    r = got["10:00"]
    assert (r.CPU_usage, r.GPU_usage, r.mem_usage, r.CPU_temp, r.direction_left, r.direction_right) == (1.5, -1.0, 0.67, 2.0, 1, 1)
    days = traffic.daily_totals(traffic.minute_rollup(spark.createDataFrame(rows, MOVE))).first()
    assert (days.left, days.right, days.total) == (2, 1, 3)


def test_upsert_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "minutes")
    schema = "Date string, Time string, n int"
    traffic.upsert_minutes(spark, spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], schema), path)
    traffic.upsert_minutes(spark, spark.createDataFrame([("a", "2", 20), ("c", "1", 4)], schema), path)
    got = sorted((r.Date, r.Time, r.n) for r in traffic.read_minutes(spark, path).collect())
    assert got == [("a", "1", 1), ("a", "2", 20), ("b", "1", 3), ("c", "1", 4)]
    with pytest.raises(Exception):
        traffic.upsert_minutes(spark, spark.createDataFrame([("a", "9", 9)], schema), "nosuchscheme://x/minutes")


def test_dashboard_window(spark):
    rows = [("2024-01-08", "10:00", 1, 2), ("2024-01-08", "11:00", 1, 0), ("2024-01-07", "10:00", 0, 4), ("2024-01-06", "10:00", 0, 0), ("2024-01-03", "10:00", 3, 0), ("2024-01-02", "10:00", 50, 0)]
    m = spark.createDataFrame(rows, "Date string, Time string, direction_left long, direction_right long")
    r = traffic.traffic_dashboard(m, "2024-01-08 12:00:00").first()  # January 2 at midnight is over six days ago
    assert (r.today_left, r.today_right, r.avg_left, r.avg_right, r.avg_daily_total, r.peak_day, r.peak_total) == (2, 2, 3, 3, 4, "2024-01-07", 4)  # 2.5 and 3.67 are rounded up
    assert traffic.traffic_dashboard(m, "2024-01-08 00:00:00").first().peak_day == "2024-01-02"
    none = traffic.traffic_dashboard(m.where("Date = '2024-01-06'"), "2024-01-08 12:00:00").first()
    assert (none.today_left, none.avg_left, none.avg_daily_total, none.peak_day) == (0, None, None, None)


def test_feed_and_days_that_come_back(spark):
    f = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "t int, v string")
    assert [r.t for r in traffic.change_feed(f, ("t",), ["v"]).collect()] == [1, 3, 5]
    text = []
    for day, side in (("01", " Right"), ("01", "Right"), ("02", " Right"), ("01", " Right")):
        text += [f"Date: 2024-01-{day}", "Time: 10:00:00", "CPU Usage: 50.5%,x", "Mem Usage: 20%", "Encountered exception!", "", "Swp Usage: 1%", "CPU Temp: 40.0C", "GPU Temp: 30C", "X Position: 1->2", f"Direction:{side}"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate([*text, "Date: cut off"])], "file string, pos int, line string")
    b = logs.legacy_blocks(lines)
    one = b.orderBy("block").first()
    assert b.count() == 4 and (one.date, one.time, one.cpu, one.mem, one.swap, one.cpu_temp, one.gpu_temp, one.direction) == ("2024-01-01", "10:00:00", 50.5, 20.0, 1.0, 40.0, 30.0, " Right")
    days = [(r.date, r.left, r.right) for r in traffic.day_rollup(b).orderBy("run").collect()]
    assert days == [("2024-01-01", 1, 1), ("2024-01-02", 0, 1), ("2024-01-01", 0, 1)]


def test_log_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Time,Direction,X_start,X_end,CPU%,RAM_used_MB,RAM_total_MB,GPU%,CPU_temp_C,GPU_temp_C\nd,t,Left,1,2,3,4,5,6,x,8\n")
    m = logs.read_movement(spark, str(tmp_path / "a.csv")).first()
    assert m["GPU%"] == 6.0 and m["RAM_used_MB"] == 4.0 and m["CPU_temp_C"] is None
    (tmp_path / "b.csv").write_text('Date,Time,Direction,X_start,X_end,CPU%,GPU%,RAM_used_MB,RAM_total_MB,CPU_temp_C,GPU_temp_C\n"d2",t,Right,1,2,3,60,40,50,7,8\n')
    both = {r.Date: (r["GPU%"], r["RAM_used_MB"]) for r in logs.read_movement(spark, str(tmp_path / "*.csv")).collect()}
    assert both == {"d": (6.0, 4.0), "d2": (60.0, 40.0)}  # one folder, both orders
    (tmp_path / "metrics_blur.csv").write_text("timestamp,frame_index,fps,cpu_percent,memory_percent,gpu_percent\nt,1,30.5,bad,,7\n")
    f = logs.read_filter_metrics(spark, str(tmp_path / "metrics_*.csv")).first()
    assert (f["filter"], f.frame_index, f.fps, f.cpu_percent, f.gpu_percent) == ("blur", 1, 30.5, None, 7.0)
    (tmp_path / "metrics_more.csv").write_text("timestamp,filter,frame_index,fps,cpu_percent,memory_percent,gpu_percent\nt,box,2,10,1,2,3\nt,,3,11,1,2,3\n")
    mixed = {(r["filter"], r.frame_index, r.fps) for r in logs.read_filter_metrics(spark, str(tmp_path / "metrics_*.csv")).collect()}
    assert mixed == {("blur", 1, 30.5), ("box", 2, 10.0), ("more", 3, 11.0)}
    (tmp_path / "log.txt").write_text("\r\n".join(["Date: d", "Time: t", "CPU Usage: 3%", "Mem Usage: 4%", "Swp Usage: 5%", "CPU Temp: 6C", "GPU Temp: 7C", "X Position: 1->2", "Direction: Left"]))
    told = logs.read_legacy_log(spark, str(tmp_path / "log.txt")).first()
    assert (told.cpu, told.gpu_temp, told.direction) == (3.0, 7.0, " Left")
    (tmp_path / "r.txt").write_text("abc-1 some words here\n\n")
    assert tuple(logs.read_reference_lines(spark, str(tmp_path / "r.txt")).first()) == ("abc-1", "some words here")
    (tmp_path / "u1.flac.txt").write_bytes("naïve “€".encode("cp1252"))
    (tmp_path / "u2.flac.txt").write_bytes("ÁÉ ā".encode())
    assert {tuple(r) for r in logs.read_hypotheses(spark, str(tmp_path / "*.flac.txt")).collect()} == {("u1", "naïve “€"), ("u2", "ÁÉ ā")}
    (tmp_path / "call.nlp").write_text("token|x\nHello|1\n\nworld|2\n")
    assert tuple(logs.read_token_files(spark, str(tmp_path / "call.nlp")).first()) == ("call", "Hello world")


def test_image_index_and_times(spark, tmp_path):
    for p in ("2022/07/07/06/2022-07-07T06:00:02+0000.jpg", "2022/07/07/07/2022-07-07T07:00:02.jpg", "2021-07-24/top_2021-07-24_00-00-02.jpg", "2021-07-24/notes.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = logs.index_images(spark, str(tmp_path)).select(scalars.image_timestamp(F.col("path")).alias("t"), scalars.camera_of(F.col("path")).alias("c")).collect()
    assert {(r.t, r.c) for r in got} == {(datetime(2022, 7, 7, 6, 0, 2), None), (datetime(2022, 7, 7, 7, 0, 2), None), (datetime(2021, 7, 24, 0, 0, 2), "top")}
    assert spark.range(1).select(scalars.image_timestamp(F.lit("x_2021-13-40_00-00-00.jpg"))).first()[0] is None
    b = spark.range(1).select(scalars.bounds(F.lit(datetime(2024, 2, 10, 5)), "month").alias("b")).first().b
    assert (b.start, b.end) == (datetime(2024, 2, 1), datetime(2024, 3, 1))


def test_nearest_frames(spark):
    t = lambda d, h, m=0: datetime(2024, 1, d, h, m)
    frames = spark.createDataFrame([(t(1, 10), "a"), (t(1, 10, 20), "b"), (t(1, 23), "c"), (t(5, 9), "d"), (t(3, 9), "e"), (t(3, 20), "f")], "ts timestamp_ntz, path string")
    odd = archive.nearest_frame(spark.createDataFrame([(1, t(2, 12))], "request_id int, at timestamp_ntz"), spark.createDataFrame([(t(3, 0, 5), "p"), (t(3, 12), "q")], "ts timestamp_ntz, path string"))
    assert odd.first().path == "p"  # the least apart, not the nearest time of day
    asked = [(1, t(1, 10, 10)), (2, t(1, 10, 16)), (3, t(1, 9, 29)), (4, t(1, 18)), (5, t(4, 9, 30)), (6, datetime(2025, 1, 1)), (7, t(2, 19, 0))]
    got = {r.request_id: (r.stage, r.path) for r in archive.nearest_frame(spark.createDataFrame(asked, "request_id int, at timestamp_ntz"), frames).collect()}
    assert got[1] == (1, "a")  # a tie: the earlier
    assert got[2] == (1, "b") and got[3] == (2, "a") and got[4] == (2, "c")
    assert got[5] == (3, "d") and got[6] == (None, None)  # of two days as near the later
    assert got[7] == (3, "e")


def test_playback_photos(spark):
    f = spark.createDataFrame([(datetime(2024, 1, 1, 10), "a", "c"), (datetime(2024, 1, 1, 10, 30), "b", "c"), (datetime(2024, 1, 1, 11), "d", "c"), (datetime(2024, 1, 2), "e", "c")], "ts timestamp_ntz, path string, camera string")
    nxt = lambda m: {r.path: r.next_path for r in archive.playback_sequence(f, m).collect()}
    assert nxt("none") == {"a": "b", "b": "d", "d": "e", "e": None} and nxt("full")["e"] == "a"
    assert nxt("day") == {"a": "b", "b": "d", "d": "a", "e": "e"} and nxt("hour")["b"] == "a"
    p = spark.createDataFrame([(f"f{i}", str(i), "sun" if i % 2 else None, "few", "good", "day") for i in range(5)], "filename string, datetime string, weather string, people string, visibility string, time string")
    assert [r.filename for r in archive.search_photos(p, 0, weather="sun").collect()] == ["f1"] and archive.search_photos(p, weather=None).count() == 5
    with pytest.raises(ValueError):
        archive.search_photos(p, colour="red")
    top = {(r.label, r.value): (r.n, r["total"]) for r in archive.top_categories(p).collect()}
    assert top["weather", "sun"] == (2, 2) and top["time", "day"] == (5, 5)


def test_telemetry(spark):
    lines = ["RAM 1000/2000MB CPU [10%@1200,20%@1300,off] EMC_FREQ 5% GR3D_FREQ @[314,316] VIN 60000mW/60000mW VDD_GPU_SOC 1000mW/1mW tj@51.5C cpu@50C GPU@49C", "GR3D_FREQ 45%@318", "GR3D_FREQ 0%@[0,2]", "junk"]
    t = [r.t for r in spark.createDataFrame([(x,) for x in lines], "l string").select(telemetry.parse_telemetry(F.col("l")).alias("t")).collect()]
    assert t[0].rails == {"VIN": 60.0, "VDD_GPU_SOC": 1.0} and t[0].cpu_percent == 15.0 and t[0].cpu_mhz == 1250.0 and t[0].gpu_mhz == 315.0 and t[0].gpu_percent is None
    assert (t[1].gpu_percent, t[1].gpu_mhz, t[2].gpu_percent, t[2].gpu_mhz) == (45.0, 318.0, 0.0, 1.0)
    assert t[0].gpu_mhz_peak == 316.0 and t[1].gpu_mhz_peak == 318.0
    assert t[3].rails == {} and t[3].ram_used_mb is None
    n = spark.createDataFrame([(lines[0],)], "l string").select(telemetry.parse_node_stats(F.col("l")).alias("n")).first().n
    assert (n.ram_total_mb, n.cpu_percent, n.cpu_c, n.gpu_c) == (2000.0, 15.0, 50.0, 49.0)
    s = spark.createDataFrame([("r", datetime(2024, 1, 1, 0, 0, i), {"VIN": 10.0 * i} if i else {"X": 1.0, "Y": 2.0}) for i in range(3)], "run string, ts timestamp_ntz, rails map<string, double>")
    p = stats.power_summary(s).first()
    assert (p.power_watts_avg, p.power_watts_peak, p.duration_seconds, p.energy_joules_est, p.sample_count) == (15.0, 20.0, 2.0, 30.0, 3)

    def headline(edition="board", **rails):
        row = spark.createDataFrame([("r", datetime(2024, 1, 1), rails)], "run string, ts timestamp_ntz, rails map<string, double>")
        return stats.power_summary(row, edition=edition).first().power_watts_avg

    assert headline(VDD_GPU_SOC=10.0, VDD_CPU_CV=5.0, VIN_SYS_5V0=3.0) == 18.0 and headline(VDD_GPU_SOC=10.0, VDD_CPU_CV=5.0) == 15.0
    assert headline(VDD_GPU_SOC=10.0, VIN_SYS_5V0=3.0) == 3.0 and headline(VDD_GPU=10.0) is None
    assert headline("gpu", VDD_GPU=10.0) == 10.0 and headline("gpu", VDD_GPU=10.0, VDD_GPU_SOC=2.0) == 2.0
    m = stats.meter_summary(spark.createDataFrame([("r", datetime(2024, 1, 1, 0, 0, 3 * i), w) for i, w in enumerate((1.0, 2.0, 4.0))], "run string, ts timestamp_ntz, watts double")).first()
    assert (m.power_watts_avg, m.power_watts_peak, m.power_watts_min, m.energy_joules_est, m.sample_count, m.duration_seconds) == (2.33, 4.0, 1.0, 14.0, 3, 6.0)


def test_a_log_that_starts_again_with_another_order(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.csv").write_text("2023-12-31,09:00,Left,0,9\nDate,Time,Direction,X_start,X_end\n2024-01-01,10:00,Left,1,2\n\nDate,Time,X_end,X_start,Direction\n2024-01-02,10:00,4,3,Right\n")
    (folder / "b.csv").write_text("Date,X_end,Time\n2024-01-03,6,11:00\n")
    (folder / "c.csv").write_text("no header,1\n")
    got = sorted((r.Date, r.Time, r.Direction, r.X_start, r.X_end) for r in logs.read_movement(spark, str(folder)).collect())
    assert got == [("2023-12-31", "09:00", "Left", 0.0, 9.0), ("2024-01-01", "10:00", "Left", 1.0, 2.0), ("2024-01-02", "10:00", "Right", 3.0, 4.0), ("2024-01-03", "11:00", None, None, 6.0)]
