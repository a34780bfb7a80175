"""Readers and writers on small files with malformed lines."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.timing import parse_time
from roadpulse.operators.trajectories import traversals_2016
from roadpulse.sources import network, statistics, trajectories, weather
from roadpulse.spec import GridSpec

W = datetime(2016, 3, 1, 12, 20)


def file(tmp_path, text, name="part-0"):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_edges_and_vertices(spark, tmp_path):
    path = file(tmp_path, "1\t10\t11\t35.5\n2\t11\t12\t7\n")
    assert [tuple(r) for r in network.read_edges(spark, path).collect()] == [(1, 10, 11, 35.5), (2, 11, 12, 7.0)]
    path = file(tmp_path, "10\t116.5\t39.9\n")
    assert [tuple(r) for r in network.read_vertices(spark, path).collect()] == [(10, 116.5, 39.9)]


def test_edges_geo(spark, tmp_path):
    line = "7:a:b:c:{}:d:e:120:f:LINESTRING (116.25 39.5, 116.3 39.6, 116.75 39.875)\n"
    path = file(tmp_path, line.format("0x03") + line.format("0x05"))
    rows = network.read_edges_geo(spark, path).collect()
    assert [(tuple(r["start"]), tuple(r["end"]), r["length"], r["road_class"]) for r in rows] == [
        ((116.25, 39.5), (116.75, 39.875), 120, 3),
        ((116.25, 39.5), (116.75, 39.875), 120, None),
    ]
    with pytest.raises(Exception, match="unknown road class 0x05"):
        network.read_edges_geo(spark, path, strict=True).collect()


def test_subnet_drops_every_header_line(spark, tmp_path):
    line = '12,801,33,34,1,0x02,0x01,5,60,31,"LINESTRING (116.5 39.5, 116.625 39.625)"\n'
    path = file(tmp_path, "id,edge_id,s\n" + line + "id,edge_id,s\n" + line)
    rows = [tuple(r) for r in network.read_subnet(spark, path).collect()]
    assert rows == [(801, 33, 34, "0x02", 5, 60, 31)] * 2


def test_trajectories_count_the_id(spark, tmp_path):
    path = file(tmp_path, "5,20160301000501|7,20160301000601|8,\n6,20160301000501|7\n")
    got = trajectories.read_trajectories(spark, path, min_edges=3).collect()
    assert [(r["traj_id"], [s["edge_id"] for s in r["path"]]) for r in got] == [(5, [7, 8])]
    assert trajectories.read_trajectories(spark, path, min_edges=3, count_id_token=False).count() == 0
    assert got[0]["path"][0]["t"] == datetime(2016, 3, 1, 0, 5, 1)


def fields(**changed):
    base = [""] * 28
    base[4], base[8], base[10], base[11] = "1|2|3", "100|110|130", "5|6|7", "3"
    base[22:26] = ["116.1", "39.1", "116.2", "39.2"]
    base[27] = "150"
    for key, value in changed.items():
        base[int(key[1:])] = value
    return ",".join(base) + "\n"


def test_trajectories_2016(spark, tmp_path):
    short = ",".join([""] * 20) + "\n"
    path = file(tmp_path, fields() + short + fields(f11="many") + fields(f11="9") + fields(f27="") + fields(f10="5"))
    good, corrupt = trajectories.read_trajectories_2016(spark, path, 2, 5)
    rows = good.collect()
    assert [(r["edges"], r["times"], r["first_len"], r["last_len"]) for r in rows] == [
        ([1, 2, 3], [100, 110, 130, 150], 5, 7),
        ([1, 2, 3], [100, 110, 130, 150], 5, 5),
    ]
    assert sorted(r["line"] for r in corrupt.collect()) == [1, 2, 4]
    steps = traversals_2016(good).filter(F.col("first_len") == 5).orderBy("traj_id", "seq").collect()
    assert [s["seconds"] for s in steps[:3]] == [10, 20, 20]
    again = tmp_path / "again"
    trajectories.trajectory_lines_2016(good).write.text(str(again))
    back, _ = trajectories.read_trajectories_2016(spark, str(again))
    assert sorted(map(str, back.drop("traj_id").collect())) == sorted(map(str, good.drop("traj_id").collect()))


def test_a_wrong_list_item_fails_the_job(spark, tmp_path):
    good, _ = trajectories.read_trajectories_2016(spark, file(tmp_path, fields(f4="1|x|3")), 2, 5)
    with pytest.raises(Exception, match="x"):
        good.collect()


@pytest.mark.parametrize(("month", "n"), [(3, 2), (4, 1), (None, 3), (-1, 3)])
def test_month_folders(spark, tmp_path, month, n):
    for folder in ("03/01", "03/02", "04/01"):
        target = tmp_path / "base" / folder
        target.mkdir(parents=True)
        (target / "part-0").write_text(fields())
    good, _ = trajectories.read_trajectories_2016(spark, str(tmp_path / "base"), month=month, by_month=True)
    assert good.count() == n


def _with(spark, **settings):
    """Sets session settings; gives back what undoes it."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.set(k, v) for k, v in before.items()]


def test_trip_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [fields(f4=f"{i}|2|3") if i % 9 else ",".join([""] * 20) + "\n" for i in range(400)]
    for name, part in (("a", lines[:250]), ("b", lines[250:])):
        (tmp_path / name).write_text("".join(part))
    found = []
    for size in ("134217728b", "3000b", "700b"):
        back = _with(spark, **{"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1b"})
        good, corrupt = trajectories.read_trajectories_2016(spark, str(tmp_path))
        found.append((sorted((r["traj_id"], r["edges"][0]) for r in good.collect()), sorted((r["file"], r["line"]) for r in corrupt.collect()), good.rdd.getNumPartitions()))
        back()
    assert found[0][:2] == found[1][:2] == found[2][:2] and found[2][2] > found[1][2] > found[0][2]
    assert len({i for i, _ in found[0][0]}) == len(found[0][0]) == sum(i % 9 > 0 for i in range(400))
    assert [n for _, n in found[0][1]][:3] == [0, 9, 18]


def test_a_month_reads_only_its_folders(spark, tmp_path):
    rows = [(fields(f4=f"{i}|2|3").strip(), 1 + i % 2, f"{1 + i % 3:02d}") for i in range(60)]
    path = str(tmp_path / "store")
    trajectories.write_months(spark.createDataFrame(rows, "value string, month int, day string"), path)
    good, _ = trajectories.read_months_2016(spark, path, [2])
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "(month#" in plan
    kept = spark.read.text(path).where("month = 2").select("_metadata.file_path").distinct().count()
    # Files of the other month can go and nothing is missed.
    for part in (tmp_path / "store" / "month=1").rglob("part-*"):
        part.write_text("not a trip\n")
    good, corrupt = trajectories.read_months_2016(spark, path, [2])
    assert sorted(r["edges"][0] for r in good.collect()) == list(range(1, 60, 2)) and corrupt.count() == 0 and kept >= 3


def test_a_heavy_day_has_several_files(spark, tmp_path):
    heavy = spark.range(400_000).select(
        F.when(F.col("id") < 390_000, F.lit("2016-03-01 00:00:00")).otherwise(F.lit("2016-03-02 00:20:00")).cast("timestamp").alias("w"),
        F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.rand(1).alias("speed"), F.lit(1).cast("long").alias("num"),
    )
    back = _with(spark, **{"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512kb"})
    statistics.write_panel(heavy.repartition(8), str(tmp_path / "panel"))
    back()
    files = {d: len(list((tmp_path / "panel" / f"day=2016-03-0{d}").glob("part-*"))) for d in (1, 2)}
    assert files[1] > 3 and files[2] <= 2
    assert statistics.load_panel(spark, str(tmp_path / "panel")).count() == 400_000


def test_change_ranking_reads_its_first_parts(spark, tmp_path):
    change = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 1200).alias("w"), (F.col("id") * 37 % 500).cast("double").alias("diff"))
    path = str(tmp_path / "changes")
    statistics.save_changes(change, path, parts=10)
    top = statistics.load_top_changes(spark, path, 42)
    want = change.orderBy(F.col("diff").desc(), "w").limit(42).collect()
    assert top.collect() == want
    # Only the first parts are opened: the others can be anything.
    for part in (tmp_path / "changes" / "ranks").glob("part=[1-9]/part-*"):
        part.write_bytes(b"nothing")
    assert statistics.load_top_changes(spark, path, 42).collect() == want
    path = str(tmp_path / "again")
    statistics.save_changes(change, path, parts=10)
    assert statistics.load_top_changes(spark, path, 5000).count() == 1000
    statistics.save_changes(change.limit(0), str(tmp_path / "none"))
    assert statistics.load_top_changes(spark, str(tmp_path / "none"), 3).count() == 0


def test_link_stats_read_part_files_only(spark, tmp_path):
    path = file(tmp_path, "9|(201603011220,30,2)|(201603011240,5,1)\n8\n")
    file(tmp_path, "1|(201603011220,1,1)\n", name="other")
    rows = statistics.read_link_stats(spark, path).orderBy("w").collect()
    assert [(r["edge_id"], r["travel_time"], r["num"]) for r in rows] == [(9, 30, 2), (9, 5, 1)]
    assert rows[0]["w"] == W


def test_panel_lines(spark, tmp_path):
    path = file(tmp_path, "201603011220|(0,1,2.5,3)|(1,0,4.0)\n\n201603011240\n")
    rows = sorted(tuple(r) for r in statistics.read_panel(spark, path).collect())
    assert rows == [(W, 0, 1, 2.5, 3), (W, 1, 0, 4.0, 0)]
    assert statistics.read_panel_times(spark, path).count() == 2


def test_no_signal_file(spark, tmp_path):
    grid = GridSpec(0.0, 0.0, 1.0, 1.0, 4, 4)
    cells = spark.createDataFrame([(0, 3), (2, 1)], "x int, y int")
    statistics.write_no_signal(cells, str(tmp_path / "out"), grid)
    assert sorted(tuple(r) for r in statistics.read_no_signal(spark, str(tmp_path / "out"), grid).collect()) == [(0, 3), (2, 1)]
    empty = cells.limit(0)
    statistics.write_no_signal(empty, str(tmp_path / "empty"), grid)
    assert statistics.read_no_signal(spark, str(tmp_path / "empty"), grid).count() == 0
    with pytest.raises(Exception, match="no-signal"):
        statistics.read_no_signal(spark, file(tmp_path, "3\n1,2,\n"), grid).collect()


def test_panel_round_trips(spark, tmp_path):
    rows = [(W, 0, 1, 2.5, 3), (W, 1, 0, 0.0, 0), (datetime(2016, 3, 2), 1, 1, 7.0, 1)]
    panel = spark.createDataFrame(rows, "w timestamp, x int, y int, speed double, num long")
    for text in (False, True):
        path = str(tmp_path / f"panel{text}")
        statistics.write_panel(panel, path, text=text)
        back = statistics.read_panel(spark, path) if text else statistics.load_panel(spark, path).drop("day")
        assert sorted(tuple(r) for r in back.select("w", "x", "y", "speed", "num").collect()) == rows
    statistics.write_panel(panel, str(tmp_path / "kept"), drop_zero=True)
    assert statistics.load_panel(spark, str(tmp_path / "kept")).count() == 2


def test_link_speed_lines_stay_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(statistics, "ROADS_PER_LINE", 3)
    speeds = spark.range(10).select(
        F.col("id").alias("edge_id"), parse_time(F.lit("201603011220")).alias("w"), (F.col("id") / 2).alias("speed"),
        F.lit(1).cast("long").alias("num"),
    )
    statistics.write_link_speed(speeds, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    assert statistics.read_link_speed(spark, str(tmp_path / "out")).count() == 10


def test_results_by_parameter(spark, tmp_path):
    df = spark.range(3)
    for minutes in (5, 20):
        statistics.write_partitioned(df, str(tmp_path / "r"), min_edges=10, time_window=minutes)
    # Writing one of them again replaces it and leaves the other.
    statistics.write_partitioned(df.limit(2), str(tmp_path / "r"), min_edges=10, time_window=5)
    assert statistics.load_partitioned(spark, str(tmp_path / "r"), time_window=5).count() == 2
    kept = statistics.load_partitioned(spark, str(tmp_path / "r"), time_window=20)
    assert kept.count() == 3
    assert "PartitionFilters: [isnotnull(time_window" in kept._jdf.queryExecution().executedPlan().toString()


def test_road_num(spark, tmp_path):
    counts = spark.createDataFrame([(1, 5), (2, 100), (3, 101)], "edge_id long, num long")
    stored = statistics.save_road_num(counts, str(tmp_path / "r"), 100)
    assert stored.endswith("_min100")
    assert sorted(tuple(r) for r in statistics.load_road_num(spark, stored).collect()) == [(2, 100), (3, 101)]


def test_weather_pages(spark):
    def day(date, top, low, text, wind):
        return f'<ul>\n<li><a href="x">{date}</a></li><li>{top}</li><li>{low}</li><li>{text}</li><li>北风</li><li>{wind}</li></ul>'

    html = (
        '<ul><li><a>2015-01-01</a></li></ul><div class="tqtongji2">\n<ul class="t1"><li>日期</li></ul>'
        + day("2016-01-01", 5, -5, "晴", "微风") + day("2016-01-02", 6, -4, "小雪", "小于3级") + "</div><ul><a>no</a></ul>"
    )
    rows = weather.weather_pages(spark.createDataFrame([("u", html)], "url string, html string")).orderBy("date").collect()
    assert [(str(r["date"]), r["max_t"], r["min_t"], r["weather"], r["wind"]) for r in rows] == [
        ("2016-01-01", 5, -5, "晴", "微风"), ("2016-01-02", 6, -4, "小雪", "小于3级"),
    ]


def test_weather_and_holiday_files(spark, tmp_path):
    path = file(tmp_path, "20160101,5,-5,晴,微风\n")
    assert weather.read_weather(spark, path).first()["max_t"] == 5
    path = file(tmp_path, "20160101\n20160101\n\n20160207\n")
    assert weather.read_holidays(spark, path).count() == 2
