"""One query per operator over the given tables, checked against ``oracle``.

Windows leave as ``yyyyMMddHHmm`` text and doubles rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions import calendar, geo, labels, scaling, timing
from roadpulse.operators import (
    evaluate,
    features,
    gaps,
    histogram_trees,
    information,
    links,
    marks,
    models,
    network,
    panel,
    runs,
    trajectories,
    trees,
)
from roadpulse.plans.tables import CPT, GRID, MINUTES, TREE_EXTERNALS, Tables
from roadpulse.session import stage, stage_path
from roadpulse.sources import network as network_files
from roadpulse.sources import statistics as stat_files
from roadpulse.sources import trajectories as traj_files
from roadpulse.sources import weather as weather_files

Query = Callable[[SparkSession, str], DataFrame]

LEN_TEST = 100

_registry: dict[str, Query] = {}


def _query(name: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _registry[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        return fn

    return keep


def _shown(df: DataFrame) -> DataFrame:
    """Timestamps as text and doubles rounded."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = timing.format_second(c) if f.name in ("t", "next_t") else timing.format_time(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyyMMdd")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _number(df: DataFrame, **columns) -> DataFrame:
    return _shown(df.select(*[c.alias(n) for n, c in columns.items()]))


# Sources and sinks: write the form a file has, read it back.


def _write_text(lines: DataFrame, name: str) -> str:
    path = stage_path(lines.sparkSession, name)
    lines.write.mode("overwrite").text(path)
    return path


@_query("read_edges")
def read_edges(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "edges")
    k.edge.select("edge_id", "s_id", "e_id", "length").write.csv(path, sep="\t")
    return _shown(network_files.read_edges(k.spark, path))


@_query("read_vertices")
def read_vertices(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "vertices")
    k.vertex.write.csv(path, sep="\t")
    return _shown(network_files.read_vertices(k.spark, path))


@_query("read_edges_geo")
def read_edges_geo(k: Tables) -> DataFrame:
    line = F.concat(
        F.lit("LINESTRING ("), F.concat_ws(" ", "start.lon", "start.lat"), F.lit(", "),
        F.concat_ws(" ", "end.lon", "end.lat"), F.lit(")"),
    )
    code = F.concat(F.lit("0x0"), F.col("road_class").cast("string"))
    empty = F.lit("")
    lines = k.edge_geo.select(
        F.concat_ws(
            ":", F.col("edge_id").cast("string"), empty, empty, empty, code, empty, empty,
            F.col("length").cast("string"), empty, line,
        ).alias("value")
    )
    edges = network_files.read_edges_geo(k.spark, _write_text(lines, "edges_geo"), strict=True)
    return _shown(
        edges.select(
            "edge_id", F.col("start.lon").alias("start_lon"), F.col("start.lat").alias("start_lat"),
            F.col("end.lon").alias("end_lon"), F.col("end.lat").alias("end_lat"), "length", "road_class",
        )
    )


@_query("read_subnet")
def read_subnet(k: Tables) -> DataFrame:
    c = {n: F.col(n).cast("string") for n in ("edge_id", "s_id", "e_id", "road_class", "width", "length", "speed_limit")}
    lines = k.subnet.select(
        F.concat_ws(
            ",", F.lit("0"), c["edge_id"], c["s_id"], c["e_id"], F.lit("2"), c["road_class"], F.lit("0x00"),
            c["width"], c["length"], c["speed_limit"], F.lit('"LINESTRING (0 0, 1 1)"'),
        ).alias("value")
    )
    head = k.spark.range(1).select(F.lit("id,edge_id,s_id,e_id,dir,class,kind,width,length,limit,geometry").alias("value"))
    return network_files.read_subnet(k.spark, _write_text(head.unionByName(lines), "subnet"))


@_query("read_trajectories")
def read_trajectories(k: Tables) -> DataFrame:
    lines = traj_files.trajectory_lines(k.trajectory)
    traj = traj_files.read_trajectories(k.spark, _write_text(lines, "trajectories"), min_edges=10)
    return _shown(trajectories.trajectory_sequence(traj).select("traj_id", "seq", "edge_id", "t"))


@_query("read_trajectories_2016")
def read_trajectories_2016(k: Tables) -> DataFrame:
    lines = traj_files.trajectory_lines_2016(k.trajectory_2016)
    good, _ = traj_files.read_trajectories_2016(k.spark, _write_text(lines, "trajectories_2016"), 5, 100)
    return _shown(
        good.select(
            F.array_join(F.col("edges").cast("array<string>"), "|").alias("edges"),
            F.array_join(F.col("times").cast("array<string>"), "|").alias("times"),
            F.col("start_pt.lon").alias("start_lon"), F.col("start_pt.lat").alias("start_lat"),
            F.col("end_pt.lon").alias("end_lon"), F.col("end_pt.lat").alias("end_lat"),
            "first_len", "last_len",
        )
    )


@_query("month_scan")
def month_scan(k: Tables) -> DataFrame:
    """2016 trips stored in two month folders, by the parity of their first road, each month read back alone."""
    base = stage_path(k.spark, "months")
    lines = traj_files.trajectory_lines_2016(k.trajectory_2016)
    first_time = F.split(F.split("value", ",")[8], r"\|")[0].cast("bigint")
    day = F.date_format(timing.epoch_to_timestamp(first_time), "dd")
    first_edge = F.split(F.split("value", ",")[4], r"\|")[0].cast("bigint")
    traj_files.write_months(lines.withColumns({"month": (first_edge % 2 + 1).cast("int"), "day": day}), base)
    months = [traj_files.read_months_2016(k.spark, base, [month])[0] for month in (1, 2)]
    good = months[0].unionByName(months[1])
    return good.select(F.col("edges")[0].alias("first_edge")).groupBy("first_edge").agg(F.count(F.lit(1)).alias("trips"))


@_query("read_link_stats")
def read_link_stats(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "link_stats")
    stat_files.write_link_stats(k.link_stat(), path, text=True)
    return _shown(stat_files.read_link_stats(k.spark, path))


@_query("write_link_stats")
def write_link_stats(k: Tables) -> DataFrame:
    """The text lines themselves."""
    path = stage_path(k.spark, "link_stats")
    stat_files.write_link_stats(k.link_stat(MINUTES), path, text=True)
    return k.spark.read.text(path).select(F.col("value").alias("line"))


@_query("read_panel")
def read_panel(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "panel")
    stat_files.write_panel(k.panel, path, text=True)
    return _shown(stat_files.read_panel(k.spark, path))


@_query("write_panel")
def write_panel(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "panel")
    stat_files.write_panel(k.dense, path, drop_zero=True)
    return _shown(stat_files.load_panel(k.spark, path).drop("day"))


@_query("read_link_speed")
def read_link_speed(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "link_speed")
    stat_files.write_link_speed(k.link_speed, path)
    return _shown(stat_files.read_link_speed(k.spark, path))


@_query("read_no_signal")
def read_no_signal(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "no_signal")
    stat_files.write_no_signal(k.silent, path, GRID)
    return stat_files.read_no_signal(k.spark, path, GRID)


@_query("path_partitioned_result")
def path_partitioned_result(k: Tables) -> DataFrame:
    """Two window lengths stored by parameter, one read back."""
    path = stage_path(k.spark, "results")
    for minutes in (MINUTES, 60):
        result = runs.cell_speed_from_runs(k.traversal, k.edge, k.vertex, GRID, minutes)
        stat_files.write_partitioned(result, path, lon_split=GRID.nx, lat_split=GRID.ny, time_window=minutes)
    return _shown(stat_files.load_partitioned(k.spark, path, time_window=60))


@_query("result_store")
def result_store(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "prediction")
    stat_files.save_result(k.pred, path)
    return _shown(stat_files.load_result(k.spark, path))


@_query("road_num_store")
def road_num_store(k: Tables) -> DataFrame:
    path = stage_path(k.spark, "road_num")
    stored = stat_files.save_road_num(links.road_trip_count(k.link_stat()), path, 4)
    return stat_files.load_road_num(k.spark, stored)


# Scalar expressions.


@_query("window_floor")
def window_floor(k: Tables) -> DataFrame:
    t = F.col("t")
    return _shown(k.traversal.select(
        "traj_id", "seq", timing.window_floor(t, 20).alias("w20"), timing.window_floor(t, 50).alias("w50"),
        timing.window_floor(t, 7).alias("w7"),
    ))


@_query("time_diff")
def time_diff(k: Tables) -> DataFrame:
    trav = k.traversal
    midday = F.concat(F.date_format("t", "yyyyMMdd"), F.lit("120000"))
    return trav.select(
        "traj_id", "seq", timing.time_diff(midday, timing.format_second(F.col("t"))).alias("seconds")
    )


@_query("epoch_to_time")
def epoch_to_time(k: Tables) -> DataFrame:
    epoch = F.unix_seconds("t")
    return k.traversal.select(
        "traj_id", "seq", timing.epoch_to_time(epoch).alias("beijing"),
        timing.epoch_to_time(epoch, "-03:30").alias("newfoundland"),
    )


@_query("grid_xy")
def grid_xy(k: Tables) -> DataFrame:
    xy = geo.grid_xy(F.col("lon"), F.col("lat"), GRID)
    return k.vertex.select("vertex_id", xy["x"].alias("x"), xy["y"].alias("y"))


def _vertex_cells(k: Tables) -> DataFrame:
    xy = geo.grid_xy(F.col("lon"), F.col("lat"), GRID)
    return k.vertex.select("vertex_id", xy["x"].alias("x"), xy["y"].alias("y")).filter("x >= 0")


@_query("cell_id")
def cell_id(k: Tables) -> DataFrame:
    return _vertex_cells(k).select("vertex_id", geo.cell_id(F.col("x"), F.col("y"), GRID).alias("cell"))


@_query("cell_xy")
def cell_xy(k: Tables) -> DataFrame:
    cell = (F.col("vertex_id") % GRID.cells).cast("int")
    xy = geo.cell_xy(cell, GRID)
    return k.vertex.select("vertex_id", xy["x"].alias("x"), xy["y"].alias("y"))


@_query("road_class_code")
def road_class_code(k: Tables) -> DataFrame:
    code = F.concat(F.lit("0x0"), F.lower(F.hex(F.col("edge_id") % 16)))
    return k.edge.select("edge_id", geo.road_class_code(code).alias("code"))


def _with_unknown_roads(trav: DataFrame) -> DataFrame:
    """Traversals that in some steps name a road that no network has."""
    unknown = F.col("edge_id") + 10_000_000
    return trav.withColumn("edge_id", F.when(F.col("seq") % 7 == 3, unknown).otherwise(F.col("edge_id")))


@_query("in_road_class")
def in_road_class(k: Tables) -> DataFrame:
    edge = k.edge.select("edge_id", "road_class")
    joined = _with_unknown_roads(k.traversal).join(edge, "edge_id", "left")
    return joined.select("traj_id", "seq", geo.in_road_class(F.col("road_class")).alias("eligible"))


@_query("segment_point")
def segment_point(k: Tables) -> DataFrame:
    rows = network.geo_edge_lookup(_with_unknown_roads(k.traversal_2016), k.edge_geo)
    at = geo.segment_point(F.col("seq"), F.col("n"), F.col("start_pt"), F.col("end_pt"), F.col("edge_start"))
    return _shown(rows.select("traj_id", "seq", at["lon"].alias("lon"), at["lat"].alias("lat")))


@_query("congestion_label")
def congestion_label(k: Tables) -> DataFrame:
    return _shown(k.dense.select("w", "x", "y", labels.congestion_label(F.col("speed")).alias("label")))


@_query("speed_kmh")
def speed_kmh(k: Tables) -> DataFrame:
    return _shown(k.fresh_panel.select("w", "x", "y", labels.speed_kmh(F.col("speed")).alias("kmh")))


@_query("speed_color_bucket")
def speed_color_bucket(k: Tables) -> DataFrame:
    return _shown(k.dense.select("w", "x", "y", labels.speed_color_bucket(F.col("speed")).alias("bucket")))


@_query("cell_polygon")
def cell_polygon(k: Tables) -> DataFrame:
    p = geo.cell_polygon(F.col("x"), F.col("y"), GRID)
    corners = [p[k][f].alias(f"{f}{k}") for k in range(4) for f in ("lon", "lat")]
    return _shown(_vertex_cells(k).select("vertex_id", *corners))


@_query("calendar_features")
def calendar_features(k: Tables) -> DataFrame:
    return _shown(k.times.select("w", *calendar.calendar_features(F.col("w"))))


@_query("weather_flags")
def weather_flags(k: Tables) -> DataFrame:
    return _shown(k.weather.select("date", *calendar.weather_flags(F.col("weather"))))


def _wind_text():
    return (
        F.when(F.col("wind") == 0, "微风").when(F.col("wind") == 1, "无")
        .when(F.col("wind") == 2, F.concat(F.lit("小于"), F.col("wind").cast("string"), F.lit("级")))
        .otherwise(F.concat(F.lit("北风"), F.col("wind").cast("string"), F.lit("级")))
    )


@_query("wind_level")
def wind_level(k: Tables) -> DataFrame:
    return _shown(k.weather.select("date", calendar.wind_level(_wind_text()).alias("level")))


def _restored(df):
    same = F.abs(F.col("back") - F.col("speed")) < 1e-9
    return _shown(df.select("w", "x", "y", "scaled", same.alias("restored")))


@_query("minmax_scale")
def minmax_scale(k: Tables) -> DataFrame:
    p = k.panel
    params = scaling.minmax_fit(p, "speed")
    out = scaling.minmax_scale(p, "speed", params, out="scaled")
    return _restored(scaling.minmax_inverse(out, "scaled", params, out="back"))


@_query("minmax_scale_01")
def minmax_scale_01(k: Tables) -> DataFrame:
    p = k.panel
    params = scaling.minmax_fit(p, "speed")
    out = scaling.minmax_scale(p, "speed", params, 0.0, 1.0, out="scaled")
    return _restored(scaling.minmax_inverse(out, "scaled", params, 0.0, 1.0, out="back"))


@_query("round_half_even")
def round_half_even(k: Tables) -> DataFrame:
    half = F.col("length") / 200
    return k.edge.select("edge_id", labels.round_half_even(half).alias("rounded"))


@_query("time_shift")
def time_shift(k: Tables) -> DataFrame:
    w = F.col("w")
    return _shown(k.times.select("w", timing.time_shift(w, 2, MINUTES).alias("later"), timing.time_shift(w, -1, MINUTES).alias("earlier")))


@_query("display_time")
def display_time(k: Tables) -> DataFrame:
    return _shown(k.times.select("w", timing.display_time(F.col("w")).alias("shown")))


@_query("parse_time")
def parse_time(k: Tables) -> DataFrame:
    text = k.times.select(timing.format_time(F.col("w")).alias("text"))
    back = timing.parse_time(F.col("text"))
    return text.select("text", F.unix_seconds(back).alias("epoch"))


@_query("cell_count")
def cell_count(k: Tables) -> DataFrame:
    excluded = k.silent.agg(F.count(F.lit(1))).scalar()
    n = k.dense.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("samples"))
    count = labels.cell_count(F.col("samples"), 1, GRID.cells, excluded)
    return n.select("samples", count.alias("cells"), labels.sample_count(count, 1, GRID.cells, excluded).alias("back"))


# Joins.


@_query("edge_lookup")
def edge_lookup(k: Tables) -> DataFrame:
    return _shown(network.edge_lookup(k.traversal, k.edge, strict=True).select("traj_id", "seq", "edge_id", "length"))


@_query("edge_start_vertex")
def edge_start_vertex(k: Tables) -> DataFrame:
    rows = network.edge_start_vertex(k.traversal, k.edge, k.vertex, strict=True)
    return _shown(rows.select("traj_id", "seq", "length", "lon", "lat"))


@_query("geo_edge_lookup")
def geo_edge_lookup(k: Tables) -> DataFrame:
    rows = network.geo_edge_lookup(_with_unknown_roads(k.traversal_2016), k.edge_geo)
    return _shown(rows.select("traj_id", "seq", "edge_length", "road_class", F.col("edge_start.lon").alias("lon")))


@_query("subnet_semi")
def subnet_semi(k: Tables) -> DataFrame:
    return _shown(network.subnet_semi(k.traversal, k.subnet).select("traj_id", "seq", "edge_id", "length"))


@_query("exclude_no_signal")
def exclude_no_signal(k: Tables) -> DataFrame:
    return _shown(marks.exclude_no_signal(k.panel, k.silent))


@_query("mark_no_signal")
def mark_no_signal(k: Tables) -> DataFrame:
    return _shown(marks.mark_no_signal(k.panel, k.silent, "speed"))


@_query("lag_self_join")
def lag_self_join(k: Tables) -> DataFrame:
    return _shown(features.lag_join(k.dense, {"c1": 1, "c2": 2}, MINUTES, value="speed"))


@_query("holiday_semi")
def holiday_semi(k: Tables) -> DataFrame:
    days = k.source("events").select(F.col("ts").cast("date").alias("date")).distinct()
    return _shown(features.holiday_flag(days, k.holiday))


@_query("weather_prev_row")
def weather_prev_row(k: Tables) -> DataFrame:
    return _shown(features.weather_prev_row(k.weather))


@_query("times_in_set")
def times_in_set(k: Tables) -> DataFrame:
    after = evaluate.windows_after(evaluate.top_changes(k.change, 50), 2, MINUTES)
    return _shown(evaluate.times_in_set(k.panel, after))


def _diff_test(k: Tables) -> DataFrame:
    train, test = features.train_test_split_tail(k.features, LEN_TEST)
    return evaluate.diff_test_select(train, test, k.change, 20.0)


@_query("diff_test_select")
def diff_test_select(k: Tables) -> DataFrame:
    return _shown(_diff_test(k))


# Filters and selection.


@_query("min_section_length")
def min_section_length(k: Tables) -> DataFrame:
    return _shown(network.min_section_length(k.edge, 2500).select("edge_id", "length"))


@_query("drop_last_traversal")
def drop_last_traversal(k: Tables) -> DataFrame:
    timed = trajectories.travel_seconds(k.traversal)
    return trajectories.drop_last_traversal(timed).select("traj_id", "seq", "edge_id")


@_query("drop_first_last")
def drop_first_last(k: Tables) -> DataFrame:
    return trajectories.drop_first_last(k.traversal_2016).select("traj_id", "seq", "edge_id")


@_query("speed_range")
def speed_range(k: Tables) -> DataFrame:
    return _shown(runs.speed_range(k.runs).select("traj_id", "run_start", "speed"))


CHOSEN = ("20240110080000", "20240112093000")


@_query("choose_trajectories")
def choose_trajectories(k: Tables) -> DataFrame:
    start, end = [timing.parse_second(F.lit(v)) for v in CHOSEN]
    chosen = trajectories.choose_trajectories(k.trajectory, start, end)
    return _shown(trajectories.trajectory_sequence(chosen).select("traj_id", "seq", "edge_id", "t"))


@_query("choose_traversals")
def choose_traversals(k: Tables) -> DataFrame:
    start, end = [timing.parse_second(F.lit(v)) for v in CHOSEN]
    return _shown(trajectories.choose_traversals(k.traversal, start, end))


@_query("trajectory_size")
def trajectory_size(k: Tables) -> DataFrame:
    """Each trip ends at a step of its own and another one goes on from there, so sizes differ."""
    at = (F.col("traj_id") % 17 + 2).cast("int")
    parts = F.array(
        F.struct((F.col("traj_id") * 2).alias("traj_id"), F.slice("path", F.lit(1), at).alias("path")),
        F.struct((F.col("traj_id") * 2 + 1).alias("traj_id"), F.slice("path", at + 1, F.size("path")).alias("path")),
    )
    trips = k.trajectory.select(F.explode(parts).alias("trip")).select("trip.*")
    kept = trajectories.trajectory_size(trips, 5, 12)
    return kept.select("traj_id", F.size("path").alias("edges"))


@_query("min_road_num")
def min_road_num(k: Tables) -> DataFrame:
    return links.min_road_num(links.road_trip_count(k.link_stat()), 4)


@_query("panel_times")
def panel_times(k: Tables) -> DataFrame:
    return _shown(k.times)


@_query("panel_at")
def panel_at(k: Tables) -> DataFrame:
    p = k.panel
    busiest = p.groupBy("w").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("w", F.struct("n", "w"))).scalar()
    return _shown(panel.panel_at(p, busiest))


@_query("cell_series")
def cell_series(k: Tables) -> DataFrame:
    return _shown(panel.cell_series(k.panel, 1, 1))


@_query("train_test_split_tail")
def train_test_split_tail(k: Tables) -> DataFrame:
    train, test = features.train_test_split_tail(k.values, LEN_TEST)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), timing.format_time(F.min("w")).alias("first_w"))


# Aggregations.


@_query("link_travel_time")
def link_travel_time(k: Tables) -> DataFrame:
    return _shown(k.link_stat())


@_query("cell_travel_time")
def cell_travel_time(k: Tables) -> DataFrame:
    return _shown(links.cell_travel_time(k.link_stat(), k.edge, k.vertex, GRID))


@_query("cell_link_travel_time")
def cell_link_travel_time(k: Tables) -> DataFrame:
    return _shown(k.cell_link)


@_query("cell_links_nested")
def cell_links_nested(k: Tables) -> DataFrame:
    nested = links.cell_links_nested(k.cell_link)
    text = F.array_join(F.transform("links", lambda v: F.concat_ws(",", v["edge_id"], v["travel_time"], v["num"])), ";")
    return _shown(nested.select("w", "x", "y", text.alias("links")))


@_query("cell_edge_count")
def cell_edge_count(k: Tables) -> DataFrame:
    return links.cell_edge_count(k.cell_link)


@_query("cell_speed_from_links")
def cell_speed_from_links(k: Tables) -> DataFrame:
    return _shown(links.cell_speed_from_links(k.cell_link, k.edge, MINUTES))


@_query("cell_speed_from_runs")
def cell_speed_from_runs(k: Tables) -> DataFrame:
    return _shown(k.fresh_panel)


@_query("cell_condition")
def cell_condition(k: Tables) -> DataFrame:
    """Mean speed and congestion label per cell and window, from raw traversals."""
    return _shown(k.fresh_panel.withColumn("label", labels.congestion_label(F.col("speed"))))


@_query("cell_speed_from_runs_2016")
def cell_speed_from_runs_2016(k: Tables) -> DataFrame:
    return _shown(runs.cell_speed(k.runs_2016))


@_query("link_speed")
def link_speed(k: Tables) -> DataFrame:
    return _shown(k.link_speed)


@_query("link_speed_rollup")
def link_speed_rollup(k: Tables) -> DataFrame:
    smaller = k.subnet.filter(F.col("road_class") == "0x01")
    return _shown(links.link_speed_rollup(k.link_speed, smaller, MINUTES))


@_query("road_trip_count")
def road_trip_count(k: Tables) -> DataFrame:
    return links.road_trip_count(k.link_stat())


@_query("road_class_by_count")
def road_class_by_count(k: Tables) -> DataFrame:
    counts = links.road_trip_count(k.link_stat())
    return _shown(links.road_class_by_count(counts, k.edge, k.vertex, [2, 5, 10]))


@_query("no_signal_cells")
def no_signal_cells(k: Tables) -> DataFrame:
    p = k.panel
    times = panel.fill_windows(p, MINUTES, panel.incomplete_days(p, MINUTES))
    return panel.no_signal_cells(p, GRID, times=times)


@_query("panel_info")
def panel_info(k: Tables) -> DataFrame:
    return _shown(panel.panel_info(k.dense, k.silent, GRID))


@_query("integrity_check")
def integrity_check(k: Tables) -> DataFrame:
    return _shown(panel.integrity_check(k.panel, MINUTES))


@_query("label_count")
def label_count(k: Tables) -> DataFrame:
    return panel.label_count(panel.to_labels(k.dense))


@_query("rmse")
def rmse(k: Tables) -> DataFrame:
    return _shown(evaluate.rmse(k.pred, k.silent))


@_query("accuracy")
def accuracy(k: Tables) -> DataFrame:
    return _shown(evaluate.accuracy(k.pred, k.silent))


@_query("frame_change")
def frame_change(k: Tables) -> DataFrame:
    return _shown(k.change)


@_query("compare_after_change")
def compare_after_change(k: Tables) -> DataFrame:
    preds = {"mean": k.pred, "latest": k.pred_latest}
    return _shown(evaluate.compare_after_change(k.change, preds, k.silent, top=300, minutes=MINUTES))


@_query("compare_at_change")
def compare_at_change(k: Tables) -> DataFrame:
    """The windows of the changes themselves."""
    preds = {"mean": k.pred, "latest": k.pred_latest}
    return _shown(evaluate.compare_after_change(k.change, preds, k.silent, top=300, next_n=0, minutes=MINUTES))


@_query("mean_predictor")
def mean_predictor(k: Tables) -> DataFrame:
    return _shown(evaluate.mean_predictor(k.features, CPT).select("w", "x", "y", "predict"))


def _class_rows(k: Tables) -> DataFrame:
    """Labels of the panel with the weekday and the column of their cell."""
    lab = panel.to_labels(k.panel)
    return lab.select("label", "x", F.weekday("w").alias("weekday"))


@_query("entropy")
def entropy(k: Tables) -> DataFrame:
    return _shown(information.entropy(_class_rows(k), "label"))


@_query("information_gain")
def information_gain(k: Tables) -> DataFrame:
    return _shown(information.information_gain(_class_rows(k), "x", "label"))


@_query("majority_label")
def majority_label(k: Tables) -> DataFrame:
    return _shown(information.majority_label(_class_rows(k), ["x", "weekday"], "label"))


@_query("weather_minmax")
def weather_minmax(k: Tables) -> DataFrame:
    return _shown(features.weather_minmax(k.weather).select("date", *features.WEATHER_SCALED))


# Ordered operators.


@_query("cell_runs")
def cell_runs(k: Tables) -> DataFrame:
    return _shown(k.runs)


@_query("cell_runs_2016")
def cell_runs_2016(k: Tables) -> DataFrame:
    return _shown(k.runs_2016)


@_query("travel_seconds")
def travel_seconds(k: Tables) -> DataFrame:
    return trajectories.travel_seconds(k.traversal).select("traj_id", "seq", "seconds")


@_query("interpolate_gaps")
def interpolate_gaps(k: Tables) -> DataFrame:
    return _shown(gaps.interpolate_gaps(k.dense, k.silent))


@_query("interpolate_gaps_compat")
def interpolate_gaps_compat(k: Tables) -> DataFrame:
    return _shown(gaps.interpolate_gaps(k.dense, k.silent, compat=True))


@_query("fill_low_weight")
def fill_low_weight(k: Tables) -> DataFrame:
    return _shown(gaps.fill_low_weight(k.dense, k.silent, threshold=2))


@_query("neighbour_max_fill")
def neighbour_max_fill(k: Tables) -> DataFrame:
    return _shown(gaps.neighbour_max_fill(k.dense, k.silent))


@_query("trajectory_sequence")
def trajectory_sequence(k: Tables) -> DataFrame:
    return trajectories.trajectory_sequence(k.trajectory).select("traj_id", "seq", "edge_id", "is_last")


@_query("sliding_sequences")
def sliding_sequences(k: Tables) -> DataFrame:
    seq = features.sliding_sequences(k.dense, ["x", "y"], ["speed"], 3)
    return _shown(seq.select("w", "x", "y", *[F.col("speed_seq")[k].alias(f"s{k}") for k in range(3)]))


# Panel completion.


@_query("incomplete_days")
def incomplete_days(k: Tables) -> DataFrame:
    return _shown(panel.incomplete_days(k.panel, MINUTES, 0.86))


@_query("fill_windows")
def fill_windows(k: Tables) -> DataFrame:
    p = k.panel
    return _shown(panel.fill_windows(p, MINUTES, panel.incomplete_days(p, MINUTES, 0.86)))


@_query("drop_flagged_days")
def drop_flagged_days(k: Tables) -> DataFrame:
    p = k.panel
    return _shown(panel.drop_flagged_days(p, panel.incomplete_days(p, MINUTES, 0.86)))


@_query("densify")
def densify(k: Tables) -> DataFrame:
    return _shown(k.dense)


@_query("complete_panel")
def complete_panel(k: Tables) -> DataFrame:
    return _shown(k.complete)


@_query("complete_days_only")
def complete_days_only(k: Tables) -> DataFrame:
    return _shown(k.whole_days)


@_query("complete_days_only_compat")
def complete_days_only_compat(k: Tables) -> DataFrame:
    return _shown(panel.complete_days_only(k.panel, MINUTES, compat=True))


@_query("preprocess_panel")
def preprocess_panel(k: Tables) -> DataFrame:
    return _shown(panel.preprocess_panel(k.panel, GRID, MINUTES))


@_query("preprocess_panel_low_weight")
def preprocess_panel_low_weight(k: Tables) -> DataFrame:
    return _shown(panel.preprocess_panel(k.panel, GRID, MINUTES, "low_weight"))


# Features, samples, models.


@_query("cpt_features")
def cpt_features(k: Tables) -> DataFrame:
    return _shown(k.features)


@_query("external_features")
def external_features(k: Tables) -> DataFrame:
    return _shown(features.external_features(panel.panel_times(k.values), k.holiday, k.weather))


@_query("cell_samples")
def cell_samples(k: Tables) -> DataFrame:
    f = k.features
    ext = features.external_features(panel.panel_times(f), k.holiday, k.weather)
    return _shown(features.cell_samples(f, ext, k.silent))


@_query("cells_to_frame")
def cells_to_frame(k: Tables) -> DataFrame:
    kept = marks.exclude_no_signal(k.pred, k.silent)
    return _shown(features.cells_to_frame(kept, GRID, default=-1.0))


def _dataset(k: Tables, scaled=True):
    return features.load_dataset(
        [k.clean.drop("label")], GRID, MINUTES, k.silent, LEN_TEST,
        holiday=k.holiday, weather=k.weather, scaled=scaled, calendar=True,
    )


def _both(ds: features.Dataset) -> DataFrame:
    return ds.train.withColumn("part", F.lit("train")).unionByName(ds.test.withColumn("part", F.lit("test")))


@_query("load_dataset")
def load_dataset(k: Tables) -> DataFrame:
    return _shown(_both(_dataset(k)).drop("source_id"))


@_query("load_dataset_flows")
def load_dataset_flows(k: Tables) -> DataFrame:
    """Speed and number of runs as two flows, scaled each by its own limits."""
    ds = features.load_dataset([k.clean.drop("label")], GRID, MINUTES, k.silent, LEN_TEST, scaled=True, flows=("speed", "num"))
    return _shown(_both(ds).drop("source_id"))


@_query("change_ranking_store")
def change_ranking_store(k: Tables) -> DataFrame:
    """Changes stored in order, the first 300 read back, and the models compared after them."""
    path = stage_path(k.spark, "changes")
    stat_files.save_changes(k.change, path)
    top = stat_files.load_top_changes(k.spark, path, 300)
    preds = {"mean": k.pred, "latest": k.pred_latest}
    return _shown(evaluate.compare_after_change(top, preds, k.silent, top=300, minutes=MINUTES))


@_query("multi_file_union")
def multi_file_union(k: Tables) -> DataFrame:
    """Two halves of the month as two sources; lags stay within each."""
    p = k.panel
    middle = F.to_timestamp(F.lit("20240116"), "yyyyMMdd")
    halves = panel.panel_union([p.filter(F.col("w") < middle), p.filter(F.col("w") >= middle)])
    dense = panel.densify(halves, GRID, by=["source_id"])
    return _shown(features.lag_join(dense, {"c1": 1, "c2": 2}, MINUTES, by=["source_id"], value="speed"))


@_query("test_on_change")
def test_on_change(k: Tables) -> DataFrame:
    ds = _dataset(k, scaled=False)
    chosen = evaluate.diff_test_select(ds.train, ds.test, k.change, 20.0)
    return _shown(chosen.drop("source_id"))


def _tree_rows(k: Tables) -> tuple[DataFrame, DataFrame]:
    return features.train_test_split_tail(k.tree_samples, LEN_TEST)


def _level_tree(k: Tables, train: DataFrame) -> DataFrame:
    return trees.level_tree_fit(train, CPT[:3], CPT[3:4], CPT[4:], TREE_EXTERNALS, label="value")


@_query("level_tree_fit")
def level_tree_fit(k: Tables) -> DataFrame:
    train, _ = _tree_rows(k)
    return _shown(_level_tree(k, train).drop("id", "parent_id"))


@_query("level_tree_predict")
def level_tree_predict(k: Tables) -> DataFrame:
    train, test = _tree_rows(k)
    nodes = _level_tree(k, train)
    return _shown(trees.level_tree_predict(test, nodes, [*CPT, *TREE_EXTERNALS]).select("w", "x", "y", "value", "predict"))


TREE_FEATURES = [*CPT, *TREE_EXTERNALS]
LABELS = [0.0, 1.0, 2.0, 3.0, 4.0]
FOREST = 20
GRID_CHOICES = (["gini", "entropy"], [None, 5, 10, 15], [2, 4, 6], [1, 2, 3], 3)
#: Width of the bins of speeds, metres a second.
SPEED_BIN = 1.0


def _predicted(test: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = histogram_trees.predict(test, nodes, TREE_FEATURES)
    return _shown(rows.select("w", "x", "y", "predict", F.col("value").alias("real")))


@_query("dt_classifier")
def dt_classifier(k: Tables) -> DataFrame:
    train, test = _tree_rows(k)
    tree = histogram_trees.Tree("gini", 10, min_split=4, min_leaf=1)
    return _predicted(test, histogram_trees.fit_tree(train, TREE_FEATURES, "value", tree, LABELS))


def _speed_rows(k: Tables) -> tuple[DataFrame, DataFrame]:
    """Samples of speeds: lags in bins, the target also in whole millimetres a second."""
    rows = k.with_externals(k.features)
    rows = rows.withColumns({c: histogram_trees.binned(F.col(c), SPEED_BIN) for c in CPT})
    rows = stage(rows.withColumn("target", F.round(F.col("value") * 1000).cast("long")), "samples")
    return features.train_test_split_tail(rows, LEN_TEST)


@_query("dt_regressor")
def dt_regressor(k: Tables) -> DataFrame:
    train, test = _speed_rows(k)
    tree = histogram_trees.Tree("squared", 10, min_split=4, min_leaf=1)
    nodes = histogram_trees.fit_tree(train, TREE_FEATURES, "target", tree)
    return _predicted(test, nodes.withColumn("predict", F.col("predict") / 1000))


def _row_name() -> Column:
    """A sample's own text."""
    return F.concat_ws("/", timing.format_time(F.col("w")), F.col("x").cast("string"), F.col("y").cast("string"))


@_query("rf_classifier")
def rf_classifier(k: Tables) -> DataFrame:
    train, test = _tree_rows(k)
    tree = histogram_trees.Tree("entropy", 10, min_split=2, min_leaf=2)
    return _predicted(test, histogram_trees.fit_forest(train, TREE_FEATURES, "value", _row_name(), FOREST, tree, LABELS))


@_query("grid_search")
def grid_search(k: Tables) -> DataFrame:
    """Accuracy of each parameter choice over blocks of time."""
    train, _ = _tree_rows(k)
    criteria, depths, splits, leaves, folds = GRID_CHOICES
    found = histogram_trees.grid_search(train, TREE_FEATURES, "value", criteria, depths, splits, leaves, folds, LABELS)
    return _shown(found.withColumnRenamed("score", "accuracy"))


@_query("model_report")
def model_report(k: Tables) -> DataFrame:
    """Mean of the scaled lags, brought back and scored."""
    ds = _dataset(k)
    pred = evaluate.mean_predictor(ds.test, CPT).withColumn("real", F.col("value"))
    return _shown(models.model_report(pred, ds.scale))


@_query("model_report_labels")
def model_report_labels(k: Tables) -> DataFrame:
    """Mean of the lags, rounded to labels and scored by accuracy."""
    pred = evaluate.mean_predictor(k.features, CPT).withColumn("real", F.col("value"))
    return _shown(models.model_report(pred, no_signal=k.silent, labels=True))


@_query("trips_to_score")
def trips_to_score(k: Tables) -> DataFrame:
    """Trips to the cleaned panel, scaled samples, predictions, frames and their scores in km/h and labels."""
    clean = panel.preprocess_panel(k.panel, GRID, MINUTES)
    values = stage(clean.select("w", "x", "y", F.col("speed").alias("value")), "clean")
    fitted, _ = features.train_test_split_tail(values, LEN_TEST)
    scale = scaling.minmax_fit(fitted, "value")
    samples = stage(features.cpt_features(scaling.minmax_scale(values, "value", scale), MINUTES), "features")
    _, test = features.train_test_split_tail(features.cell_samples(samples, None, k.silent), LEN_TEST)
    frame = features.cells_to_frame(evaluate.mean_predictor(test, CPT), GRID, default=-1.0)
    met = frame.join(test.select("w", "x", "y", F.col("value").alias("real")), ["w", "x", "y"])
    speeds = scaling.minmax_inverse(scaling.minmax_inverse(met, "predict", scale), "real", scale)
    named = [labels.congestion_label(F.round(c, 6)).cast("double").alias(c) for c in ("predict", "real")]
    share = evaluate.accuracy(speeds.select(*named)).select(F.col("accuracy").alias("label_accuracy")).scalar()
    return _shown(evaluate.rmse(speeds).withColumn("label_accuracy", share))


@_query("trips_to_score_tree")
def trips_to_score_tree(k: Tables) -> DataFrame:
    """Trips to the cleaned panel, samples with externals, a fitted tree, frames and their scores in metres a second and labels."""
    train, test = _speed_rows(k)
    tree = histogram_trees.Tree("squared", 10, min_split=4, min_leaf=1)
    nodes = histogram_trees.fit_tree(train, TREE_FEATURES, "target", tree).withColumn("predict", F.col("predict") / 1000)
    pred = histogram_trees.predict(test, nodes, TREE_FEATURES)
    frame = features.cells_to_frame(pred, GRID, default=-1.0)
    met = frame.join(test.select("w", "x", "y", F.col("value").alias("real")), ["w", "x", "y"])
    named = [labels.congestion_label(F.round(c, 6)).cast("double").alias(c) for c in ("predict", "real")]
    share = evaluate.accuracy(met.select(*named)).select(F.col("accuracy").alias("label_accuracy")).scalar()
    return _shown(evaluate.rmse(met).withColumn("label_accuracy", share))


@_query("sweep_report")
def sweep_report(k: Tables) -> DataFrame:
    methods = {"mean": models.mean_method}
    return _shown(models.sweep_report(k.values, MINUTES, [1, 2, 3], methods, LEN_TEST, no_signal=k.silent))


@_query("sweep_report_tree")
def sweep_report_tree(k: Tables) -> DataFrame:
    methods = {"mean": models.mean_method, "tree": models.tree_method}
    return _shown(models.sweep_report(k.values, MINUTES, [1, 2], methods, LEN_TEST, kind="period"))


@_query("weather_pages")
def weather_pages(k: Tables) -> DataFrame:
    """Monthly pages made of the weather rows, at most 31 days each, read back."""
    w = k.weather
    item = F.concat(
        F.lit('<ul><li><a href="#">'), F.date_format("date", "yyyy-MM-dd"), F.lit("</a></li>"),
        *[F.concat(F.lit("<li>"), c, F.lit("</li>")) for c in (
            F.col("max_t").cast("string"), F.col("min_t").cast("string"), F.col("weather"), F.lit("北风"), _wind_text(),
        )],
        F.lit("</ul>"),
    )
    months = w.groupBy(F.date_format("date", "yyyyMM").alias("url")).agg(F.collect_list(item).alias("items"))
    pages = months.select("url", F.concat(
        F.lit('<html><div class="tqtongji2"><ul class="t1"><li>day</li></ul>'), F.array_join("items", ""), F.lit("</div></html>"),
    ).alias("html"))
    read = weather_files.weather_pages(pages)
    return _shown(read.select("date", "max_t", "min_t", *calendar.weather_flags(F.col("weather")), calendar.wind_level(F.col("wind")).alias("wind")))


@_query("trajectory_polyline")
def trajectory_polyline(k: Tables) -> DataFrame:
    starts = network.edge_starts(k.edge, k.vertex)
    lines = trajectories.trajectory_polyline(k.traversal, starts)
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(
        " ", timing.format_second(p["t"]), F.round(p["lon"] * 1000).cast("bigint").cast("string"), F.round(p["lat"] * 1000).cast("bigint").cast("string"),
    )), ";")
    return lines.select("traj_id", "part", text.alias("line"))


def queries() -> dict[str, Query]:
    return dict(_registry)
