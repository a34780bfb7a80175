"""Runs, trips and link statistics against plain loops, for any chunk length."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.geo import point
from roadpulse.operators import links, network, runs, trajectories
from roadpulse.spec import GridSpec

GRID = GridSpec(0.0, 0.0, 4.0, 1.0, 4, 1)
START = datetime(2024, 1, 1)
CHUNKS = [1, 2, 3, 7, 65536]


def random_trips(seed: int, trips: int = 25, longest: int = 40):
    """Trips that dwell on places, sometimes stand still and sometimes step back in time."""
    rng = random.Random(seed)
    rows = []
    for trip in range(trips):
        t, edge = START + timedelta(minutes=rng.randrange(600)), rng.randrange(12)
        for seq in range(rng.randrange(1, longest)):
            rows.append((trip, seq, edge, t))
            if rng.random() < 0.4:
                edge = rng.randrange(12)
            t += timedelta(seconds=rng.choice([0, 5, 30, 200, -60, 1300]))
    return rows


def network_rows():
    """Edges 0 to 11; vertices run from 0.25 to beyond the box."""
    edges = [(e, e, (e + 1) % 12, float(100 + 10 * e), [0, 8, 3][e % 3]) for e in range(12)]
    vertices = [(v, 0.25 + v * 0.45, 0.5) for v in range(12)]
    return edges, vertices


def cell(v: int) -> int | None:
    lon = 0.25 + v * 0.45
    return min(int(lon), 3) if lon <= 4.0 else None


def window(t: datetime) -> datetime:
    m = (t.hour * 60 + t.minute) // 20 * 20
    return t.replace(hour=m // 60, minute=m % 60, second=0)


@pytest.fixture(scope="module")
def frames(spark):
    edges, vertices = network_rows()
    edge = spark.createDataFrame(edges, "edge_id long, s_id long, e_id long, length double, road_class int")
    vertex = spark.createDataFrame(vertices, "vertex_id long, lon double, lat double")
    rows = random_trips(7)
    trav = spark.createDataFrame(rows, "traj_id long, seq long, edge_id long, t timestamp").repartition(5)
    return rows, trav.cache(), edge, vertex


def plain_runs(rows, eligible=lambda e: True, drop_last=True):
    """Walk each trip once, opening a run whenever place or window changes."""
    trips = defaultdict(list)
    for trip, seq, edge, t in sorted(rows, key=lambda r: (r[0], r[1])):
        trips[trip].append((seq, edge, t))
    found = []
    for trip, steps in trips.items():
        current = None
        for (seq, edge, t), (_, _, end) in zip(steps, steps[1:]):
            place = (cell(edge), window(t)) if cell(edge) is not None and eligible(edge) else None
            if place is None or current is None or place != current["place"]:
                current = {"trip": trip, "start": seq, "place": place, "length": 0.0, "seconds": 0, "n": 0}
                if place is not None:
                    found.append(current)
            if place is None:
                current = None
                continue
            current["length"] += 100.0 + 10 * edge
            current["seconds"] += int((end - t).total_seconds())
            current["n"] += 1
    return sorted(
        (r["trip"], r["start"], r["place"][0], r["place"][1], r["n"], r["length"], r["seconds"])
        for r in found
        if r["seconds"] != 0
    )


@pytest.mark.parametrize("chunk", CHUNKS)
def test_cell_runs_match_a_plain_walk(frames, chunk):
    rows, trav, edge, vertex = frames
    got = runs.cell_runs(trav, edge, vertex, GRID, 20, chunk)
    plain = sorted(
        (r["traj_id"], r["run_start"], r["x"], r["w"], r["edges"], r["length"], r["seconds"]) for r in got.collect()
    )
    assert plain == plain_runs(rows)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_travel_seconds_for_any_chunk(frames, chunk):
    rows, trav, _, _ = frames
    got = {(r["traj_id"], r["seq"]): r["seconds"] for r in trajectories.travel_seconds(trav, chunk).collect()}
    times = {(trip, seq): t for trip, seq, _, t in rows}
    want = {
        k: int((times[k[0], k[1] + 1] - t).total_seconds()) if (k[0], k[1] + 1) in times else None
        for k, t in times.items()
    }
    assert got == want


def test_one_endless_run_crosses_many_chunks(spark):
    edge = spark.createDataFrame([(0, 0, 0, 10.0, 0)], "edge_id long, s_id long, e_id long, length double, road_class int")
    vertex = spark.createDataFrame([(0, 0.5, 0.5)], "vertex_id long, lon double, lat double")
    trav = spark.range(1001).select(
        F.lit(1).cast("long").alias("traj_id"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("edge_id"),
        F.timestamp_seconds(F.col("id") + 1704067200).alias("t"),
    )
    got = runs.cell_runs(trav, edge, vertex, GRID, 20, chunk=8).collect()
    assert [(r["run_start"], r["edges"], r["length"], r["seconds"]) for r in got] == [(0, 1000, 10000.0, 1000)]


def trips_2016(spark, rows):
    """The last step of each legacy trip becomes its end time."""
    trips = defaultdict(list)
    for trip, seq, edge, t in rows:
        trips[trip].append((seq, edge, t))
    out = []
    for trip, steps in trips.items():
        steps.sort()
        if len(steps) < 2:
            continue
        edges = [e for _, e, _ in steps[:-1]]
        times = [int((t - datetime(1970, 1, 1)).total_seconds()) - 8 * 3600 for _, _, t in steps]
        out.append((trip, edges, times, (3.5, 0.5), (0.1, 0.5), 7, 9))
    point_type = "struct<lon:double,lat:double>"
    return spark.createDataFrame(
        out,
        f"traj_id long, edges array<long>, times array<long>, start_pt {point_type}, end_pt {point_type}, "
        "first_len int, last_len int",
    )


@pytest.mark.parametrize("chunk", [1, 3, 65536])
def test_cell_runs_2016_match_a_plain_walk(spark, frames, chunk):
    rows, _, edge, vertex = frames
    geo = network.edge_points(edge, vertex).select(
        "edge_id", point(F.col("start_lon"), F.col("start_lat")).alias("start"),
        point(F.col("end_lon"), F.col("end_lat")).alias("end"), F.col("length").cast("int").alias("length"), "road_class",
    ).filter("edge_id <> 4")
    trips = trips_2016(spark, rows)
    got = runs.cell_runs_2016(trajectories.traversals_2016(trips), geo, GRID, 20, low=0.0, high=1e9, chunk=chunk)
    plain = sorted((r["traj_id"], r["run_start"], r["x"], r["w"], r["edges"], r["length"], r["seconds"]) for r in got.collect())

    want = []
    for trip in trips.collect():
        n, current = len(trip["edges"]), None
        for i, e in enumerate(trip["edges"]):
            t = datetime(1970, 1, 1) + timedelta(seconds=trip["times"][i] + 8 * 3600)
            x = 3 if i == 0 else 0 if i == n - 1 else (cell(e) if e != 4 else None)
            known = e != 4 and [0, 8, 3][e % 3] in (0, 3)
            if x is None or not known:
                current = None
                continue
            if current is None or current[2:4] != [x, window(t)]:
                current = [trip["traj_id"], i, x, window(t), 0, 0.0, 0]
                want.append(current)
            current[4] += 1
            current[5] += 7 if i == 0 else 9 if i == n - 1 else 100 + 10 * e
            current[6] += trip["times"][i + 1] - trip["times"][i]
    assert plain == sorted(tuple(r) for r in want if r[6] != 0 and r[5] / r[6] >= 0)


def test_an_ineligible_edge_splits_a_run(spark):
    edge = [(0, 0), (1, 8), (2, 0)]
    geo = spark.createDataFrame(
        [(e, (0.5, 0.5), (0.6, 0.5), 100, c) for e, c in edge],
        "edge_id long, start struct<lon:double,lat:double>, end struct<lon:double,lat:double>, length int, road_class int",
    )
    trip = spark.createDataFrame(
        [(1, [0, 1, 2], [0, 10, 20, 30], (0.5, 0.5), (0.5, 0.5), 50, 60)],
        "traj_id long, edges array<long>, times array<long>, start_pt struct<lon:double,lat:double>, "
        "end_pt struct<lon:double,lat:double>, first_len int, last_len int",
    )
    got = runs.cell_runs_2016(trajectories.traversals_2016(trip), geo, GRID, 20).orderBy("run_start").collect()
    assert [(r["run_start"], r["length"], r["seconds"]) for r in got] == [(0, 50.0, 10), (2, 60.0, 10)]


def test_link_speed_weights_every_traversal_alike(spark):
    """Counting equal durations first gives the same mean as single traversals."""
    rows = [(k, 1, 3, 5, datetime(2024, 1, 1, 8, 1), s) for k, s in enumerate([10, 10, 20, 25, 0, 10000])]
    trav = spark.createDataFrame(rows, "traj_id long, seq long, n long, edge_id long, t timestamp, seconds long")
    subnet = spark.createDataFrame([(5, 100)], "edge_id long, length int")
    row = links.link_speed(trav, subnet, 5).first()
    assert row["num"] == 4
    assert row["speed"] == pytest.approx((10 + 10 + 5 + 4) / 4)


def test_link_speed_rollup_is_weighted(spark):
    w = datetime(2024, 1, 1, 8)
    fine = spark.createDataFrame(
        [(5, w, 4.0, 1), (5, w + timedelta(minutes=5), 8.0, 3), (6, w, 1.0, 1)], "edge_id long, w timestamp, speed double, num long"
    )
    subnet = spark.createDataFrame([(5,)], "edge_id long")
    assert [tuple(r) for r in links.link_speed_rollup(fine, subnet, 20).collect()] == [(5, w, 7.0, 4)]


def test_rollup_of_fine_windows_equals_the_coarse_one(spark, frames):
    rows, _, _, _ = frames
    trav = trajectories.traversals_2016(trips_2016(spark, rows))
    subnet = spark.createDataFrame([(e, 100 + 10 * e) for e in range(12)], "edge_id long, length int")
    coarse = links.link_speed(trav, subnet, 20)
    rolled = links.link_speed_rollup(links.link_speed(trav, subnet, 5), subnet, 20)
    both = coarse.join(rolled.withColumnsRenamed({"speed": "s", "num": "n"}), ["edge_id", "w"], "full")
    assert both.count() == coarse.count() > 0
    assert both.filter(~((F.abs(F.col("speed") - F.col("s")) < 1e-9) & (F.col("num") == F.col("n")))).count() == 0


def test_runs_hold_every_length_inside_the_box(frames):
    rows, trav, edge, vertex = frames
    got = runs.cell_runs(trav, edge, vertex, GRID, 20).agg(F.sum("length"), F.sum("edges")).first()
    walked = plain_runs(rows)
    assert tuple(got) == (sum(r[5] for r in walked), sum(r[4] for r in walked))


def test_links_without_time_count_in_the_mean(spark):
    w = datetime(2024, 1, 1)
    link = spark.createDataFrame([(w, 0, 0, 1, 0, 2), (w, 0, 0, 2, 20, 2)], "w timestamp, x int, y int, edge_id long, travel_time long, num long")
    edge = spark.createDataFrame([(1, 100.0), (2, 100.0)], "edge_id long, length double")
    assert links.cell_speed_from_links(link, edge, 20).first()["speed"] == 5.0


def test_strict_lookup_fails_on_an_unknown_edge(spark):
    trav = spark.createDataFrame([(1, 0, 99)], "traj_id long, seq long, edge_id long")
    edge = spark.createDataFrame([(1, 1.0)], "edge_id long, length double")
    assert network.edge_lookup(trav, edge).count() == 0
    with pytest.raises(Exception, match="no edge 99"):
        network.edge_lookup(trav, edge, strict=True).collect()


@pytest.mark.parametrize("part", [2, 5, 4096])
def test_polyline_parts_hold_all_points(frames, part):
    rows, trav, edge, vertex = frames
    lines = trajectories.trajectory_polyline(trav, network.edge_starts(edge, vertex), part).collect()
    assert max(len(r["points"]) for r in lines) <= part
    seen = sorted((r["traj_id"], p["seq"]) for r in lines for p in r["points"])
    assert seen == sorted((trip, seq) for trip, seq, _, _ in rows)


def test_no_large_group_is_shuffled_by_trip_alone(frames):
    """Every shuffle of steps is by (trip, chunk)."""
    _, trav, edge, vertex = frames
    plan = runs.cell_runs(trav, edge, vertex, GRID, 20)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(traj_id" in line]
    assert len(shuffles) == 2
    assert all("_chunk" in line or "_group" in line for line in shuffles)
