"""SQL of each query for DuckDB, over the given tables.

Each query names the common table expressions it builds on; they are put in front of it in
order. The SQL is written from the operators' definitions, not from their Spark form.
"""

from __future__ import annotations

import re

from roadpulse.plans import oracle_trees
from roadpulse.plans.queries import CHOSEN, FOREST, GRID_CHOICES, LABELS, LEN_TEST, SPEED_BIN
from roadpulse.plans.tables import FINE, GRID, MIN_LENGTH, MINUTES, TREE_EXTERNALS
from roadpulse.spec import ROAD_CLASS_CODES, windows_per_day

DAY = windows_per_day(MINUTES)


def _d(value: float) -> str:
    """A double literal."""
    return f"cast('{value!r}' as double)"


def _floor(t: str, minutes: int) -> str:
    m = f"(hour({t}) * 60 + minute({t}))"
    return f"(date_trunc('day', {t}) + to_minutes(cast({m} // {minutes} * {minutes} as bigint)))"


def _fmt(w: str) -> str:
    return f"strftime({w}, '%Y%m%d%H%M')"


def _sec(t: str) -> str:
    return f"strftime({t}, '%Y%m%d%H%M%S')"


def _inside(lon: str, lat: str) -> str:
    return f"({lon} between {_d(GRID.lon0)} and {_d(GRID.lon1)} and {lat} between {_d(GRID.lat0)} and {_d(GRID.lat1)})"


def _x(lon: str, lat: str) -> str:
    cell = f"least(cast(floor(({lon} - {_d(GRID.lon0)}) / {_d(GRID.lon_step)}) as integer), {GRID.nx - 1})"
    return f"(case when {_inside(lon, lat)} then {cell} else -1 end)"


def _y(lon: str, lat: str) -> str:
    cell = f"least(cast(floor(({lat} - {_d(GRID.lat0)}) / {_d(GRID.lat_step)}) as integer), {GRID.ny - 1})"
    return f"(case when {_inside(lon, lat)} then {cell} else -1 end)"


def _label(v: str) -> str:
    kmh = f"cast({v} * {_d(3.6)} as float)"
    return (
        f"cast(case when {kmh} = 0 then 0 when {kmh} > 0 and {kmh} <= 15 then 1 when {kmh} > 15 and {kmh} <= 30 then 2 "
        f"when {kmh} > 30 and {kmh} <= 45 then 3 when {kmh} > 45 then 4 end as integer)"
    )


def _flags(text: str, missing: str = "false") -> str:
    def has(word: str) -> str:
        return f"contains({text}, '{word}')"

    rain = has("雨")
    named = {
        "clear": has("晴"),
        "cloudy": has("多云"),
        "overcast": has("阴"),
        "rain_small": f"{rain} and {has('小')}",
        "rain_medium": f"{rain} and {has('中')}",
        "rain_large": f"{rain} and {has('大')}",
        "rain_shower": f"{rain} and {has('阵')}",
        "rain_storm": f"{rain} and {has('暴')}",
        "snow": has("雪"),
        "haze": has("霾"),
    }
    return ", ".join(f"cast(coalesce({test}, {missing}) as integer) as {name}" for name, test in named.items())


def _calendar(w: str) -> str:
    flags = [f"cast(isodow({w}) = {k + 1} as integer) as weekday_{k}" for k in range(7)]
    return ", ".join([*flags, f"cast(isodow({w}) < 6 as integer) as is_weekday"])


def _unit(col: str) -> str:
    return (
        f"coalesce(case when max({col}) over () = min({col}) over () then 0.0::double else "
        f"cast({col} - min({col}) over () as double) / (max({col}) over () - min({col}) over ()) end, 0.0::double)"
    )


def _shift(w: str, n: int | str) -> str:
    return f"({w} + to_minutes(cast({n} * {MINUTES} as bigint)))"


def _lagged(source: str, keys: str, value: str, lags: dict[str, int]) -> str:
    joins, columns = [], []
    for name, n in lags.items():
        # One key per lag: equal columns of two lags would invite a join between them.
        a, own = (", ".join(f"{t}.{k}" for k in keys.split(", ")) for t in ("a", name))
        joins.append(f"join {source} {name} on row({own}, {name}.w) = row({a}, {_shift('a.w', -n)})")
        columns.append(f"{name}.{value} as {name}")
    return f"select a.*, {', '.join(columns)} from {source} a {' '.join(joins)}"


CPT_LAGS = {"c1": 1, "c2": 2, "c3": 3, "p1": DAY, "t1": 7 * DAY}
CPT = ", ".join(CPT_LAGS)
MEAN = "(" + " + ".join(CPT_LAGS) + f") / {len(CPT_LAGS)}"

ROAD_CLASS_SQL = (
    "case p_type when 'STANDARD' then 0 when 'SMALL' then 1 when 'LARGE' then 2 when 'ECONOMY' then 3 "
    "when 'MEDIUM' then 6 else 8 end"
)

CTES: dict[str, str] = {
    "road_edge": f"""
        select p_partkey as edge_id, p_partkey as s_id, (p_partkey + 1) % (select count(*) from part) as e_id,
               cast(p_size * 100 as double) as length, {ROAD_CLASS_SQL} as road_class
        from part""",
    "road_vertex": f"""
        select p_partkey as vertex_id, {_d(116.25)} + {_d(0.006)} * (p_partkey % 41) as lon,
               {_d(39.82)} + {_d(0.005)} * ((p_partkey // 41) % 37) as lat
        from part""",
    "traversal": """
        select event_id // 20 as traj_id, event_id % 20 as seq,
               (event_id // 20 * 13 + event_id % 20) % (select count(*) from part) as edge_id,
               date_trunc('second', ts) as t
        from events""",
    "weather": """
        select d as date, cast(5 + (dayofyear(d) * 7 % 11) as bigint) as max_t,
               cast(5 + (dayofyear(d) * 7 % 11) - 8 - (dayofyear(d) % 3) as bigint) as min_t,
               cast(dayofyear(d) % 5 as bigint) as wind,
               case dayofyear(d) % 6 when 0 then '晴' when 1 then '多云' when 2 then '阴' when 3 then '小雨'
                    when 4 then '大雨转阵雨' else '霾' end as weather
        from (select distinct cast(ts as date) as d from events)""",
    "holiday": "select distinct cast(ts as date) as date from events where day(cast(ts as date)) % 7 = 3",
    "days": "select distinct cast(ts as date) as date from events",
    "starts": "select edge_id, length, lon, lat from road_edge join road_vertex on s_id = vertex_id",
    "cells": f"select edge_id, length, {_x('lon', 'lat')} as x, {_y('lon', 'lat')} as y from starts",
    "geo": """
        select e.edge_id, a.lon as start_lon, a.lat as start_lat, z.lon as end_lon, z.lat as end_lat,
               cast(e.length as integer) as length, e.road_class
        from road_edge e join road_vertex a on e.s_id = a.vertex_id join road_vertex z on e.e_id = z.vertex_id""",
    "subnet": "select *, '0x0' || road_class as code from road_edge where road_class <= 3",
    "timed": """
        select *, lead(t) over (partition by traj_id order by seq) as next_t,
               max(seq) over (partition by traj_id) + 1 as n
        from traversal""",
    "driven": "select *, epoch(next_t)::bigint - epoch(t)::bigint as seconds from timed where next_t is not null",
    "link_stat": f"""
        select edge_id, {_floor('t', FINE)} as w, sum(seconds)::bigint as travel_time, count(*) as num
        from driven join road_edge using (edge_id) where length >= {_d(MIN_LENGTH)} group by 1, 2""",
    "link_stat20": f"""
        select edge_id, {_floor('t', MINUTES)} as w, sum(seconds)::bigint as travel_time, count(*) as num
        from driven join road_edge using (edge_id) where length >= {_d(MIN_LENGTH)} group by 1, 2""",
    "cell_link": """
        select w, x, y, edge_id, sum(travel_time)::bigint as travel_time, sum(num)::bigint as num
        from link_stat join cells using (edge_id) where x >= 0 group by 1, 2, 3, 4""",
    "road_count": "select edge_id, sum(num)::bigint as num from link_stat group by 1",
    "placed": f"""
        select traj_id, seq, length, seconds, x, y, {_floor('t', MINUTES)} as w
        from driven join cells using (edge_id)""",
    "islands": """
        select *, seq - row_number() over (partition by traj_id, x, y, w order by seq) as island
        from placed where x >= 0""",
    "runs": """
        select traj_id, min(seq) as run_start, x, y, w, count(*) as edges, sum(length) as length,
               sum(seconds)::bigint as seconds, sum(length) / sum(seconds) as speed
        from islands group by traj_id, x, y, w, island having sum(seconds) <> 0""",
    "runs60": f"""
        select x, y, w, sum(length) / sum(seconds) as speed
        from (select *, seq - row_number() over (partition by traj_id, x, y, w order by seq) as island
              from (select traj_id, seq, length, seconds, x, y, {_floor('t', 60)} as w
                    from driven join cells using (edge_id)) where x >= 0)
        group by traj_id, x, y, w, island having sum(seconds) <> 0""",
    "panel": "select w, x, y, avg(speed) as speed, count(*) as num from runs group by 1, 2, 3",
    "trav16": """
        select a.traj_id, a.seq, a.edge_id, a.t, a.seconds, a.n - 1 as n, f.start_lon as first_lon,
               f.start_lat as first_lat, l.start_lon as last_lon, l.start_lat as last_lat,
               f.length // 2 as first_len, l.length // 2 as last_len
        from driven a
        join driven fa on fa.traj_id = a.traj_id and fa.seq = 0 join geo f on f.edge_id = fa.edge_id
        join driven la on la.traj_id = a.traj_id and la.seq = la.n - 2 join geo l on l.edge_id = la.edge_id""",
    "placed16": f"""
        select traj_id, seq, seconds, {_floor('t', MINUTES)} as w, {_x('lon', 'lat')} as x, {_y('lon', 'lat')} as y,
               cast(len as double) as length, eligible
        from (select a.*, case when seq = 0 then first_len when seq = n - 1 then last_len else g.length end as len,
                     case when seq = 0 then first_lon when seq = n - 1 then last_lon else g.start_lon end as lon,
                     case when seq = 0 then first_lat when seq = n - 1 then last_lat else g.start_lat end as lat,
                     g.road_class in (0, 1, 2, 3, 4, 6) as eligible
              from trav16 a join geo g using (edge_id))""",
    "runs16": """
        select traj_id, min(seq) as run_start, x, y, w, count(*) as edges, sum(length) as length,
               sum(seconds)::bigint as seconds, sum(length) / sum(seconds) as speed
        from (select *, seq - row_number() over (partition by traj_id, x, y, w order by seq) as island
              from placed16 where x >= 0 and eligible)
        group by traj_id, x, y, w, island
        having sum(seconds) <> 0 and sum(length) / sum(seconds) between 0.5 and 50""",
    "link_speed": f"""
        select edge_id, {_floor('t', FINE)} as w, avg(length / seconds) as speed, count(*) as num
        from trav16 join subnet using (edge_id)
        where seq between 1 and n - 2 and seconds <> 0 and length / seconds between 0.5 and 50 group by 1, 2""",
    "times": "select distinct w from panel",
    "grid": f"""
        select cast(a.x as integer) as x, cast(b.y as integer) as y
        from range({GRID.nx}) a(x), range({GRID.ny}) b(y)""",
    "silent": """
        select g.x, g.y from grid g left join panel p on p.x = g.x and p.y = g.y and p.speed <> 0 and p.num <> 0
        group by 1, 2 having count(p.w) / cast((select count(*) from filled) as double) < 0.05""",
    "dense": """
        select t.w, g.x, g.y, coalesce(p.speed, 0) as speed, coalesce(p.num, 0) as num
        from times t cross join grid g left join panel p on p.w = t.w and p.x = g.x and p.y = g.y""",
    "day_counts": """
        select d.day, count(t.w) as windows
        from (select unnest(generate_series(min(w)::date::timestamp, max(w)::date::timestamp, interval 1 day))::date as day
              from times) d left join times t on t.w::date = d.day group by 1""",
    "flagged": f"select * from day_counts where windows < {int(DAY * 0.3)}",
    "flagged86": f"select * from day_counts where windows < {int(DAY * 0.86)}",
    "span": f"""
        select unnest(generate_series(min(w), max(w), interval {MINUTES} minute)) as w from times""",
    "filled": """
        select w from times union select w from span where w::date not in (select day from flagged)""",
    "filled86": """
        select w from times union select w from span where w::date not in (select day from flagged86)""",
    "silent_filled": """
        select g.x, g.y from grid g left join panel p on p.x = g.x and p.y = g.y and p.speed <> 0 and p.num <> 0
        group by 1, 2 having count(p.w) / cast((select count(*) from filled) as double) < 0.05""",
    "dense_filled": """
        select t.w, g.x, g.y, coalesce(p.speed, 0) as speed, coalesce(p.num, 0) as num
        from filled t cross join grid g left join panel p on p.w = t.w and p.x = g.x and p.y = g.y""",
    "complete": """
        select s.w, g.x, g.y,
               case when t.w is not null then coalesce(p.speed, 0)
                    when (g.x, g.y) in (select (x, y) from silent) then 0 else 4 end::double as speed,
               case when t.w is not null then coalesce(p.num, 0) else 0 end as num
        from span s cross join grid g left join times t on t.w = s.w
        left join panel p on p.w = s.w and p.x = g.x and p.y = g.y""",
    "whole_days": f"""
        select * from complete where w::date in
            (select w::date from complete group by 1 having count(distinct w) = {DAY})""",
    "vals": f"""
        select w, x, y, speed as value from cleaned
        where w::date in (select w::date from cleaned group by 1 having count(distinct w) = {DAY})""",
    "ranked_vals": "select w, row_number() over (order by w) - 1 as pos from (select distinct w from vals)",
    "features": f"""
        select f.* from ({_lagged('vals', 'x, y', 'value', CPT_LAGS)}) f join ranked_vals r on r.w = f.w
        where r.pos >= {7 * DAY}""",
    "pred": f"""
        select w, 0 as flow, x, y, round_even({MEAN}, 0) as predict, round_even(value, 0) as real from features""",
    "pred_lag": "select w, 0 as flow, x, y, round_even(c1, 0) as predict, round_even(value, 0) as real from features",
    "ranked": "select w, row_number() over (order by w) as pos from times",
    "change": """
        select a.w, sqrt(sum(pow(a.speed - b.speed, 2))) as diff
        from (select * from dense join ranked using (w)) a join (select * from dense join ranked using (w)) b
          on b.pos = a.pos - 1 and a.x = b.x and a.y = b.y group by 1""",
    "test_tail": f"select distinct w from features order by w desc limit {LEN_TEST}",
    "weather_before": """
        select date, lag(max_t) over o as max_t, lag(min_t) over o as min_t, lag(wind) over o as wind,
               lag(weather) over o as weather
        from weather window o as (order by date)""",
    "external": f"""
        select s.w, {_calendar('s.w')}, cast(h.date is not null as integer) as holiday, {_flags('weather', 'null')},
               case when wind is not null then {_unit('wind')} end as wind_scaled,
               case when max_t is not null then {_unit('max_t')} end as max_t_scaled,
               case when min_t is not null then {_unit('min_t')} end as min_t_scaled
        from (select distinct w from features) s join weather_before b on b.date = s.w::date
        left join holiday h on h.date = s.w::date""",
    "wind_text": """
        select date, wind, case wind when 0 then '微风' when 1 then '无' when 2 then '小于2级'
               else '北风' || wind || '级' end as wind_text from weather""",
    "scaled_vals": f"""
        select w, x, y, (value - lo) / (hi - lo) * 2 - 1 as value
        from vals, (select min(value) as lo, max(value) as hi from vals
                    where w not in (select distinct w from vals order by w desc limit {LEN_TEST}))""",
    "scaled_features": f"""
        select f.* from ({_lagged('scaled_vals', 'x, y', 'value', CPT_LAGS)}) f join ranked_vals r on r.w = f.w
        where r.pos >= {7 * DAY}""",
    "classes": f"select {_label('speed')} as label, x, cast(isodow(w) - 1 as integer) as weekday from panel",
}


def _interpolated(dense: str, silent: str) -> str:
    return f"""
        select w, x, y, num,
               case when (x, y) in (select (x, y) from {silent}) then 0.0::double
                    when speed >= 0.25 then speed
                    when p is null and q is null then 0.0::double
                    when p is null then vq when q is null then vp
                    else vp + (vq - vp) / (q - p) * (i - p) end as speed
        from (select *, last_value(case when speed >= 0.25 then i end ignore nulls) over up as p,
                     last_value(case when speed >= 0.25 then speed end ignore nulls) over up as vp,
                     first_value(case when speed >= 0.25 then i end ignore nulls) over down as q,
                     first_value(case when speed >= 0.25 then speed end ignore nulls) over down as vq
              from (select *, row_number() over (partition by x, y order by w) as i from {dense})
              window up as (partition by x, y order by w rows between unbounded preceding and current row),
                     down as (partition by x, y order by w rows between current row and unbounded following))"""


CTES["interpolated"] = _interpolated("dense", "silent")
CTES["interpolated_filled"] = _interpolated("dense_filled", "silent_filled")
# Each later gap, once one was closed, begins at the known value before it.
CTES["gap_rows"] = """
    select *, row_number() over (partition by x, y order by w) as i from dense"""
CTES["gap_known"] = "select x, y, i, speed as v from gap_rows where speed >= 0.25"
CTES["gaps_closed"] = """
    select x, y, p, vp, i as q, v as vq,
           min(case when p is null or i > p + 1 then i end) over (partition by x, y order by i
               rows between unbounded preceding and 1 preceding) as closed_before
    from (select *, lag(i) over (partition by x, y order by i) as p, lag(v) over (partition by x, y order by i) as vp
          from gap_known)
    where (p is null and i > 1) or p is not null"""
CTES["gap_spans"] = """
    select x, y, p, vp, q, vq, case when p is null then 1 when closed_before is not null then p else p + 1 end as s
    from gaps_closed where (p is null and q > 1) or q > p + 1"""
CTES["interpolated_compat"] = """
    select r.w, r.x, r.y, r.num,
           case when (r.x, r.y) in (select (x, y) from silent) then 0.0::double
                when g.q is not null and g.p is null then g.vq
                when g.q is not null then g.vp + (g.vq - g.vp) / (g.q - g.s + 1) * (r.i - g.s + 1)
                when r.speed >= 0.25 then r.speed
                else coalesce((select arg_max(k.v, k.i) from gap_known k where k.x = r.x and k.y = r.y and k.i < r.i), 0) end as speed
    from gap_rows r left join gap_spans g on g.x = r.x and g.y = r.y and r.i >= g.s and r.i < g.q"""

W = _fmt("w") + " as w"
PANEL_COLUMNS = f"{W}, x, y, round(speed, 6) as speed, num"
FEATURE_COLUMNS = f"{W}, x, y, round(value, 6) as value, " + ", ".join(f"round({c}, 6) as {c}" for c in CPT_LAGS)
EXTERNAL_NAMES = (
    [f"weekday_{k}" for k in range(7)]
    + ["is_weekday", "holiday", "clear", "cloudy", "overcast", "rain_small", "rain_medium", "rain_large"]
    + ["rain_shower", "rain_storm", "snow", "haze"]
)
EXTERNAL_SCALED = ["wind_scaled", "max_t_scaled", "min_t_scaled"]
EXTERNAL_COLUMNS = ", ".join(["e." + n for n in EXTERNAL_NAMES] + [f"round(e.{n}, 6) as {n}" for n in EXTERNAL_SCALED])


def _f(columns: str, prefix: str) -> str:
    """Feature columns taken from the alias ``prefix``."""
    return (
        f"{_fmt(prefix + '.w')} as w, {prefix}.x, {prefix}.y, round({prefix}.value, 6) as value, "
        + ", ".join(f"round({prefix}.{c}, 6) as {c}" for c in CPT_LAGS)
    )


def _corners() -> str:
    columns = []
    for k, (dx, dy) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)]):
        columns.append(f"round({_d(GRID.lon0)} + (x + {dx}) * {_d(GRID.lon_step)}, 6) as lon{k}")
        columns.append(f"round({_d(GRID.lat0)} + (y + {dy}) * {_d(GRID.lat_step)}, 6) as lat{k}")
    return ", ".join(columns)


def _entropy(source: str) -> str:
    return f"select -sum(p * log2(p)) from (select count(*) / sum(count(*)) over () as p from {source} group by label)"


VERTEX_CELLS = f"(select vertex_id, {_x('lon', 'lat')} as x, {_y('lon', 'lat')} as y from road_vertex)"
CHOSEN_SQL = " and ".join(
    [
        f"t >= strptime('{CHOSEN[0]}', '%Y%m%d%H%M%S')",
        f"t < strptime('{CHOSEN[1]}', '%Y%m%d%H%M%S')",
    ]
)
MINMAX = "(select min(speed) as lo, max(speed) as hi from panel)"
AFTER = f"""(select distinct {_shift('c.w', 'k.k')} as w
    from (select w from change order by diff desc, w limit %d) c, (values (1), (2)) k(k))"""
CLASS_CASE = " ".join(f"when '{code}' then {number}" for code, number in ROAD_CLASS_CODES.items())

SQL: dict[str, str] = {
    # Sources and sinks.
    "read_edges": "select edge_id, s_id, e_id, round(length, 6) as length from road_edge",
    "read_vertices": "select vertex_id, round(lon, 6) as lon, round(lat, 6) as lat from road_vertex",
    "read_edges_geo": """select edge_id, round(start_lon, 6) as start_lon, round(start_lat, 6) as start_lat,
        round(end_lon, 6) as end_lon, round(end_lat, 6) as end_lat, length, road_class from geo""",
    "read_subnet": """select edge_id, s_id, e_id, code as road_class, 11 as width, cast(length as integer) as length,
        40 as speed_limit from subnet""",
    "read_trajectories": f"select traj_id, seq, edge_id, {_sec('t')} as t from traversal",
    "read_trajectories_2016": """
        select string_agg(edge_id, '|' order by seq) as edges,
               string_agg(epoch(t)::bigint - 28800, '|' order by seq) || '|' || max(epoch(t)::bigint - 28800 + seconds) as times,
               round(max(first_lon), 6) as start_lon, round(max(first_lat), 6) as start_lat,
               round(max(last_lon), 6) as end_lon, round(max(last_lat), 6) as end_lat,
               cast(max(first_len) as integer) as first_len, cast(max(last_len) as integer) as last_len
        from trav16 group by traj_id""",
    "month_scan": "select edge_id as first_edge, count(*) as trips from trav16 where seq = 0 group by 1",
    "read_link_stats": f"select edge_id, {W}, travel_time, num from link_stat",
    "write_link_stats": f"""select edge_id || '|' || string_agg('(' || {_fmt('w')} || ',' || travel_time || ',' || num || ')', '|' order by w) as line
        from link_stat20 group by edge_id""",
    "read_panel": f"select {PANEL_COLUMNS} from panel",
    "write_panel": f"select {PANEL_COLUMNS} from panel where speed <> 0",
    "read_link_speed": f"select edge_id, {W}, round(speed, 6) as speed, num from link_speed",
    "read_no_signal": "select x, y from silent",
    "path_partitioned_result": f"""select {W}, x, y, round(avg(speed), 6) as speed, count(*) as num,
        {GRID.nx} as lon_split, {GRID.ny} as lat_split, 60 as time_window from runs60 group by runs60.w, x, y""",
    "result_store": f"select {W}, flow, x, y, predict, real from pred",
    "road_num_store": "select edge_id, num from road_count where num >= 4",
    # Scalar expressions.
    "window_floor": f"""select traj_id, seq, {_fmt(_floor('t', 20))} as w20, {_fmt(_floor('t', 50))} as w50,
        {_fmt(_floor('t', 7))} as w7 from traversal""",
    "time_diff": """select traj_id, seq, date_diff('second', date_trunc('day', t) + interval 12 hour, t) as seconds
        from traversal""",
    "epoch_to_time": f"""select traj_id, seq, {_sec('t + interval 8 hour')} as beijing,
        {_sec('t - interval 210 minute')} as newfoundland from traversal""",
    "grid_xy": f"select * from {VERTEX_CELLS}",
    "cell_id": f"select vertex_id, x * {GRID.ny} + y as cell from {VERTEX_CELLS} where x >= 0",
    "cell_xy": f"""select vertex_id, cast(vertex_id % {GRID.cells} // {GRID.ny} as integer) as x,
        cast(vertex_id % {GRID.cells} % {GRID.ny} as integer) as y from road_vertex""",
    "road_class_code": f"""select edge_id, case '0x0' || lower(to_hex(edge_id % 16)) {CLASS_CASE} end as code
        from road_edge""",
    "in_road_class": """select traj_id, seq, coalesce(road_class in (0, 1, 2, 3, 4, 6), false) as eligible
        from (select * replace (case when seq % 7 = 3 then edge_id + 10000000 else edge_id end as edge_id) from traversal)
        left join road_edge using (edge_id)""",
    "segment_point": """select traj_id, seq,
        round(case when seq = 0 then first_lon when seq = n - 1 then last_lon else coalesce(start_lon, -1) end, 6) as lon,
        round(case when seq = 0 then first_lat when seq = n - 1 then last_lat else coalesce(start_lat, -1) end, 6) as lat
        from (select * replace (case when seq % 7 = 3 then edge_id + 10000000 else edge_id end as edge_id) from trav16)
        left join geo using (edge_id)""",
    "congestion_label": f"select {W}, x, y, {_label('speed')} as label from dense",
    "speed_kmh": f"select {W}, x, y, round(speed * {_d(3.6)}, 6) as kmh from panel",
    "speed_color_bucket": f"""select {W}, x, y, case when speed > 0 then
        cast(least(floor(speed * {_d(3.6)} / 15), 3) as integer) end as bucket from dense""",
    "cell_polygon": f"select vertex_id, {_corners()} from {VERTEX_CELLS} where x >= 0",
    "calendar_features": f"select {W}, {_calendar('w')} from times",
    "weather_flags": f"select strftime(date, '%Y%m%d') as date, {_flags('weather')} from weather",
    "wind_level": """select strftime(date, '%Y%m%d') as date,
        cast(case wind when 0 then 0 when 1 then 0 when 2 then 1 else wind end as integer) as level from weather""",
    "minmax_scale": f"""select {W}, x, y, round((speed - lo) / (hi - lo) * 2 - 1, 6) as scaled, true as restored
        from panel, {MINMAX}""",
    "minmax_scale_01": f"""select {W}, x, y, round((speed - lo) / (hi - lo), 6) as scaled, true as restored
        from panel, {MINMAX}""",
    "round_half_even": "select edge_id, cast(round_even(length / 200, 0) as integer) as rounded from road_edge",
    "time_shift": f"select {W}, {_fmt(_shift('w', 2))} as later, {_fmt(_shift('w', -1))} as earlier from times",
    "display_time": f"select {W}, strftime(w, '%Y/%m/%d %H:%M') as shown from times",
    "parse_time": f"select {_fmt('w')} as text, epoch(w)::bigint as epoch from times",
    "cell_count": f"""select count(distinct w) as samples,
        cast(count(distinct w) * ({GRID.cells} - (select count(*) from silent)) as bigint) as cells,
        count(distinct w) as back from dense""",
    # Joins.
    "edge_lookup": "select traj_id, seq, edge_id, round(length, 6) as length from traversal join road_edge using (edge_id)",
    "edge_start_vertex": """select traj_id, seq, round(length, 6) as length, round(lon, 6) as lon, round(lat, 6) as lat
        from traversal join starts using (edge_id)""",
    "geo_edge_lookup": """select traj_id, seq, length as edge_length, road_class, round(start_lon, 6) as lon
        from (select * replace (case when seq % 7 = 3 then edge_id + 10000000 else edge_id end as edge_id) from trav16)
        left join geo using (edge_id)""",
    "subnet_semi": "select traj_id, seq, edge_id, round(length, 6) as length from traversal join subnet using (edge_id)",
    "exclude_no_signal": f"select {PANEL_COLUMNS} from panel where (x, y) not in (select (x, y) from silent)",
    "mark_no_signal": f"""select {W}, x, y,
        round(case when (x, y) in (select (x, y) from silent) then 0.0::double else speed end, 6) as speed, num from panel""",
    "lag_self_join": f"""select {W}, x, y, round(speed, 6) as speed, round(c1, 6) as c1, round(c2, 6) as c2
        from ({_lagged('dense', 'x, y', 'speed', {'c1': 1, 'c2': 2})})""",
    "holiday_semi": """select strftime(d.date, '%Y%m%d') as date, cast(h.date is not null as integer) as holiday
        from days d left join holiday h on h.date = d.date""",
    "weather_prev_row": """select strftime(date, '%Y%m%d') as date, max_t, min_t, wind, weather from weather_before""",
    "times_in_set": f"select {PANEL_COLUMNS} from panel where w in (select w from {AFTER % 50})",
    "diff_test_select": f"""select {FEATURE_COLUMNS} from features
        where w in (select w from change where diff > 20)""",
    # Filters and selection.
    "min_section_length": "select edge_id, round(length, 6) as length from road_edge where length >= 2500",
    "drop_last_traversal": "select traj_id, seq, edge_id from timed where seq < n - 1",
    "drop_first_last": "select traj_id, seq, edge_id from trav16 where seq > 0 and seq < n - 1",
    "speed_range": "select traj_id, run_start, round(speed, 6) as speed from runs where speed >= 0.5 and speed <= 50",
    "choose_trajectories": f"""select traj_id, seq, edge_id, {_sec('t')} as t from traversal
        where traj_id in (select traj_id from traversal where {CHOSEN_SQL})""",
    "choose_traversals": f"""select traj_id, seq, edge_id, {_sec('t')} as t from traversal
        where traj_id in (select traj_id from traversal where {CHOSEN_SQL})""",
    "trajectory_size": """select trip as traj_id, cast(count(*) as integer) as edges
        from (select traj_id * 2 + cast(seq >= traj_id % 17 + 2 as integer) as trip from traversal)
        group by trip having count(*) + 1 between 5 and 12""",
    "min_road_num": "select edge_id, num from road_count where num >= 4",
    "panel_times": f"select {W} from times",
    "panel_at": f"""select {PANEL_COLUMNS} from panel
        where w = (select w from (select w, count(*) as n from panel group by 1) order by n desc, w desc limit 1)""",
    "cell_series": f"""select {PANEL_COLUMNS} from (select * from panel where x = 1 and y = 1 order by w limit 500)""",
    "train_test_split_tail": f"""select part, count(*) as n, {_fmt('min(w)')} as first_w
        from (select *, case when w in (select distinct w from vals order by w desc limit {LEN_TEST})
              then 'test' else 'train' end as part from vals) group by part""",
    # Aggregations.
    "link_travel_time": f"select edge_id, {W}, travel_time, num from link_stat",
    "cell_travel_time": f"""select {W}, x, y, sum(travel_time)::bigint as travel_time, sum(num)::bigint as num
        from link_stat join cells using (edge_id) where x >= 0 group by link_stat.w, x, y""",
    "cell_link_travel_time": f"select {W}, x, y, edge_id, travel_time, num from cell_link",
    "cell_links_nested": f"""select {W}, x, y,
        string_agg(edge_id || ',' || travel_time || ',' || num, ';' order by edge_id) as links
        from cell_link group by cell_link.w, x, y""",
    "cell_edge_count": "select x, y, count(distinct edge_id) as edges from cell_link group by 1, 2",
    "cell_speed_from_links": f"""select {_fmt('w20')} as w, x, y,
        round(sum(case when travel_time <> 0 then length / (travel_time / cast(num as double)) else 0 end) / count(*), 6) as speed
        from (select c.*, e.length, {_floor('c.w', MINUTES)} as w20 from cell_link c join road_edge e using (edge_id))
        group by w20, x, y""",
    "cell_speed_from_runs": f"select {PANEL_COLUMNS} from panel",
    "cell_condition": f"select {PANEL_COLUMNS}, {_label('speed')} as label from panel",
    "cell_speed_from_runs_2016": f"""select {W}, x, y, round(avg(speed), 6) as speed, count(*) as num
        from runs16 group by runs16.w, x, y""",
    "link_speed": f"select edge_id, {W}, round(speed, 6) as speed, num from link_speed",
    "link_speed_rollup": f"""select edge_id, {_fmt('w20')} as w, round(sum(num * speed) / sum(num), 6) as speed,
        sum(num)::bigint as num
        from (select *, {_floor('w', MINUTES)} as w20 from link_speed
              where edge_id in (select edge_id from subnet where road_class = 1))
        group by edge_id, w20""",
    "road_trip_count": "select edge_id, num from road_count",
    "road_class_by_count": """select edge_id, num, case when num >= 10 then 10 when num >= 5 then 5 else 2 end as split,
        round(start_lon, 6) as start_lon, round(start_lat, 6) as start_lat, round(end_lon, 6) as end_lon,
        round(end_lat, 6) as end_lat from road_count join geo using (edge_id) where num >= 2""",
    "no_signal_cells": "select x, y from silent_filled",
    "panel_info": f"""
        select count(*) filter (where speed > 0) as with_speed, round(max(speed), 6) as max_speed,
               {_fmt("(select w from heard order by speed desc, w limit 1)")} as max_w, round(min(speed), 6) as min_speed,
               {_fmt("(select w from heard order by speed, w limit 1)")} as min_w,
               (select count(*) from times) * ({GRID.cells} - (select count(*) from silent)) as expected
        from heard""",
    "integrity_check": f"""
        select {_fmt('min(w)')} as first_w, {_fmt('max(w)')} as last_w, count(*) as actual,
               cast(date_diff('minute', min(w), max(w)) // {MINUTES} as bigint) as expected_exclusive,
               cast(date_diff('minute', min(w), max(w)) // {MINUTES} + 1 as bigint) as expected,
               date_diff('minute', min(w), max(w)) // {MINUTES} + 1 = count(*) as complete from times""",
    "label_count": f"select count(*) as labelled from dense where {_label('speed')} > 0",
    "rmse": """select round(sqrt(avg(pow(predict - real, 2))), 6) as rmse, count(*) as "values"
        from pred where (x, y) not in (select (x, y) from silent)""",
    "accuracy": """select round(avg(cast(predict = real as integer)), 6) as accuracy, count(*) as "values"
        from pred where (x, y) not in (select (x, y) from silent)""",
    "frame_change": f"select {W}, round(diff, 6) as diff from change",
    "compare_after_change": f"""select model, round(sqrt(avg(pow(predict - real, 2))), 6) as rmse, count(*) as "values"
        from (select 'mean' as model, * from pred union all select 'latest', * from pred_lag)
        where w in (select w from {AFTER % 300}) and (x, y) not in (select (x, y) from silent) group by 1""",
    "compare_at_change": """select model, round(sqrt(avg(pow(predict - real, 2))), 6) as rmse, count(*) as "values"
        from (select 'mean' as model, * from pred union all select 'latest', * from pred_lag)
        where w in (select w from change order by diff desc, w limit 300) and (x, y) not in (select (x, y) from silent)
        group by 1""",
    "mean_predictor": f"select {W}, x, y, round({MEAN}, 6) as predict from features",
    "entropy": f"select round(({_entropy('classes')}), 6) as entropy",
    "information_gain": f"""select round(({_entropy('classes')}) - sum(n * h) / sum(n), 6) as gain
        from (select x, sum(c) as n, -sum(c / total * log2(c / total)) as h
              from (select x, label, count(*) as c, cast(sum(count(*)) over (partition by x) as double) as total
                    from classes group by x, label) group by x)""",
    "majority_label": """select x, weekday, label, round(c / total, 6) as confidence, cast(total as bigint) as support
        from (select x, weekday, label, count(*) as c,
                     cast(sum(count(*)) over (partition by x, weekday) as double) as total,
                     row_number() over (partition by x, weekday order by count(*) desc, label) as rn
              from classes group by x, weekday, label) where rn = 1""",
    "weather_minmax": f"""select strftime(date, '%Y%m%d') as date, round({_unit('wind')}, 6) as wind_scaled,
        round({_unit('max_t')}, 6) as max_t_scaled, round({_unit('min_t')}, 6) as min_t_scaled from weather""",
    # Ordered operators.
    "cell_runs": f"""select traj_id, run_start, x, y, {W}, edges, round(length, 6) as length, seconds,
        round(speed, 6) as speed from runs""",
    "cell_runs_2016": f"""select traj_id, run_start, x, y, {W}, edges, round(length, 6) as length, seconds,
        round(speed, 6) as speed from runs16""",
    "travel_seconds": "select traj_id, seq, epoch(next_t)::bigint - epoch(t)::bigint as seconds from timed",
    "interpolate_gaps": f"select {PANEL_COLUMNS} from interpolated",
    "interpolate_gaps_compat": f"select {PANEL_COLUMNS} from interpolated_compat",
    "fill_low_weight": f"""select {W}, x, y, round(case when (x, y) in (select (x, y) from silent) then 0
        when num < 2 then 20 else speed end, 6) as speed, num from dense""",
    "neighbour_max_fill": f"""select {W}, x, y, num, round(case when speed = 0
        and (x, y) not in (select (x, y) from silent) then greatest(before, after) else speed end, 6) as speed
        from (select *, lag(speed) over o as before, lead(speed) over o as after from dense
              window o as (partition by x, y order by w))""",
    "trajectory_sequence": "select traj_id, seq, edge_id, seq = n - 1 as is_last from timed",
    "sliding_sequences": f"""select {W}, x, y, round(s0, 6) as s0, round(s1, 6) as s1, round(speed, 6) as s2
        from (select *, lag(speed, 2) over o as s0, lag(speed, 1) over o as s1 from dense
              window o as (partition by x, y order by w)) where s0 is not null""",
    # Panel completion.
    "incomplete_days": "select strftime(day, '%Y%m%d') as day, windows from flagged86",
    "fill_windows": f"select {W} from filled86",
    "drop_flagged_days": f"select {PANEL_COLUMNS} from panel where w::date not in (select day from flagged86)",
    "densify": f"select {PANEL_COLUMNS} from dense",
    "complete_panel": f"select {PANEL_COLUMNS} from complete",
    "complete_days_only": f"select {PANEL_COLUMNS} from whole_days",
    "complete_days_only_compat": f"""select {PANEL_COLUMNS} from panel
        where w::date in (select day from day_counts where windows = {DAY})
          and w::date < coalesce((select min(w::date) from times join day_counts on day = w::date
                                  where w = date_trunc('day', w) and windows <> {DAY}), date '9999-01-01')""",
    "preprocess_panel": f"""select {PANEL_COLUMNS}, {_label('speed')} as label from interpolated_filled
        where w::date not in (select day from flagged)""",
    "preprocess_panel_low_weight": f"""select {PANEL_COLUMNS}, {_label('speed')} as label
        from (select w, x, y, num, case when (x, y) in (select (x, y) from silent_filled) then 0.0::double
              when num < 5 then 20.0::double else speed end as speed from dense_filled)
        where w::date not in (select day from flagged)""",
    # Features.
    "cpt_features": f"select {FEATURE_COLUMNS} from features",
    "external_features": f"select {_fmt('e.w')} as w, {EXTERNAL_COLUMNS} from external_all e",
    "cell_samples": f"""select {_f('', 'f')}, {EXTERNAL_COLUMNS} from features f join external e on e.w = f.w
        where (f.x, f.y) not in (select (x, y) from silent)""",
    "cells_to_frame": f"""select {_fmt('t.w')} as w, g.x, g.y,
        case when (g.x, g.y) in (select (x, y) from silent) then -1.0::double else p.predict end as predict
        from (select distinct w from pred where (x, y) not in (select (x, y) from silent)) t cross join grid g
        left join pred p on p.w = t.w and p.x = g.x and p.y = g.y""",
    "load_dataset": f"""select {_f('', 'f')}, {EXTERNAL_COLUMNS},
        case when f.w in (select w from test_tail) then 'test' else 'train' end as part
        from scaled_features f join external e on e.w = f.w where (f.x, f.y) not in (select (x, y) from silent)""",
    "multi_file_union": f"""select source_id, {W}, x, y, round(speed, 6) as speed, round(c1, 6) as c1, round(c2, 6) as c2
        from ({_lagged('halves', 'source_id, x, y', 'speed', {'c1': 1, 'c2': 2})})""",
    "test_on_change": f"""select {_f('', 'f')}, {EXTERNAL_COLUMNS} from features f join external e on e.w = f.w
        where (f.x, f.y) not in (select (x, y) from silent) and f.w in (select w from change where diff > 20)""",
    "model_report": f"""
        select round(1 - avg(pow(p - r, 2)) / var_pop(r), 6) as score, round(sqrt(avg(pow(p - r, 2))), 6) as rmse,
               round(avg(cast(p = r as integer)), 6) as accuracy, count(*) as "values"
        from (select ({MEAN} + 1) / 2 * (hi - lo) + lo as p, (value + 1) / 2 * (hi - lo) + lo as r
              from scaled_features, (select min(value) as lo, max(value) as hi from vals
                   where w not in (select distinct w from vals order by w desc limit {LEN_TEST}))
              where w in (select w from test_tail) and (x, y) not in (select (x, y) from silent))""",
    "model_report_labels": """
        select round(avg(cast(predict = real as integer)), 6) as score, round(sqrt(avg(pow(predict - real, 2))), 6) as rmse,
               round(avg(cast(predict = real as integer)), 6) as accuracy, count(*) as "values"
        from pred where (x, y) not in (select (x, y) from silent)""",
    "trips_to_score": f"""
        select round(sqrt(avg(pow(p - r, 2))), 6) as rmse, count(*) as "values",
               round(avg(cast({_label('round(p, 6)')} = {_label('round(r, 6)')} as integer)), 6) as label_accuracy
        from (select f.*, {MEAN} as p, speed as r, dense_rank() over (order by f.w desc) as late
              from ({_lagged('cleaned', 'x, y', 'speed', CPT_LAGS)}) f join ranked_cleaned r on r.w = f.w
              where r.pos >= {7 * DAY})
        where late <= {LEN_TEST} and (x, y) not in (select (x, y) from silent)""",
    "weather_pages": f"""select strftime(date, '%Y%m%d') as date, max_t, min_t, {_flags('weather')},
        cast(case wind when 0 then 0 when 1 then 0 when 2 then 1 else wind end as integer) as wind from weather""",
    "trajectory_polyline": f"""select traj_id, seq // 4096 as part, string_agg({_sec('t')} || ' ' || cast(round(lon * 1000) as bigint)
        || ' ' || cast(round(lat * 1000) as bigint), ';' order by seq) as line
        from traversal join starts using (edge_id) group by traj_id, seq // 4096""",
}

CTES["cleaned"] = "select w, x, y, speed from interpolated_filled where w::date not in (select day from flagged)"
CTES["ranked_cleaned"] = "select w, row_number() over (order by w) - 1 as pos from (select distinct w from cleaned)"
CTES["heard"] = "select * from dense where (x, y) not in (select (x, y) from silent)"
CTES["halves"] = """
    select source_id, w, g.x, g.y, coalesce(p.speed, 0) as speed
    from (select *, case when w < timestamp '2024-01-16' then 0 else 1 end as source_id from times) t
    cross join grid g left join panel p using (w, x, y)"""
CTES["lab_complete"] = f"""
    select s.w, g.x, g.y,
           case when t.w is not null then coalesce({_label('p.speed')}, 0)
                when (g.x, g.y) in (select (x, y) from silent) then 0 else 4 end::double as value
    from span s cross join grid g left join times t on t.w = s.w
    left join panel p on p.w = s.w and p.x = g.x and p.y = g.y"""
CTES["lab_vals"] = f"""
    select * from lab_complete where w::date in
        (select w::date from lab_complete group by 1 having count(distinct w) = {DAY})"""
CTES["ranked_lab"] = "select w, row_number() over (order by w) - 1 as pos from (select distinct w from lab_vals)"
CTES["lab_features"] = f"""
    select f.* from ({_lagged('lab_vals', 'x, y', 'value', CPT_LAGS)}) f join ranked_lab r on r.w = f.w
    where r.pos >= {7 * DAY}"""
CTES["external_lab"] = CTES["external"].replace("from features", "from lab_features")
for _name, _rows, _external in (("tree", "lab_features", "external_lab"), ("speed", "features", "external")):
    _columns = ", ".join(f"e.{c}" for c in TREE_EXTERNALS)
    CTES[f"{_name}_rows"] = f"""
        select f.*, {_columns} from {_rows} f join {_external} e on e.w = f.w where (f.x, f.y) not in (select (x, y) from silent)"""
    CTES[f"{_name}_tail"] = f"select distinct w from {_name}_rows order by w desc limit {LEN_TEST}"
    CTES[f"{_name}_train"] = f"select * from {_name}_rows where w not in (select w from {_name}_tail)"
    CTES[f"{_name}_test"] = f"select * from {_name}_rows where w in (select w from {_name}_tail)"


def _bin(column: str) -> str:
    return f"floor({column} / {SPEED_BIN}) * {SPEED_BIN}"


oracle_trees.add(
    W, list(CPT_LAGS), TREE_EXTERNALS, LABELS, FOREST, GRID_CHOICES,
    key=f"({_fmt('w')} || '/' || x || '/' || y)", bin_of=_bin, label_of=_label,
)
CTES |= oracle_trees.CTES
SQL |= oracle_trees.SQL
CTES["flow_vals"] = """
    select cast(flow as integer) as flow, w, x, y, case flow when 0 then speed else cast(num as double) end as value
    from interpolated_filled, range(2) flows(flow) where w in (select w from vals)"""
CTES["flow_scaled"] = f"""
    select v.flow, w, x, y, case when hi = lo then -1.0::double else (value - lo) / (hi - lo) * 2 - 1 end as value
    from flow_vals v join (select flow, min(value) as lo, max(value) as hi from flow_vals
        where w not in (select distinct w from flow_vals order by w desc limit {LEN_TEST}) group by flow) l on l.flow = v.flow"""
CTES["flow_features"] = f"""
    select f.* from ({_lagged('flow_scaled', 'flow, x, y', 'value', CPT_LAGS)}) f join ranked_vals r on r.w = f.w
    where r.pos >= {7 * DAY} and (f.x, f.y) not in (select (x, y) from silent)"""
SQL["load_dataset_flows"] = f"""select flow, {FEATURE_COLUMNS}, case when w in
    (select distinct w from flow_features order by w desc limit {LEN_TEST}) then 'test' else 'train' end as part from flow_features"""
SQL["change_ranking_store"] = SQL["compare_after_change"]
CTES["external_all"] = CTES["external"].replace("from features", "from vals")


def _sweep(lengths: list[int], name: str, step: int, kind: str, silent: bool = True, tree: bool = False) -> str:
    parts = []
    for length in lengths:
        lags = {f"{name}{k}": k * step for k in range(1, length + 1)}
        mean = "(" + " + ".join(lags) + f") / {length}"
        source = f"""
            select f.* from ({_lagged('vals', 'x, y', 'value', lags)}) f join ranked_vals r on r.w = f.w
            where r.pos >= {max(lags.values())}"""
        heard = "and (x, y) not in (select (x, y) from silent)" if silent else ""
        parts.append(f"""
            select '{kind}' as kind, {length} as length, 'mean' as method, round(sqrt(avg(pow({mean} - value, 2))), 6) as rmse
            from (select *, dense_rank() over (order by w desc) as late from ({source})) where late <= {LEN_TEST} {heard}""")
        if tree:
            parts.append(oracle_trees.add_sweep(f"sw{length}", kind, source, list(lags), LEN_TEST, _bin))
    return " union all ".join(parts)


SQL["sweep_report"] = _sweep([1, 2, 3], "c", 1, "closeness")
SQL["sweep_report_tree"] = _sweep([1, 2], "p", DAY, "period", silent=False, tree=True)
CTES |= oracle_trees.CTES


def _needed(sql: str) -> list[str]:
    """Expressions that ``sql`` builds on, each after those it builds on itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:\b(?:from|join)|,)\s+(\w+)\b", text):
            if name in CTES and name not in order:
                visit(CTES[name])
                order.append(name)

    visit(sql)
    return order


def oracle_sql() -> dict[str, str]:
    built = {}
    for key, sql in SQL.items():
        ctes = ",\n".join(f"{name} as materialized ({CTES[name].strip()})" for name in _needed(sql))
        built[key] = f"with {ctes}\n{sql.strip()}"
    return built
