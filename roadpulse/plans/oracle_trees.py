"""SQL of the tree queries: trees with their levels written out, over congestion labels and externals."""

from __future__ import annotations

import math
from collections.abc import Sequence

#: Expressions by name, and queries, to be added to those of ``oracle``.
CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


# ---- Multiway tree ----------------------------------------------------------------------------


def _multiway(families: Sequence[Sequence[str]], externals: Sequence[str], train: str) -> int:
    """Levels of the multiway tree as lt_nodes0 ..; the number of levels."""
    attrs = [a for f in families for a in f] + list(externals)
    names = ", ".join(attrs)
    CTES["lt_rows0"] = f"""
        select 'root' as node, {names}, cast(value as integer) as label, count(*) as n, 0 as u0, 0 as u1, 0 as u2,
               cast([] as varchar[]) as ue from {train} group by all"""
    order = {a: i for i, a in enumerate(attrs)}
    options = ["{'ord': -1, 'attr': cast(null as varchar), 'value': cast(null as double)}"]

    def option(a: str, test: str) -> str:
        return f"case when {test} then {{'ord': {order[a]}, 'attr': '{a}', 'value': cast({a} as double)}} end"

    for i, family in enumerate(families):
        options += [option(a, f"u{i} = {k}") for k, a in enumerate(family)]
    options += [option(a, f"not list_contains(ue, '{a}')") for a in externals]
    levels = len(attrs) + 1
    CTES["lt_place0"] = "select 'root' as node, cast(null as varchar) as parent, cast(null as varchar) as attr, cast(null as double) as value"
    for k in range(levels):
        CTES[f"lt_counts{k}"] = f"""
            select node, o.ord as ord, o.attr as attr, o.value as value, label, sum(n) as n
            from (select node, label, n, unnest(list_filter([{', '.join(options)}], lambda x: x is not null)) as o from lt_rows{k})
            group by all"""
        CTES[f"lt_own{k}"] = f"""
            select node, label, n / sum(n) over (partition by node) as confidence, cast(sum(n) over (partition by node) as bigint) as support,
                   row_number() over (partition by node order by n desc, label) as rn
            from lt_counts{k} where ord < 0"""
        CTES[f"lt_best{k}"] = f"""
            select node, attr as split_attr, row_number() over (partition by node order by rest, ord) as rn
            from (select node, ord, attr, round(sum(n * h) / sum(n), 12) as rest
                  from (select node, ord, attr, value, sum(n) as n, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h
                        from lt_counts{k} where ord >= 0 group by all) group by node, ord, attr)"""
        CTES[f"lt_nodes{k}"] = f"""
            select p.node, p.parent, p.attr, p.value, o.label, o.confidence, o.support, {k} as level,
                   case when o.confidence <= 0.9 and o.support > 10 then b.split_attr end as split_attr
            from lt_place{k} p join lt_own{k} o on o.node = p.node and o.rn = 1 left join lt_best{k} b on b.node = p.node and b.rn = 1"""
        asked = "case split_attr " + " ".join(f"when '{a}' then cast({a} as double)" for a in attrs) + " end"
        used = ", ".join(f"u{i} + cast(split_attr in ({', '.join(repr(a) for a in f)}) as integer) as u{i}" for i, f in enumerate(families))
        some = ", ".join(repr(a) for a in externals)
        CTES[f"lt_rows{k + 1}"] = f"""
            select r.node || '/' || split_attr || '=' || cast({asked} as varchar) as node, {names}, r.label, r.n, {used},
                   case when split_attr in ({some}) then list_append(ue, split_attr) else ue end as ue
            from lt_rows{k} r join lt_nodes{k} s on s.node = r.node and s.split_attr is not null"""
        CTES[f"lt_place{k + 1}"] = f"""
            select distinct c.node || '/' || c.attr || '=' || cast(c.value as varchar) as node, c.node as parent, c.attr, c.value
            from lt_counts{k} c join lt_nodes{k} s on s.node = c.node and s.split_attr = c.attr"""
    CTES["lt_tree"] = " union all ".join(f"select * from lt_nodes{k}" for k in range(levels))
    asked = "case r.split_attr " + " ".join(f"when '{a}' then cast(r.{a} as double)" for a in attrs) + " end"
    CTES["lt_walk0"] = f"select t.w, t.x, t.y, t.value, {names}, o.label as predict, o.split_attr, o.node from tree_test t, lt_nodes0 o"
    for k in range(1, levels):
        CTES[f"lt_walk{k}"] = f"""
            select w, x, y, value, {names}, predict, split_attr, node
            from (select r.w, r.x, r.y, r.value, {', '.join('r.' + a for a in attrs)}, coalesce(c.label, r.predict) as predict,
                         c.split_attr, coalesce(c.node, r.node) as node,
                         row_number() over (partition by r.w, r.x, r.y order by abs(c.value - {asked}), c.value) as rn
                  from lt_walk{k - 1} r left join lt_nodes{k} c on c.parent = r.node and r.split_attr is not null) where rn = 1"""
    return levels


# ---- Binary trees -----------------------------------------------------------------------------


def _cost(kind: str, side: str, stats: Sequence[str]) -> str:
    parts = [f"cast({side}{s} as double)" for s in stats]
    n = parts[0] if kind == "squared" else "(" + " + ".join(parts) + ")"
    if kind == "squared":
        value = f"{parts[2]} - {parts[1]} * {parts[1]} / {n}"
    elif kind == "gini":
        value = f"{n} - (" + " + ".join(f"{p} * {p}" for p in parts) + f") / {n}"
    else:
        value = f"{n} * log2({n}) - (" + " + ".join(f"case when {p} > 0 then {p} * log2({p}) else 0 end" for p in parts) + ")"
    return f"round(case when {n} > 0 then {value} else 0 end, 9)"


def _by_kind(kinds: Sequence[str], side: str, stats: Sequence[str]) -> str:
    return "case criterion " + " ".join(f"when '{k}' then {_cost(k, side, stats)}" for k in kinds) + " end"


def binary_trees(p: str, rows: str, specs: str, width: int, stats: Sequence[str], kinds: Sequence[str], classes: Sequence[float], depth: int, some: bool = False) -> None:
    """Nodes {p}_n0 .. of trees over ``rows`` (g, vals, statistics), limits in ``specs`` (g, criterion, ...).

    ``some``: not all features are tried at a node.
    """
    cols = ", ".join(stats)
    n_of = lambda side: f"{side}n" if not classes else "(" + " + ".join(f"{side}{s}" for s in stats) + ")"
    CTES[f"{p}_r0"] = f"select g, cast(1 as bigint) as id, vals, {cols} from {rows}"
    CTES[f"{p}_specs"] = specs
    name = lambda f: f"md5(g || '/' || id || '/' || {f}) || '/' || {f}"
    rank = f"list_position(list_sort([{', '.join(name(i) for i in range(width))}]), {name('f')}) - 1"
    if classes:
        values = "[" + ", ".join(repr(float(c)) for c in classes) + "]"
        ks = "[" + ", ".join(f"cast(t_{s} as bigint)" for s in stats) + "]"
        said = f"cast({values}[list_position({ks}, list_max({ks}))] as double)"
    else:
        said = "cast(t_s as double) / cast(t_n as double)"
    for k in range(depth + 1):
        hist = f"""
            select g, id, f, v, {', '.join(f'sum({s}) as {s}' for s in stats)}
            from (select g, id, unnest(range({width})) as f, unnest(vals) as v, {cols} from {p}_r{k}) group by all"""
        runs = f"""
            select g, id, f, v, lead(v) over o as nxt,
                   {', '.join(f'sum({s}) over (partition by g, id, f order by v rows between unbounded preceding and current row) as l_{s}' for s in stats)},
                   {', '.join(f'sum({s}) over (partition by g, id, f) as t_{s}' for s in stats)}
            from ({hist}) window o as (partition by g, id, f order by v)"""
        CTES[f"{p}_n{k}"] = f"""
            select g, id, {k} as level, n, predict, case when open then f end as f, case when open then (v + nxt) / 2 end as threshold
            from (select g, id, f, v, nxt, {n_of('t_')} as n, {said} as predict,
                         {k} < max_depth and {n_of('t_')} >= min_split and {_by_kind(kinds, 't_', stats)} > 0 and valid as open,
                         row_number() over (partition by g, id order by valid desc, turn, rest, f, v) as rn
                  from (select *, nxt is not null and {n_of('l_')} >= min_leaf and {n_of('r_')} >= min_leaf as valid,
                               round({_by_kind(kinds, 'l_', stats)} + {_by_kind(kinds, 'r_', stats)}, 9) as rest,
                               case when place < tried then 0 else place end as turn
                        from (select c.*, s.* exclude (g), {rank if some else '0'} as place,
                                     {', '.join(f't_{s} - l_{s} as r_{s}' for s in stats)}
                              from ({runs}) c join {p}_specs s using (g))))
            where rn = 1"""
        CTES[f"{p}_r{k + 1}"] = f"""
            select r.g, r.id * 2 + cast(r.vals[n.f + 1] > n.threshold as bigint) as id, r.vals, {', '.join('r.' + s for s in stats)}
            from {p}_r{k} r join {p}_n{k} n on n.g = r.g and n.id = r.id and n.f is not null"""


def walked(p: str, asked: str, depth: int) -> None:
    """{p}_visits: every node (level, predict, up: samples of the parent) that (g, vals) of ``asked`` passes."""
    CTES[f"{p}_w0"] = f"select g, vals, cast(1 as bigint) as id, cast(null as bigint) as up from {asked}"
    for k in range(depth + 1):
        CTES[f"{p}_v{k}"] = f"""
            select w.g, w.vals, {k} as level, n.predict, w.up, n.n, n.f, n.threshold, w.id
            from {p}_w{k} w join {p}_n{k} n on n.g = w.g and n.id = w.id"""
        CTES[f"{p}_w{k + 1}"] = f"""
            select g, vals, id * 2 + cast(vals[f + 1] > threshold as bigint) as id, cast(n as bigint) as up from {p}_v{k} where f is not null"""
    CTES[f"{p}_visits"] = " union all ".join(f"select g, vals, level, predict, up from {p}_v{k}" for k in range(depth + 1))


def _counts(classes: Sequence[float], weight: str = "1") -> str:
    return ", ".join(f"cast(sum(case when value = {float(c)!r} then {weight} else 0 end) as bigint) as k{i}" for i, c in enumerate(classes))


def add(w: str, cpt: Sequence[str], externals: Sequence[str], classes: Sequence[float], forest: int, grid: tuple, key: str, bin_of, label_of) -> None:
    """All expressions and queries. ``w``: the window as text; ``bin_of``: a speed column's bin; ``label_of``: its label."""
    _multiway([cpt[:3], cpt[3:4], cpt[4:]], externals, "tree_train")
    SQL["level_tree_fit"] = """select node, parent, attr, round(value, 6) as value, label, round(confidence, 6) as confidence, support, level,
        split_attr from lt_tree"""
    SQL["level_tree_predict"] = f"select {w}, x, y, round(value, 6) as value, predict from lt_walk{len(cpt) + len(externals)}"

    features = [*cpt, *externals]
    vals = "[" + ", ".join(f"cast({f} as double)" for f in features) + "]"
    stats = [f"k{i}" for i in range(len(classes))]
    one = "select 0 as g, '{0}' as criterion, {1} as max_depth, {2} as min_split, {3} as min_leaf, {4} as tried"

    # One tree of classes.
    CTES["dt_rows"] = f"select 0 as g, {vals} as vals, {_counts(classes)} from tree_train group by all"
    binary_trees("dt", "dt_rows", one.format("gini", 10, 4, 1, len(features)), len(features), stats, ["gini"], classes, 10)
    CTES["dt_asked"] = f"select distinct 0 as g, {vals} as vals from tree_test"
    walked("dt", "dt_asked", 10)
    SQL["dt_classifier"] = f"""select {w}, x, y, p.predict, value as real from tree_test t
        join (select vals, arg_max(predict, level) as predict from dt_visits group by vals) p on p.vals = {vals}"""

    # One tree of speeds, in whole millimetres a second.
    speeds = "[" + ", ".join([*[bin_of(c) for c in cpt], *[f"cast({e} as double)" for e in externals]]) + "]"
    y = "cast(round(value * 1000) as bigint)"
    CTES["rg_rows"] = f"""select 0 as g, {speeds} as vals, count(*) as n, cast(sum({y}) as bigint) as s, cast(sum({y} * {y}) as bigint) as q
        from speed_train group by all"""
    binary_trees("rg", "rg_rows", one.format("squared", 10, 4, 1, len(features)), len(features), ["n", "s", "q"], ["squared"], (), 10)
    CTES["rg_asked"] = f"select distinct 0 as g, {speeds} as vals from speed_test"
    walked("rg", "rg_asked", 10)
    SQL["dt_regressor"] = f"""select {w}, x, y, round(p.predict / 1000, 6) as predict, round(value, 6) as real from speed_test t
        join (select vals, arg_max(predict, level) as predict from rg_visits group by vals) p on p.vals = {speeds}"""

    SQL["trips_to_score_tree"] = f"""
        select round(sqrt(avg(pow(p.predict / 1000 - value, 2))), 6) as rmse, count(*) as "values",
               round(avg(cast({label_of('round(p.predict / 1000, 6)')} = {label_of('round(value, 6)')} as integer)), 6) as label_accuracy
        from speed_test t join (select vals, arg_max(predict, level) as predict from rg_visits group by vals) p on p.vals = {speeds}"""

    # A forest.
    below = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    bag = " + ".join(f"cast(u >= cast('{b!r}' as double) as bigint)" for b in below)
    CTES["rf_bags"] = f"""select *, {bag} as weight from (
        select t.*, cast(g as bigint) as g, cast(cast('0x' || substr(md5({key} || '/' || g), 1, 8) as bigint) as double) / 4294967296 as u
        from tree_train t, range({forest}) trees(g))"""
    CTES["rf_rows"] = f"select g, {vals} as vals, {_counts(classes, 'weight')} from rf_bags where weight > 0 group by all"
    each = "select g, 'entropy' as criterion, 10 as max_depth, 2 as min_split, 2 as min_leaf, {} as tried from range({}) trees(g)"
    binary_trees("rf", "rf_rows", each.format(max(1, int(math.sqrt(len(features)))), forest), len(features), stats, ["entropy"], classes, 10, some=True)
    CTES["rf_asked"] = f"select distinct g, {vals} as vals from tree_test, range({forest}) trees(g)"
    walked("rf", "rf_asked", 10)
    CTES["rf_votes"] = """select vals, predict, row_number() over (partition by vals order by count(*) desc, predict) as rn
        from (select g, vals, arg_max(predict, level) as predict from rf_visits group by g, vals) group by vals, predict"""
    SQL["rf_classifier"] = f"select {w}, x, y, p.predict, value as real from tree_test t join rf_votes p on p.vals = {vals} and p.rn = 1"

    # Choices over blocks of time.
    criteria, depths, splits, leaves, folds = grid
    deepest = 4 * len(cpt) + len(externals)
    choices = [(c, leaf) for c in criteria for leaf in leaves]
    CTES["gs_ranks"] = f"""select w, (row_number() over (order by w) - 1) * {folds} // count(*) over () as fold
        from (select distinct w from tree_train)"""
    CTES["gs_counts"] = f"select fold, {vals} as vals, {_counts(classes)} from tree_train join gs_ranks using (w) group by all"
    CTES["gs_trees"] = " union all ".join(
        f"select {i * folds + f} as g, {f} as fold, '{c}' as criterion, {leaf} as min_leaf" for i, (c, leaf) in enumerate(choices) for f in range(folds)
    )
    CTES["gs_rows"] = f"""select g, vals, {', '.join(f'cast(sum({s}) as bigint) as {s}' for s in stats)}
        from gs_trees t join gs_counts c on c.fold <> t.fold group by g, vals"""
    spec = f"select g, criterion, 61 as max_depth, {min(splits)} as min_split, min_leaf, {len(features)} as tried from gs_trees"
    binary_trees("gs", "gs_rows", spec, len(features), stats, list(criteria), classes, deepest)
    CTES["gs_asked"] = "select g, vals from gs_trees t join gs_counts c on c.fold = t.fold"
    walked("gs", "gs_asked", deepest)
    CTES["gs_cuts"] = " union all ".join(f"select {'cast(null as integer)' if d is None else d} as max_depth, {s} as min_split" for d in depths for s in splits)
    right = " + ".join(f"case when predict = {float(c)!r} then k{i} else 0 end" for i, c in enumerate(classes))
    SQL["grid_search"] = f"""
        select criterion, max_depth, min_split, min_leaf, round(avg(score), 6) as accuracy
        from (select p.g, p.max_depth, p.min_split, t.criterion, t.min_leaf, sum({right}) / sum({' + '.join(stats)}) as score
              from (select g, vals, max_depth, min_split, arg_max(predict, level) as predict
                    from gs_visits v join gs_cuts on (max_depth is null or level <= max_depth) and (level = 0 or up >= min_split)
                    group by g, vals, max_depth, min_split) p
              join gs_trees t on t.g = p.g join gs_counts c on c.fold = t.fold and c.vals = p.vals
              group by p.g, p.max_depth, p.min_split, t.criterion, t.min_leaf)
        group by criterion, max_depth, min_split, min_leaf"""


def add_sweep(p: str, kind: str, source: str, lags: Sequence[str], tail: int, bin_of) -> str:
    """One row of a sweep: the error of a tree over binned lags of ``source`` on its last windows."""
    vals = "[" + ", ".join(bin_of(c) for c in lags) + "]"
    y = "cast(round(value * 1000) as bigint)"
    CTES[f"{p}_source"] = source
    CTES[f"{p}_late"] = f"select *, dense_rank() over (order by w desc) as late from {p}_source"
    CTES[f"{p}_rows"] = f"""select 0 as g, {vals} as vals, count(*) as n, cast(sum({y}) as bigint) as s, cast(sum({y} * {y}) as bigint) as q
        from {p}_late where late > {tail} group by all"""
    spec = f"select 0 as g, 'squared' as criterion, 10 as max_depth, 4 as min_split, 1 as min_leaf, {len(lags)} as tried"
    binary_trees(p, f"{p}_rows", spec, len(lags), ["n", "s", "q"], ["squared"], (), 10)
    CTES[f"{p}_asked"] = f"select distinct 0 as g, {vals} as vals from {p}_late where late <= {tail}"
    walked(p, f"{p}_asked", 10)
    return f"""select '{kind}' as kind, {len(lags)} as length, 'tree' as method, round(sqrt(avg(pow(p.predict / 1000 - value, 2))), 6) as rmse
        from {p}_late t join (select vals, arg_max(predict, level) as predict from {p}_visits group by vals) p on p.vals = {vals}
        where late <= {tail}"""
