"""Histogram trees, forests and the grid search against plain recursive ones."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import histogram_trees as ht

FEATURES = ["a", "b", "c"]
CLASSES = [0.0, 1.0, 2.0, 3.0]


def rows_of(seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.randrange(5)), float(rng.randrange(3)) * 1.5, float(rng.randrange(2))
        y = float(min(3, int(a) // 2 + int(c))) if rng.random() < 0.8 else float(rng.randrange(4))
        rows.append((i, a, b if i % 17 else None, c, y))
    return rows


def weighed(values, criterion):
    """Cost of weighted targets [(y, weight)] and what they predict."""
    n = sum(w for _, w in values)
    count = Counter()
    for y, w in values:
        count[y] += w
    if criterion == "squared":
        mean = sum(y * w for y, w in values) / n
        return round(sum(w * (y - mean) ** 2 for y, w in values), 6), mean
    if criterion == "absolute":
        options = [(sum(w * abs(y - c) for y, w in values), c) for c in CLASSES]
        return round(min(options)[0], 6), min(options)[1]
    top = min(count.items(), key=lambda kv: (-kv[1], kv[0]))[0]
    if criterion == "gini":
        return round(n - sum(c * c for c in count.values()) / n, 6), top
    return round(-sum(c * math.log2(c / n) for c in count.values() if c), 6), top


def grow(rows, tree, g=0, node=1, level=0):
    """id -> (n, predict, feature, threshold); rows are (vals, y, weight)."""
    n = sum(w for *_, w in rows)
    worth, said = weighed([(y, w) for _, y, w in rows], tree.criterion)
    out = {node: (n, said, None, None)}
    if (tree.max_depth is not None and level >= tree.max_depth) or n < tree.min_split or worth <= 0:
        return out
    names = [str(i) for i in range(len(FEATURES))]
    order = sorted(hashlib.md5(f"{g}/{node}/{i}".encode()).hexdigest() + f"/{i}" for i in names)
    options = []
    for f in range(len(FEATURES)):
        rank = order.index(hashlib.md5(f"{g}/{node}/{f}".encode()).hexdigest() + f"/{f}")
        turn = 0 if tree.tried is None or rank < tree.tried else rank
        values = sorted({v[f] for v, *_ in rows})
        for low, high in zip(values, values[1:]):
            left, right = ([(y, w) for v, y, w in rows if (v[f] <= low) == side] for side in (True, False))
            if min(sum(w for _, w in left), sum(w for _, w in right)) >= tree.min_leaf:
                options.append((turn, round(weighed(left, tree.criterion)[0] + weighed(right, tree.criterion)[0], 4), f, low, (low + high) / 2))
    if not options:
        return out
    *_, f, _, threshold = min(options)
    out[node] = (n, said, f, threshold)
    for upper in (0, 1):
        out |= grow([r for r in rows if (r[0][f] > threshold) == bool(upper)], tree, g, 2 * node + upper, level + 1)
    return out


def plain(rows):
    return [((a, ht.LOWEST if b is None else b, c), y, 1) for _, a, b, c, y in rows]


def walk(nodes, vals, depth=None, split=0):
    node, level = 1, 0
    while nodes[node][2] is not None and (depth is None or level < depth) and nodes[node][0] >= split:
        node, level = 2 * node + int(vals[nodes[node][2]] > nodes[node][3]), level + 1
    return nodes[node][1]


def table(spark, rows):
    start = datetime(2024, 1, 1)
    rows = [(*r, start + timedelta(minutes=20 * (r[0] // 3))) for r in rows]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, y double, w timestamp")


def found(nodes):
    return {r.id: (r.n, pytest.approx(r.predict), r.feature, r.threshold) for r in nodes.collect()}


@pytest.mark.parametrize(
    "tree",
    [
        ht.Tree("gini", None, 2, 1),
        ht.Tree("entropy", 4, 30, 7),
        ht.Tree("absolute", 5, 4, 2),
        ht.Tree("squared", 6, 4, 1),
        ht.Tree("gini", 5, 2, 1, tried=1),
    ],
)
def test_a_tree_matches_a_plain_one(spark, tree):
    rows = rows_of()
    classes = () if tree.criterion == "squared" else CLASSES
    nodes = ht.fit_tree(table(spark, rows), FEATURES, "y", tree, classes)
    want = grow(plain(rows), tree)
    assert found(nodes) == want
    asked = rows_of(11, 60) + [(1000, 2.5, 9.0, -1.0, 0.0), (1001, None, 0.7, 0.5, 0.0)]
    got = {r.i: r.predict for r in ht.predict(table(spark, asked), nodes, FEATURES).collect()}
    for i, a, b, c, _ in asked:
        vals = tuple(ht.LOWEST if v is None else v for v in (a, b, c))
        assert got[i] == pytest.approx(walk(want, vals))


def bag(i, tree):
    u = int(hashlib.md5(f"{i}/{tree}".encode()).hexdigest()[:8], 16) / 2**32
    total, k = 0.0, 0
    while k < 8 and u >= (total := total + math.exp(-1) / math.factorial(k)):
        k += 1
    return k


def test_a_forest_matches_plain_trees_under_any_partitioning(spark):
    rows = rows_of(4, 200)
    key = F.col("i").cast("string")
    tree = ht.Tree("entropy", 4, 2, 2)
    df = table(spark, rows)
    nodes = ht.fit_forest(df.repartition(5), FEATURES, "y", key, 6, tree, CLASSES)
    again = ht.fit_forest(df.repartition(2, "a"), FEATURES, "y", key, 6, tree, CLASSES)
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    forest = []
    for g in range(6):
        bagged = [(v, y, bag(r[0], g)) for (v, y, _), r in zip(plain(rows), rows) if bag(r[0], g)]
        forest.append(grow(bagged, ht.Tree("entropy", 4, 2, 2, tried=1), g))
        assert found(nodes.filter(F.col("g") == g)) == forest[-1]

    def vote(vals, trees):
        return min(Counter(walk(forest[g], vals) for g in trees).items(), key=lambda kv: (-kv[1], kv[0]))[0]

    got = {r.i: r.predict for r in ht.predict(df, nodes, FEATURES).collect()}
    assert got == {r[0]: vote(v, range(6)) for r, (v, *_) in zip(rows, plain(rows))}
    left = {r[0]: [g for g in range(6) if not bag(r[0], g)] for r in rows}
    right = [vote(v, left[r[0]]) == y for r, (v, y, _) in zip(rows, plain(rows)) if left[r[0]]]
    score = ht.out_of_bag_accuracy(df, nodes, FEATURES, "y", key, 6).first()
    assert (score.rows, score.accuracy) == (len(right), pytest.approx(sum(right) / len(right)))


@pytest.mark.parametrize("classes", [CLASSES, ()])
def test_grid_search_cuts_the_same_trees(spark, classes):
    rows = rows_of(6, 240)
    criteria = ["gini", "entropy"] if classes else ["squared"]
    got = ht.grid_search(table(spark, rows), FEATURES, "y", criteria, [None, 2, 3], [2, 40], [1, 9], 3, classes).collect()
    assert len(got) == len(criteria) * 12
    windows = 80
    fold = {r[0]: (r[0] // 3) * 3 // windows for r in rows}
    for r in got:
        scores = []
        for f in range(3):
            train = [p for p, row in zip(plain(rows), rows) if fold[row[0]] != f]
            # Grown alone with its own limits, not cut from a larger tree.
            nodes = grow(train, ht.Tree(r.criterion, r.max_depth, r.min_split, r.min_leaf))
            held = [p for p, row in zip(plain(rows), rows) if fold[row[0]] == f]
            said = [(walk(nodes, v), y) for v, y, _ in held]
            scores.append(sum(p == y if classes else -((p - y) ** 2) for p, y in said) / len(said))
        assert r.score == pytest.approx(sum(scores) / 3), r
