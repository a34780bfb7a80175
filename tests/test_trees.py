"""The level-wise tree against a plain recursive one, and information measures."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from roadpulse.operators import information, trees

ATTRS = ["c1", "c2", "p1", "t1", "e1"]


def samples(seed=5, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c1, c2, p1, t1, e1 = (float(rng.randrange(4)) for _ in range(5))
        label = int(c1) if rng.random() < 0.6 else int(p1 + e1) % 4
        rows.append((c1, c2, p1, t1, e1, label))
    return rows


def h(labels):
    n = len(labels)
    return -sum(c / n * math.log2(c / n) for c in Counter(labels).values())


def grow(rows, used, path="root"):
    """node -> (label, split) of the tree over ``rows``."""
    labels = [r[5] for r in rows]
    top = min(Counter(labels).items(), key=lambda kv: (-kv[1], kv[0]))
    nodes = {path: (top[0], None)}
    if top[1] / len(rows) > 0.9 or len(rows) <= 10:
        return nodes
    options = [["c1", "c2"][used["c"]]] if used["c"] < 2 else []
    options += [name for name in ("p1", "t1", "e1") if name not in used["names"]]
    if not options:
        return nodes

    def rest(name):
        i = ATTRS.index(name)
        parts = Counter(r[i] for r in rows)
        return round(sum(n * h([r[5] for r in rows if r[i] == v]) for v, n in parts.items()) / len(rows), 12)

    best = min(options, key=lambda name: (rest(name), ATTRS.index(name)))
    nodes[path] = (top[0], best)
    i = ATTRS.index(best)
    below = {"c": used["c"] + (best[0] == "c"), "names": used["names"] | {best}}
    for v in sorted({r[i] for r in rows}):
        nodes |= grow([r for r in rows if r[i] == v], below, f"{path}/{best}={v}")
    return nodes


def walk(nodes, row):
    path = "root"
    while nodes[path][1]:
        attr = nodes[path][1]
        prefix = f"{path}/{attr}="
        values = sorted(float(k[len(prefix):]) for k in nodes if k.startswith(prefix) and "/" not in k[len(prefix):])
        near = min(values, key=lambda v: (abs(v - row[ATTRS.index(attr)]), v))
        path = f"{prefix}{near}"
    return nodes[path][0]


@pytest.fixture(scope="module")
def tree(spark):
    rows = samples()
    df = spark.createDataFrame(rows, ", ".join(f"{a} double" for a in ATTRS) + ", label int")
    nodes = trees.level_tree_fit(df, ["c1", "c2"], ["p1"], ["t1"], ["e1"])
    return rows, nodes, grow(rows, {"c": 0, "names": set()})


def test_fit_matches_a_plain_tree(tree):
    _, nodes, plain = tree
    assert {r["node"]: (r["label"], r["split_attr"]) for r in nodes.collect()} == plain


def test_predict_matches_a_plain_walk(spark, tree):
    _, nodes, plain = tree
    asked = [(k, *r[:5]) for k, r in enumerate(samples(9, 120))]
    asked += [(1000 + k, 0.5 + k, 1.5, 9.0, -1.0, 2.5) for k in range(4)]
    df = spark.createDataFrame(asked, "id int, " + ", ".join(f"{a} double" for a in ATTRS))
    got = {r["id"]: r["predict"] for r in trees.level_tree_predict(df, nodes, ATTRS).collect()}
    assert got == {r[0]: walk(plain, r[1:]) for r in asked}


def test_a_pure_sample_is_one_leaf(spark):
    df = spark.createDataFrame([(1.0, 2)] * 20, "c1 double, label int")
    nodes = trees.level_tree_fit(df, ["c1"], [], [])
    assert [(r["node"], r["label"], r["split_attr"]) for r in nodes.collect()] == [("root", 2, None)]
    assert trees.level_tree_predict(df, nodes, ["c1"]).first()["predict"] == 2


def test_entropy(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 4, 3, 4, 5, 1, 1, 1, 9]], "label int")
    assert information.entropy(df, "label").first()[0] == pytest.approx(2.321928094887362)


def test_gain(spark):
    rows = samples(1, 100)
    df = spark.createDataFrame([(r[0], r[5]) for r in rows], "a double, label int")
    want = h([r[5] for r in rows]) - sum(
        len(part) / 100 * h(part) for v in range(4) if (part := [r[5] for r in rows if r[0] == v])
    )
    assert information.information_gain(df, "a", "label").first()["gain"] == pytest.approx(want)


def test_majority_takes_the_smaller_of_equal_labels(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (2, 5)], "k int, label int")
    got = sorted(tuple(r) for r in information.majority_label(df, ["k"], "label").collect())
    assert got == [(1, 2, 0.5, 4), (2, 5, 1.0, 1)]
