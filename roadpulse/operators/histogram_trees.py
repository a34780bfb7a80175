"""Binary decision trees and forests grown from histograms of counted tuples.

Many trees grow together, level by level, each known by a group number ``g``: those of a forest,
of cross-validation folds, of parameter choices. Samples are read once and become distinct feature
tuples per group with the statistics of their targets: counts per class, or number, sum and sum of
squares. A level is one pass over the tuples: sums per (group, node, feature, value), running sums
along the values and the best split per node. Continuous features are binned before, so a
histogram has a bounded number of values.

A node splits while it is deeper than no limit, has ``min_split`` samples, is not pure and has a
split that leaves ``min_leaf`` on both sides. The split of least remaining cost wins, of equals
that of the first feature and the least value; its threshold lies half way between neighbouring
values of the node. Missing values count as lower than any other.

Costs: Gini and entropy of class counts, absolute deviation from the best of the class values
(targets in bins), and squared deviation from the mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.operators.panel import panel_times, rank_windows
from roadpulse.session import stage

#: Stands for a missing feature value.
LOWEST = -1e300
#: Node numbers double from level to level; a long holds so many levels.
DEEPEST = 61
#: Places to which costs are rounded, so that equal splits stay equal.
PLACES = 9


@dataclass(frozen=True)
class Tree:
    """How a tree grows. ``tried``: features tried per node (None: all), more only if none of them splits."""

    criterion: str = "gini"
    max_depth: int | None = 10
    min_split: int = 2
    min_leaf: int = 1
    tried: int | None = None


# ---- Statistics of targets --------------------------------------------------------------------


def class_columns(classes: Sequence[float]) -> list[str]:
    return [f"k{i}" for i in range(len(classes))]


SUM_COLUMNS = ["n", "s", "q"]


def class_counts(target: Column, classes: Sequence[float], weight: Column) -> list[Column]:
    return [F.sum(F.when(target == F.lit(float(c)), weight).otherwise(F.lit(0))).cast("long").alias(f"k{i}") for i, c in enumerate(classes)]


def target_sums(target: Column, weight: Column) -> list[Column]:
    """Number, sum and sum of squares of a whole-number target."""
    y = target.cast("long")
    return [F.sum(x).cast("long").alias(name) for name, x in zip(SUM_COLUMNS, (weight, weight * y, weight * y * y), strict=True)]


def _total(stats: list[Column], criterion: str) -> Column:
    return stats[0] if criterion == "squared" else reduce(lambda a, b: a + b, stats)


def cost(stats: list[Column], criterion: str, classes: Sequence[float] = ()) -> Column:
    """Impurity times number; 0 without samples."""
    n = _total(stats, criterion).cast("double")
    parts = [s.cast("double") for s in stats]
    if criterion == "squared":
        value = parts[2] - parts[1] * parts[1] / n
    elif criterion == "gini":
        value = n - reduce(lambda a, b: a + b, [p * p for p in parts]) / n
    elif criterion == "entropy":
        value = n * F.log2(n) - reduce(lambda a, b: a + b, [F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)) for p in parts])
    elif criterion == "absolute":
        value = F.array_min(F.array(*[_deviation(parts, classes, c) for c in classes]))
    else:
        raise ValueError(criterion)
    return F.round(F.when(n > 0, value).otherwise(F.lit(0.0)), PLACES)


def _deviation(parts: list[Column], classes: Sequence[float], middle: float) -> Column:
    return reduce(lambda a, b: a + b, [p * abs(float(c) - float(middle)) for p, c in zip(parts, classes, strict=True)])


def outcome(stats: list[Column], criterion: str, classes: Sequence[float] = ()) -> Column:
    """What a node predicts: the most frequent class, the best middle, or the mean; the smaller of equals."""
    if criterion == "squared":
        return stats[1].cast("double") / stats[0].cast("double")
    parts = [s.cast("double") for s in stats]
    weighed = [_deviation(parts, classes, c) if criterion == "absolute" else -p for p, c in zip(parts, classes, strict=True)]
    options = F.array(*[F.struct(v.alias("v"), F.lit(float(c)).alias("c")) for v, c in zip(weighed, classes, strict=True)])
    return F.array_min(options)["c"]


# ---- Tuples -----------------------------------------------------------------------------------


def feature_values(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(LOWEST)) for f in features])


def binned(column: Column, width: float) -> Column:
    """A continuous feature in bins of equal width, as their lower limits."""
    return F.floor(column / width) * F.lit(float(width))


def tuples(samples: DataFrame, features: Sequence[str], stats: list[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, vals) with statistics, stored."""
    return stage(samples.groupBy(*keys, feature_values(features).alias("vals")).agg(*stats), "tree-tuples")


def poisson_weight(key: Column, tree: Column, most: int = 8) -> Column:
    """How often a row is in a tree's bag: Poisson with mean one from a hash of the row's key and the tree."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), tree.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    below = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(most)]
    return reduce(lambda a, b: a + b, [(u >= F.lit(b)).cast("long") for b in below])


def _rank(f: Column, width: int) -> Column:
    """A feature's place in the random order of its node's features."""
    name = lambda c: F.concat(F.md5(F.concat_ws("/", F.col("g").cast("string"), F.col("id").cast("string"), c).cast("binary")), F.lit("/"), c)
    order = F.array_sort(F.array(*[name(F.lit(str(i))) for i in range(width)]))
    return F.array_position(order, name(f.cast("string"))) - 1


# ---- Growing ----------------------------------------------------------------------------------


def grow(rows: DataFrame, trees: dict[int, Tree], width: int, classes: Sequence[float] = ()) -> DataFrame:
    """Nodes (g, id, level, n, predict, cost, feature, threshold) of all trees, from (g, vals, statistics).

    ``classes`` are the target values of class counts; without them statistics are sums. The root
    is 1, the children of ``id`` are 2 ``id`` (up to the threshold) and 2 ``id`` + 1. A leaf's
    feature is null.
    """
    names = class_columns(classes) if classes else SUM_COLUMNS
    limits = [
        (g, t.criterion, min(t.max_depth if t.max_depth is not None else DEEPEST, DEEPEST), t.min_split, t.min_leaf, t.tried or width)
        for g, t in sorted(trees.items())
    ]
    specs = rows.sparkSession.createDataFrame(limits, "g long, criterion string, max_depth int, min_split long, min_leaf long, tried int")
    kinds = sorted({t.criterion for t in trees.values()})
    some = any(t.tried is not None and t.tried < width for t in trees.values())
    deepest = max(limit[2] for limit in limits)

    def by_kind(make) -> Column:
        if len(kinds) == 1:
            return make(kinds[0])
        return F.coalesce(*[F.when(F.col("criterion") == k, make(k)) for k in kinds])

    rows = rows.select(F.col("g").cast("long").alias("g"), F.lit(1).cast("long").alias("id"), "vals", *names)
    levels: list[DataFrame] = []
    while True:
        level = len(levels)
        long = rows.select("g", "id", F.posexplode("vals").alias("f", "v"), *names)
        hist = long.groupBy("g", "id", "f", "v").agg(*[F.sum(n).alias(n) for n in names])
        # A histogram has as many rows as the feature has values in the node.
        own = W.partitionBy("g", "id", "f")
        upto = own.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        runs = hist.select(
            "g", "id", "f", "v",
            F.lead("v").over(own.orderBy("v")).alias("next"),
            *[F.sum(n).over(upto).alias(f"l_{n}") for n in names],
            *[F.sum(n).over(own).alias(f"t_{n}") for n in names],
        ).join(specs, "g")
        left, total = ([F.col(f"{side}_{n}") for n in names] for side in "lt")
        right = [t - s for t, s in zip(total, left, strict=True)]
        rest = by_kind(lambda k: F.round(cost(left, k, classes) + cost(right, k, classes), PLACES))
        valid = F.col("next").isNotNull() & (_total(left, kinds[0]) >= F.col("min_leaf")) & (_total(right, kinds[0]) >= F.col("min_leaf"))
        rank = _rank(F.col("f"), width) if some else F.lit(0).cast("long")
        turn = F.when(rank < F.col("tried"), F.lit(0).cast("long")).otherwise(rank)
        split = F.struct(turn.alias("turn"), rest.alias("rest"), "f", "v", ((F.col("v") + F.col("next")) / 2).alias("threshold"))
        found = runs.groupBy("g", "id").agg(
            *[F.first(f"t_{n}").alias(n) for n in names],
            *[F.first(c).alias(c) for c in ("criterion", "max_depth", "min_split")],
            F.min(F.when(valid, split)).alias("best"),
        )
        stats = [F.col(n) for n in names]
        number = _total(stats, kinds[0])
        worth = by_kind(lambda k: cost(stats, k, classes))
        is_open = (F.lit(level) < F.col("max_depth")) & (number >= F.col("min_split")) & (worth > 0) & F.col("best").isNotNull()
        nodes = found.select(
            "g", "id", F.lit(level).alias("level"), number.alias("n"),
            by_kind(lambda k: outcome(stats, k, classes)).alias("predict"), worth.alias("cost"),
            F.when(is_open, F.col("best.f")).alias("feature"), F.when(is_open, F.col("best.threshold")).alias("threshold"),
        )
        levels.append(stage(nodes, "tree-nodes"))
        if level >= deepest:
            break
        splits = levels[-1].filter("feature is not null").select("g", "id", "feature", "threshold")
        upper = (F.get("vals", F.col("feature")) > F.col("threshold")).cast("long")
        rows = rows.join(splits, ["g", "id"]).select("g", (F.col("id") * 2 + upper).alias("id"), "vals", *names)
        rows = stage(rows, "tree-rows")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def walked(asked: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Add ``predict`` of (g, vals): level by level, all in one plan."""
    if depth is None:
        # Without training samples there are no nodes and nothing is predicted.
        depth = nodes.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
    rows = asked.withColumn("id", F.lit(1).cast("long")).withColumn("predict", F.lit(None).cast("double"))
    for level in range(depth + 1):
        own = nodes.filter(F.col("level") == level).select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("predict").alias("_p"), "feature", "threshold")
        rows = rows.join(own, (F.col("g") == F.col("_g")) & (F.col("id") == F.col("_id")), "left")
        upper = (F.get("vals", F.col("feature")) > F.col("threshold")).cast("long")
        rows = rows.withColumns({"predict": F.coalesce("_p", "predict"), "id": F.when(F.col("feature").isNotNull(), F.col("id") * 2 + upper)})
        rows = rows.drop("_g", "_id", "_p", "feature", "threshold")
    return rows.drop("id")


# ---- Models -----------------------------------------------------------------------------------


def fit_tree(samples: DataFrame, features: Sequence[str], target: str, tree: Tree, classes: Sequence[float] = ()) -> DataFrame:
    """Nodes of one tree (g = 0)."""
    y, one = F.col(target), F.lit(1).cast("long")
    stats = class_counts(y, classes, one) if classes else target_sums(y, one)
    rows = tuples(samples, features, stats).withColumn("g", F.lit(0).cast("long"))
    return grow(rows, {0: tree}, len(features), classes)


def predict(samples: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``predict``; distinct tuples walk and samples look theirs up. Several trees vote, the smaller of equals."""
    groups = [r.g for r in nodes.select("g").distinct().orderBy("g").collect()] or [0]
    named = samples.withColumn("_vals", feature_values(features))
    asked = stage(named.select(F.col("_vals").alias("vals")).distinct(), "tree-asked")
    each = asked.withColumn("g", F.explode(F.array(*[F.lit(g).cast("long") for g in groups])))
    votes = walked(each, nodes)
    if len(groups) > 1:
        votes = votes.groupBy("vals", "predict").agg(F.count(F.lit(1)).alias("n"))
        votes = votes.groupBy("vals").agg(F.max_by("predict", F.struct("n", -F.col("predict"))).alias("predict"))
    votes = votes.select(F.col("vals").alias("_vals"), "predict")
    return named.join(votes, "_vals", "left").drop("_vals")


def _bags(samples: DataFrame, key: Column, trees: int) -> DataFrame:
    numbered = samples.withColumn("_key", key).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("g"))
    return numbered.withColumn("_weight", poisson_weight(F.col("_key"), F.col("g")))


def fit_forest(samples: DataFrame, features: Sequence[str], target: str, key: Column, trees: int, tree: Tree, classes: Sequence[float]) -> DataFrame:
    """Nodes of a forest, g = 0 .. trees - 1; ``key`` is a row's own text, so bags don't depend on partitions."""
    bags = _bags(samples, key, trees).filter("_weight > 0")
    rows = tuples(bags, features, class_counts(F.col(target), classes, F.col("_weight")), ["g"])
    tried = tree.tried or max(1, int(math.sqrt(len(features))))
    own = Tree(tree.criterion, tree.max_depth, tree.min_split, tree.min_leaf, tried)
    return grow(rows, {g: own for g in range(trees)}, len(features), classes)


def out_of_bag_accuracy(samples: DataFrame, nodes: DataFrame, features: Sequence[str], target: str, key: Column, trees: int) -> DataFrame:
    """One row: accuracy of votes by the trees that did not see a row, and how many rows have such votes."""
    left = _bags(samples, key, trees).filter("_weight = 0").withColumn("vals", feature_values(features))
    found = walked(left.select("vals", F.col("g").cast("long").alias("g")).distinct(), nodes)
    votes = left.select("_key", "g", "vals", F.col(target).cast("double").alias("real")).join(found, ["g", "vals"])
    votes = votes.groupBy("_key", "real", "predict").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("_key", "real").agg(F.max_by("predict", F.struct("n", -F.col("predict"))).alias("predict"))
    return top.agg(F.avg((F.col("predict") == F.col("real")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def grid_search(
    samples: DataFrame,
    features: Sequence[str],
    target: str,
    criteria: Sequence[str],
    depths: Sequence[int | None],
    splits: Sequence[int],
    leaves: Sequence[int],
    folds: int = 3,
    classes: Sequence[float] = (),
) -> DataFrame:
    """(criterion, max_depth, min_split, min_leaf, score) of every choice, over blocks of time as folds.

    The score is the mean over folds of the accuracy, or of the negative mean squared error where
    there are no classes. A tree for (criterion, leaf, fold) is grown to the end once: a depth limit
    or a larger split size only cuts it, so these choices read their prediction on the way down.
    """
    ranks = rank_windows(panel_times(samples))
    total = ranks.agg(F.count(F.lit(1))).scalar()
    placed = samples.join(ranks, "w").withColumn("fold", F.floor(F.col("pos") * folds / total).cast("int"))
    y, one = F.col(target), F.lit(1).cast("long")
    names = class_columns(classes) if classes else SUM_COLUMNS
    counted = tuples(placed, features, class_counts(y, classes, one) if classes else target_sums(y, one), ["fold"])

    choices = [(c, leaf) for c in criteria for leaf in leaves]
    trees = {i * folds + fold: Tree(c, None, min(splits), leaf) for i, (c, leaf) in enumerate(choices) for fold in range(folds)}
    held = counted.select("vals", "fold", *names, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("out"))
    others = held.filter("fold <> out").groupBy("out", "vals").agg(*[F.sum(n).alias(n) for n in names])
    every = F.explode(F.sequence(F.lit(0), F.lit(len(choices) - 1))).alias("choice")
    number = (F.col("choice") * folds + F.col("out")).cast("long").alias("g")
    nodes = grow(others.select("*", every).select(number, "vals", *names), trees, len(features), classes)

    cuts = [(d, s) for d in depths for s in splits]
    asked = counted.select(F.col("fold").alias("out"), "vals", *names, every).select(number, "vals", *names)
    rows = asked.withColumns({"id": F.lit(1).cast("long"), "said": F.array(*[F.lit(None).cast("double") for _ in cuts]), "up": F.lit(None).cast("long")})
    for level in range(nodes.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0] + 1):
        own = nodes.filter(F.col("level") == level).select(F.col("g").alias("_g"), F.col("id").alias("_id"), F.col("predict").alias("_p"), F.col("n").alias("_n"), "feature", "threshold")
        rows = rows.join(own, (F.col("g") == F.col("_g")) & (F.col("id") == F.col("_id")), "left")
        # A choice comes here if the depth and the parent's size allowed the split.
        here = [F.lit(level == 0) | (F.lit(d is None or level <= d) & (F.col("up") >= s)) for d, s in cuts]
        said = F.array(*[F.when(F.col("_p").isNotNull() & h, F.col("_p")).otherwise(F.col("said")[i]) for i, h in enumerate(here)])
        upper = (F.get("vals", F.col("feature")) > F.col("threshold")).cast("long")
        rows = rows.withColumns({"said": said, "id": F.when(F.col("feature").isNotNull(), F.col("id") * 2 + upper), "up": F.col("_n")})
        rows = rows.drop("_g", "_id", "_p", "_n", "feature", "threshold")
    rows = rows.select("g", *names, F.posexplode("said").alias("cut", "p"))
    if classes:
        right = reduce(lambda a, b: a + b, [F.when(F.col("p") == F.lit(float(c)), F.col(n)).otherwise(F.lit(0)) for n, c in zip(names, classes, strict=True)])
        score = F.sum(right) / F.sum(_total([F.col(n) for n in names], "gini"))
    else:
        score = -F.sum(F.col("q") - 2 * F.col("p") * F.col("s") + F.col("p") * F.col("p") * F.col("n")) / F.sum("n")
    scores = rows.groupBy("g", "cut").agg(score.alias("score"))
    kinds = samples.sparkSession.createDataFrame(
        [(i * folds + f, k, c, d, s, leaf) for i, (c, leaf) in enumerate(choices) for f in range(folds) for k, (d, s) in enumerate(cuts)],
        "g long, cut int, criterion string, max_depth int, min_split int, min_leaf int",
    )
    named = scores.join(kinds, ["g", "cut"])
    return named.groupBy("criterion", "max_depth", "min_split", "min_leaf").agg(F.avg("score").alias("score"))
