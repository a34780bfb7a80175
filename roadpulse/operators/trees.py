"""A multiway decision tree grown level by level from counted tuples.

At a node the candidates are the next unused closeness lag, the next period lag, the next
trend lag and every external column not used on the path. The best gain wins, ties in that
order.

Samples are read once and become distinct (attributes, label) tuples with their numbers, the only
input of all levels. Nodes are known by a number, the hash of their parent, attribute and value; the
path stands beside it for readers. Prediction routes distinct tuples through a table of value
ranges per child, all levels in one plan, and joins the result back to the samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.operators.information import majority_of_counts, value_entropy
from roadpulse.session import stage

ROOT = "root"
ROOT_ID = 0


def _attribute(names: Sequence[str], chosen: Column) -> Column:
    """Value of the column whose name ``chosen`` holds."""
    value = F.lit(None).cast("double")
    for name in names:
        value = F.when(chosen == name, F.col(name)).otherwise(value)
    return value


def counted_tuples(samples: DataFrame, attrs: Sequence[str], label: str) -> DataFrame:
    """Distinct (attributes, label) with their number ``n``, stored."""
    values = [F.col(a).cast("double").alias(a) for a in attrs]
    rows = samples.select(*values, F.col(label).cast("int").alias("label"))
    return stage(rows.groupBy(*attrs, "label").agg(F.count(F.lit(1)).alias("n")), "tree-tuples")


def _candidates(families: Sequence[Sequence[str]], externals: Sequence[str]) -> Column:
    """What a tuple's node may split on, as (ord, attr, value).

    The first entry belongs to no attribute: its counts are those of the node itself.
    """
    names = [name for family in families for name in family] + list(externals)
    order = {name: i for i, name in enumerate(names)}

    def option(name: str) -> Column:
        return F.struct(F.lit(order[name]).alias("ord"), F.lit(name).alias("attr"), F.col(name).alias("value"))

    whole = F.struct(
        F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("double").alias("value")
    )
    options = [whole]
    # Lags of a family are used in order, so the number used so far names the next one.
    for i, family in enumerate(families):
        options += [F.when(F.col(f"used_{i}") == k, option(name)) for k, name in enumerate(family)]
    options += [F.when(~F.array_contains("used_externals", name), option(name)) for name in externals]
    return F.array_compact(F.array(*options))


def level_tree_fit(
    samples: DataFrame,
    closeness: Sequence[str],
    period: Sequence[str],
    trend: Sequence[str],
    externals: Sequence[str] = (),
    label: str = "label",
    max_c: int = 3,
    max_d: int = 1,
    max_w: int = 1,
    min_support: int = 10,
    min_confidence: float = 0.9,
) -> DataFrame:
    """Node table: id, parent_id, node, parent, attr and value of the branch, split_attr, label, support, level.

    A node becomes a leaf when its majority label exceeds ``min_confidence``, when it has no
    more than ``min_support`` samples, or when no candidate is left. A best gain of zero still
    splits. A missing attribute value is a value of its own.
    """
    families = [list(closeness)[:max_c], list(period)[:max_d], list(trend)[:max_w]]
    attrs = [*closeness, *period, *trend, *externals]
    used = [f"used_{i}" for i in range(3)]
    rows = counted_tuples(samples, attrs, label).withColumns(
        {
            "id": F.lit(ROOT_ID).cast("long"),
            **{name: F.lit(0) for name in used},
            "used_externals": F.array().cast("array<string>"),
        }
    )
    places = samples.sparkSession.range(1).select(
        F.lit(ROOT_ID).cast("long").alias("id"),
        F.lit(None).cast("long").alias("parent_id"),
        F.lit(ROOT).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("attr"),
        F.lit(None).cast("double").alias("value"),
    )

    levels: list[DataFrame] = []
    while True:
        level = len(levels)
        shown = rows.select("id", "label", "n", F.explode(_candidates(families, externals)).alias("option"))
        counts = stage(shown.groupBy("id", "option", "label").agg(F.sum("n").alias("n")), "tree-counts")

        nodes = majority_of_counts(counts.filter("option.ord < 0"), ["id"], "label").withColumn("level", F.lit(level))
        is_open = (F.col("confidence") <= min_confidence) & (F.col("support") > min_support)
        # Rounded, so that equal gains summed in another order stay equal.
        rest = F.round(F.sum(F.col("n") * F.col("entropy")) / F.sum("n"), 12).alias("rest")
        gains = value_entropy(counts.filter("option.ord >= 0"), ["id", "option"]).groupBy("id", "option.ord", "option.attr")
        best = gains.agg(rest).groupBy("id").agg(F.min_by("attr", F.struct("rest", "ord")).alias("split_attr"))
        nodes = places.join(nodes, "id").join(best, "id", "left")
        nodes = stage(nodes.withColumn("split_attr", F.when(is_open, F.col("split_attr"))), "tree-nodes")
        levels.append(nodes)

        splits = nodes.filter(F.col("split_attr").isNotNull()).select(F.col("id").alias("parent_id"), F.col("node").alias("parent"), F.col("split_attr").alias("attr"))
        if splits.isEmpty():
            break
        chosen = F.col("attr")
        child = F.xxhash64("parent_id", "attr", "value").alias("id")
        left = [(F.col(u) + chosen.isin(list(f)).cast("int")).alias(u) for u, f in zip(used, (closeness, period, trend), strict=True)]
        external = F.when(chosen.isin(list(externals)), F.array_append("used_externals", chosen)).otherwise(F.col("used_externals"))
        moved = rows.withColumnRenamed("id", "parent_id").join(splits.drop("parent"), "parent_id")
        moved = moved.withColumn("value", _attribute(attrs, chosen))
        rows = moved.select(*attrs, "label", "n", child, *left, external.alias("used_externals"))
        # The children are what the split attribute's counts tell.
        split = counts.filter("option.ord >= 0").select(F.col("id").alias("parent_id"), F.col("option.attr").alias("attr"), F.col("option.value").alias("value")).distinct()
        path = F.concat("parent", F.lit("/"), "attr", F.lit("="), F.coalesce(F.col("value").cast("string"), F.lit("none")))
        places = split.join(splits, ["parent_id", "attr"]).select(child, "parent_id", path.alias("node"), "parent", "attr", "value")
    return reduce(DataFrame.unionByName, levels)


def child_ranges(nodes: DataFrame) -> DataFrame:
    """(parent_id, level, low, high, child, split_attr, label): a child takes values above ``low`` up to ``high``.

    Limits lie half way between sorted children, so a value goes to the nearest child and of two
    equally near ones to the smaller. Missing values have no range.
    """
    # As many rows as an attribute has values among a node's samples.
    own = Window.partitionBy("parent_id").orderBy("value")
    half = lambda other: (F.col("value") + other) / 2
    children = nodes.filter(F.col("parent_id").isNotNull() & F.col("value").isNotNull())
    return children.select(
        "parent_id",
        "level",
        half(F.lag("value").over(own)).alias("low"),
        half(F.lead("value").over(own)).alias("high"),
        F.col("id").alias("child"),
        F.col("split_attr").alias("_split"),
        F.col("label").alias("_label"),
    )


def level_tree_predict(samples: DataFrame, nodes: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Add ``predict``: walk from the root to a leaf, at each split to the nearest child.

    Distinct attribute tuples walk; samples look their tuple up. A missing value ends the walk.
    """
    root = nodes.filter(F.col("id") == ROOT_ID).select("label", "split_attr").first()
    depth = nodes.agg(F.max("level")).first()[0]
    ranges = stage(child_ranges(nodes), "tree-ranges")
    values = [F.col(a).cast("double").alias(f"_{a}") for a in attrs]
    # Stored with its node, so that the first step joins by a column and not by a constant.
    tuples = stage(samples.select(*values).distinct().withColumn("id", F.lit(ROOT_ID).cast("long")), "tree-asked")
    rows = tuples.withColumns({"split_attr": F.lit(root["split_attr"]).cast("string"), "predict": F.lit(root["label"])})
    for level in range(1, depth + 1):
        asked = F.lit(None).cast("double")
        for a in attrs:
            asked = F.when(F.col("split_attr") == a, F.col(f"_{a}")).otherwise(asked)
        rows = rows.withColumn("_asked", asked)
        step = ranges.filter(F.col("level") == level).drop("level")
        fits = (F.col("low").isNull() | (F.col("_asked") > F.col("low"))) & (F.col("high").isNull() | (F.col("_asked") <= F.col("high")))
        rows = rows.join(step, (F.col("id") == F.col("parent_id")) & F.col("_asked").isNotNull() & fits, "left")
        rows = rows.withColumns(
            {"id": F.coalesce("child", "id"), "predict": F.coalesce("_label", "predict"), "split_attr": F.col("_split")}
        ).drop("parent_id", "low", "high", "child", "_split", "_label", "_asked")
    rows = rows.drop("id", "split_attr")
    same = reduce(lambda a, b: a & b, [F.col(a).cast("double").eqNullSafe(F.col(f"_{a}")) for a in attrs])
    return samples.join(rows, same, "left").drop(*[f"_{a}" for a in attrs])
