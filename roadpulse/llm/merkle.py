"""Merkle manifest of a dataset: a tree per source, a tree over the sources, proofs of every row.

A leaf is the hash of a row's fields. Leaves of a source ascend by ``doc_id`` and every 16 nodes in
a row, a run, are hashed into their parent until one is left, the source's subroot; subroots in
order of their sources give the root in the same way.

Places of the leaves come from a range partitioning by (source, doc_id, leaf, row number): rows are
numbered within each range and the counts of the ranges before are added, so a source with a third
of all rows, or rows that repeat, are spread over ranges. Every level is one window over runs:
lag and lead columns of fixed offsets, masked by the slot in the run and the run's length, give a
node its siblings, and the first child's row hashes the parent from its leads. On the way back
each node puts its own siblings before those of its parent, by a join on (source, run); a parent's
siblings are sent once for 16 children.

Only built-in expressions. Digests are stored as 32 bytes and hashed as hexadecimal text.

Defined results: null fields are hashed as ``-``; a null ``doc_id`` comes first in its source and
is never tampered; rows of equal ``doc_id`` are in the order of their leaves, and rows equal in
all fields take neighbouring places; a null source is a source, first in order; one row alone is
its own subroot, and one subroot the root, with an empty list of siblings. Other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.session import stage

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field_text(value: Column) -> Column:
    """A field as hashed: its UTF-8 byte count, a colon and its value, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return _hash(F.concat(*[field_text(f) for f in fields]))


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts null first."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in its group ``g`` by ``order``, and the group's number of rows ``n``."""
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    ranges = rows.repartitionByRange("g", *order, "_row").withColumn("_range", F.spark_partition_id())
    ranges = stage(ranges, "merkle-ranges")
    counts = ranges.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("g")
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(group).alias("n"))
    inside = Window.partitionBy("g", "_range").orderBy(*order, "_row")
    placed = ranges.withColumn("_k", F.row_number().over(inside) - 1).join(counts, ["g", "_range"])
    return placed.withColumn("idx", F.col("_first") + F.col("_k")).drop("_row", "_range", "_first", "_k")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes (g, idx, h, n) with run, slot and the digests of the siblings to the left and right, end to end."""
    nodes = nodes.withColumn("run", F.floor(F.col("idx") / arity)).withColumn("slot", F.col("idx") % arity)
    own = Window.partitionBy("g", "run").orderBy("idx")
    length = F.least(F.lit(arity), F.col("n") - F.col("run") * arity)
    lags = [F.when(F.col("slot") >= k, F.lag("h", k).over(own)) for k in range(arity - 1, 0, -1)]
    leads = [F.when(F.col("slot") + k < length, F.lead("h", k).over(own)) for k in range(1, arity)]
    left, right = (F.concat(*[F.coalesce(c, F.lit(b"")) for c in side]) for side in (lags, leads))
    return nodes.withColumn("left", left).withColumn("right", right)


def parents(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The next level of the groups with more than one node, from the rows of first children."""
    many = with_siblings(nodes.where("n > 1").select("g", "idx", "h", "n"), arity)
    digest = _hash(F.concat(_hex(F.col("h")), _hex(F.col("right"))))
    return many.where("slot = 0").select("g", F.col("run").alias("idx"), digest.alias("h"), F.ceil(F.col("n") / arity).alias("n"))


def grown(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels, each stored; a group's last node is where ``n`` is 1."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stage(parents(levels[-1], arity), "merkle-level"))
        most = -(-most // arity)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, h): the last node of each group."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("g", "h") for level in levels])


def paths(levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes of the lowest level with ``path``, the (left, right) of each level up, and the columns of ``above``.

    ``above`` has a row for each group: (g, path, ...), the path of the group's last node.
    """
    carried = [c for c in above.columns if c != "g"]
    found = None
    for level in reversed(levels):
        one = level.where("n = 1").join(above, "g")
        if found is None:
            found = one
            continue
        own = [F.col(c) for c in level.columns]
        up = found.select(F.col("g").alias("_g"), F.col("idx").alias("_run"), *[F.col(c).alias(f"_{c}") for c in carried])
        many = with_siblings(level.where("n > 1"), arity).join(up, (F.col("g") == F.col("_g")) & (F.col("run") == F.col("_run")))
        path = F.concat(F.array(F.struct("left", "right")), F.col("_path")).alias("path")
        many = many.select(*own, *[path if c == "path" else F.col(f"_{c}").alias(c) for c in carried])
        found = many.unionByName(one.select(*own, *carried))
    return found


def proof_text(path: Column) -> Column:
    """All siblings of a path as hexadecimal text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and a path give."""
    step = lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])).cast("binary"), 256)
    return F.aggregate(path, leaf, step)


@dataclass
class Manifest:
    """``levels``: stored nodes (g, idx, h, n) from the leaves up; ``sources``: the same over subroots; ``root``: hexadecimal."""

    levels: list[DataFrame]
    sources: list[DataFrame]
    root: str | None

    def proofs(self, arity: int = ARITY) -> DataFrame:
        """Leaves with all their columns, their source's ``subroot`` and ``path`` up to the root."""
        empty = F.array().cast("array<struct<left: binary, right: binary>>")
        over = self.sources[0].select("g").distinct().withColumn("path", empty)
        subroots = paths(self.sources, over, arity).select(F.col("source").alias("g"), "path", F.col("h").alias("subroot"))
        return paths(self.levels, subroots, arity)


def build(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of leaves (g, doc_id, h, ...)."""
    levels = grown(stage(numbered(leaves, ["doc_id", "h"]), "merkle-leaves"), arity)
    subroots = tops(levels).select(F.lit("root").alias("g"), F.col("g").alias("source"), "h")
    sources = grown(stage(numbered(subroots, ["source"]), "merkle-sources"), arity)
    top = tops(sources).select(_hex(F.col("h"))).first()
    return Manifest(levels, sources, top[0] if top else None)


def tampered_text(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def manifest_rows(docs: DataFrame, arity: int = ARITY, every: int = 5) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id's crc32 is a multiple of ``every`` are folded from a text whose A-Z are lower case.
    """
    fields = [F.col(f) for f in FIELDS]
    other = [tampered_text(F.col("text").cast("string")) if f == "text" else F.col(f) for f in FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    leaves = docs.select(
        source_key(F.col("source")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(fields).alias("h"),
        F.when(touched, leaf_hash(other)).alias("changed"),
    )
    made = build(leaves, arity)
    rows = made.proofs(arity)
    end = folded(_hex(F.coalesce("changed", "h")), F.col("path"))
    root = F.lit(made.root).cast("string")
    rows = rows.select("doc_id", _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), end.alias("folded_root"))
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
