"""Mix sources to target weights by drawing fixed-length blocks of words.

1. Sizes: words per document; sources' sizes are their sums.
2. Targets: weights share ``share`` times all words; no target exceeds ``limit`` times its source's
   size, and what is cut is shared again by weight until none is above.
3. Packing: a source's documents lie end to end in a pseudorandom order and are cut into blocks of
   ``block`` words. Places are running sums within hash buckets of a source, offset by the sums of
   the buckets before, so a source of any size is spread over ``buckets`` groups.
4. Drawing: a source has target / size times as many slots as blocks. Every slot falls into one of
   ``shards`` output shards by a seeded hash: the counts of a source per shard are multinomial and
   its total is exact.
5. Mapping: slots of a source are numbered by shard, and number g takes block perm(g mod blocks),
   where perm is a pseudorandom permutation of the source's block indices, another one for each
   pass. So no block is taken more than ``limit`` times, nor any part of a document.
6. Joining: slots meet blocks by (source, index).

Only built-in expressions, seeded by hashes: reruns agree.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source,
last in order; repeated rows are documents each; equal ids of unequal texts are told apart by
their texts. Other columns are kept by ``mixed_documents`` and ignored here; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.text import WORD, words
from roadpulse.session import stage

WEIGHTS = (3, 1, 2)
BLOCK, SHARDS, BUCKETS, SLOTS_PER_ROW, SLOTS_PER_TASK = 64, 64, 1024, 4096, 1 << 18


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) to those, the place in order, weight and target.

    Targets are min(limit * size, level * weight) with the level at which they add up to the whole.
    Sources in the order of size per weight reach their limit one after the other, so running sums
    find the level. One row per source in one ordered window: names of sources are few beside rows.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("place", F.row_number().over(ordered) - 1).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    df = df.withColumn("cap", F.col("source_size") * F.lit(limit))
    by_need = Window.orderBy((F.col("cap") / F.col("weight")), "place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    whole = F.sum("source_size").over(everything) * F.lit(share)
    df = df.withColumn("level", (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # The first source that does not reach its limit sets the level of all after it.
    df = df.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return df.select("source", "place", "source_size", "weight", target.alias("target"))


def _step(blocks: Column, seed: Column) -> Column:
    """A multiplier without a common divisor with ``blocks``: of several odd primes below it or not dividing it."""
    primes = F.array(*[F.lit(p).cast("long") for p in (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)])
    fit = F.filter(primes, lambda p: blocks % p != 0)
    return F.get(fit, F.pmod(seed, F.size(fit)).cast("int"))


def _permuted(index: Column, blocks: Column, source: Column, turn: Column) -> Column:
    """A permutation of 0 .. blocks-1 for each source and pass: two affine maps around a reversal of halves."""
    seed = F.xxhash64(F.lit(17), source, turn)
    once = F.pmod(index * _step(blocks, seed) + F.pmod(seed, blocks), blocks)
    half = blocks / 2
    folded = F.when(once % 2 == 0, F.floor(once / 2)).otherwise(F.ceil(half).cast("long") + F.floor(once / 2))
    again = F.xxhash64(F.lit(18), source, turn)
    return F.pmod(folded * _step(blocks, again) + F.pmod(again, blocks), blocks)


def _placed(docs: DataFrame, block: int, weights: tuple, share: float, limit: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word's place in the source, and the sources' plan."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_id"),
    )
    sized = sized.withColumn("order", F.xxhash64("doc_id", "text_id")).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    sized = stage(sized, "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), F.col("blocks") * limit)
    plan = stage(plan.withColumn("slots", F.coalesce(F.when(F.col("source_size") > 0, slots), F.lit(0)).cast("long")), "plan")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "text_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    placed = placed.join(buckets.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    placed = placed.select("d.doc_id", "d.text_id", "d.source", "d.size", (F.col("d.begin") + F.col("b.offset")).alias("begin"))
    placed = placed.join(plan.select(F.col("source").alias("s"), "place", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return stage(placed.drop("s", "source"), "placed"), plan


def drawn_slots(plan: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(place, shard, index, turn): every slot's output shard, block index and pass."""
    parts = plan.where("slots > 0").select("place", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS_PER_ROW))).alias("part"))
    last = F.least(F.col("slots"), (F.col("part") + 1) * SLOTS_PER_ROW) - 1
    # Parts are few and short before they are slots, so a number of tasks has to be asked for.
    tasks = max(1, -(-(plan.agg(F.sum("slots")).first()[0] or 0) // SLOTS_PER_TASK))
    slots = parts.repartition(tasks, "place", "part").select("place", "blocks", "part", F.explode(F.sequence(F.col("part") * SLOTS_PER_ROW, last)).alias("slot"))
    slots = slots.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "place", "slot"), F.lit(shards)).cast("int"))
    # Numbering by shard: counts per (source, part, shard) are the multinomial draw in pieces.
    counts = slots.groupBy("place", "shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("place", "shard", "part").orderBy("slot")
    # Tables of slots grow with the corpus and shrink to little when compressed, which would pass for small.
    numbered = slots.withColumn("k", F.row_number().over(inside) - 1).join(counts.hint("merge"), ["place", "shard", "part"])
    number = F.col("first") + F.col("k")
    turn = F.floor(number / F.col("blocks"))
    return numbered.select("place", "shard", _permuted(number % F.col("blocks"), F.col("blocks"), F.col("place"), turn).alias("index"), turn.alias("turn"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """A row for each (document, block) that share words: where in the document, how many."""
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("doc_id", "text_id", "begin", "size", "place", F.explode(F.sequence(first, last)).alias("index"))
    start = F.greatest(F.col("index") * block, F.col("begin")) - F.col("begin")
    end = F.least((F.col("index") + 1) * block, F.col("begin") + F.col("size")) - F.col("begin")
    return pieces.select("doc_id", "text_id", "begin", "size", "place", "index", start.alias("start"), end.alias("end"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, limit: float = 2.0, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    placed, plan = _placed(docs, block, weights, share, limit)
    times = drawn_slots(plan, shards).groupBy("place", "index").agg(F.count(F.lit(1)).alias("times"))
    taken = _pieces(placed, block).join(times.hint("merge"), ["place", "index"])
    taken = taken.groupBy("place", "begin").agg(F.sum((F.col("end") - F.col("start")) * F.col("times")).alias("taken"))
    # Documents without words share a place with the next one.
    out = placed.join(taken.hint("merge"), ["place", "begin"], "left")
    got = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", got.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, limit: float = 2.0, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each document and pass that takes words of it.

    A document taken whole keeps its text; of one taken in part, the taken runs of words are joined
    by blanks, in order. ``n_chars``, where there is one, is that of the new text.
    """
    placed, plan = _placed(docs, block, weights, share, limit)
    taken = _pieces(placed, block).join(drawn_slots(plan, shards).select("place", "index", "turn").hint("merge"), ["place", "index"])
    runs = taken.groupBy("place", "begin", "turn").agg(
        F.first("doc_id").alias("_id"),
        F.first("text_id").alias("_text_id"),
        F.first("size").alias("_size"),
        F.sum(F.col("end") - F.col("start")).alias("_taken"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs"),
    )
    # Rows that repeat a document wholly stand at places of their own; each meets one of its copies.
    copy = Window.partitionBy("_id", "_text_id", "turn").orderBy("place", "begin")
    runs = runs.withColumn("_copy", F.row_number().over(copy)).drop("place", "begin", "turn")
    own = Window.partitionBy("_key_id", "_key_text").orderBy("_key_id")
    keyed = docs.withColumn("_key_id", F.col("doc_id").cast("long")).withColumn("_key_text", F.xxhash64("text"))
    keyed = keyed.withColumn("_nth", F.row_number().over(own))
    out = keyed.join(runs.hint("merge"), F.col("_key_id").eqNullSafe(F.col("_id")) & (F.col("_key_text") == F.col("_text_id")) & (F.col("_nth") == F.col("_copy")))
    part = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice("_words", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), " ")
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(part)
    out = out.withColumn("_words", F.when(F.col("_taken") < F.col("_size"), words(F.col("text")))).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
