"""Near-duplicate documents: MinHash signatures, banding, confirmed links, connected components.

A document's set is its distinct five-word shingles (A-Z as a-z), as 64-bit hashes. Documents with
equal sets are one class and only its smallest id goes on. A signature has the minima of 128
universal hash functions; four at a time they make 32 bands, so two sets with a Jaccard similarity
of 0.75 share a band but for 5 in a million cases, and with more similarity almost surely.

No bucket is expanded into pairs. Its members are first compared with one of them, drawn by a hash,
and confirmed links are merged into components by alternating large-star and small-star. Most
buckets are one component then and done. In the others only members outside the bucket's largest
component can still give a link between components, so these outsiders are compared with all
members: outsiders are cut into tiles and members into blocks, by number and by the size of their
sets, and each tile meets each block in a group of bounded size, where one matrix product of the
sets gives all intersections and only links come out. So no link between components is left out
and no bucket is capped; the work grows with outsiders times members, not with members squared.

Full sets are made again from the texts of candidates only. A bit array of fixed size tells the
scan which rows these may be, so no text is shuffled and nothing that grows is broadcast.

Defined results: a null or empty text has an empty set, is linked with nothing and stands for
itself; fewer than five words make one shingle of the whole sequence; rows repeating a ``doc_id``
count as one document; a null ``doc_id`` stays unlinked with a null component. Columns other than
``doc_id`` and ``text`` are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roadpulse.llm.text import column_bytes, mix, slices, word_hashes
from roadpulse.session import stage

WIDTH, HASHES, BAND = 5, 128, 4
#: Smallest share of equal minima that goes to the full comparison: 0.75 less 5.2 deviations.
SURE_BELOW = 0.55
#: Bits that mark candidates for the scan of the texts.
BITS = 1 << 23
#: Outsiders of a tile and members of a block of an open bucket, and shingles of either.
TILE, BLOCK, WEIGHT = 400, 2000, 1 << 20

_rng = np.random.default_rng(20240501)
_STEP = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = column_bytes(column)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        h, row, _ = word_hashes(data[offsets[a] : offsets[b]], own)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        if len(h) >= WIDTH:
            s = h[: len(h) - WIDTH + 1] * _STEP[0]
            for k in range(1, WIDTH):
                s += h[k : len(h) - WIDTH + 1 + k] * _STEP[k]
            s = mix(s)
        for i in range(b - a):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= WIDTH:
                yield np.unique(s[lo : hi - WIDTH + 1])
            elif hi > lo:
                short = (h[lo:hi] * _STEP[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield mix(np.array([short], np.uint64))
            else:
                yield h[:0]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of the upper halves of all minima per set; empty sets are not given."""
    out = np.empty((len(sets), HASHES), np.int32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        t = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _MUL[k], out=t)
            np.add(t, _ADD[k], out=t)
            out[first:last, k] = (np.minimum.reduceat(t, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        first = last
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        sizes = np.array([len(s) for s in sets], np.int64)
        some = [s for s in sets if len(s)]
        flat = pa.array(minima(some).reshape(-1))
        at = np.concatenate([[0], np.cumsum(sizes > 0)]) * HASHES
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)],
            ["doc_id", "n_shingles", "set_id", "minima"],
        )


def _sets(bits: np.ndarray):
    """Sets of the rows whose id's bit is set: (rep, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[place >> 6] >> (place & 63)) & 1 == 1))
            if not batch.num_rows:
                continue
            sets = list(shingle_sets(batch.column(1)))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["rep", "shingles"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the set and the minima (none for an empty set)."""
    return _texts(docs).mapInArrow(_signed, "doc_id long, n_shingles long, set_id binary, minima array<int>")


def _band_keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(k), *[F.get("minima", F.lit(k * BAND + j)) for j in range(BAND)]) for k in range(HASHES // BAND)])


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (u, v), by large-star and small-star.

    A node's smallest neighbour is a pre-aggregated minimum that is joined back, so a hub with many
    neighbours is split like any skewed join.
    """
    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges as a stored table, and their number and hash, observed while they are written."""
        seen = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
        table = stage(e.observe(seen, *marks), "star")
        return table, (seen.get["n"], seen.get["h"])

    edges, before = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large-star: neighbours larger than a node go to the smallest of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), "m")
        edges, now = kept(down.where("u <> m").select("u", F.col("m").alias("v")).distinct())
        if now == before:
            # Nothing moves any more: every node but the smallest of a component has one edge, to that one.
            return edges.groupBy("u").agg(F.min("v").alias("component"))
        before = now


def _full_sets(needed: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, shingles) of the ids in ``needed``, from their texts."""
    place = F.pmod(F.xxhash64("rep"), F.lit(BITS))
    words = needed.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    rows = _texts(docs).where("doc_id is not null").select("*", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("place"))
    sets = rows.mapInArrow(_sets(bits), "rep long, shingles array<long>").join(needed, "rep", "left_semi")
    # Of rows that repeat an id, those count that have the representative's set size.
    return stage(sets.join(reps.select("rep", "n_shingles"), "rep").where(F.size("shingles") == F.col("n_shingles")).drop("n_shingles"), "sets")


def _outside_links(percent: int):
    """Links (u, v) of outsiders with members of other components, from a group of (rep, component, outside, shingles)."""

    def links(group: pa.Table) -> pa.Table:
        rep, component = group.column("rep").to_numpy(), group.column("component").to_numpy()
        outside = np.asarray(group.column("outside").combine_chunks())
        lists = group.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        # Rows of the matrices: outsiders, and members in their own order.
        a, b = np.flatnonzero(outside), np.flatnonzero(~outside)
        row = np.empty(len(rep), np.int64)
        row[a], row[b] = np.arange(len(a)), np.arange(len(b))
        who = np.repeat(np.arange(len(rep)), size)
        distinct, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        # Only shingles of an outsider and a member can be common.
        left, right = (np.bincount(at[side[who]], minlength=len(distinct)) > 0 for side in (outside, ~outside))
        column = np.cumsum(left & right) - 1
        shared = (left & right)[at]
        who, at = who[shared], column[at[shared]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        common = np.zeros((len(a), len(b)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(at, [first, first + 4096])
            sides = []
            for side, n in ((outside[who[lo:hi]], len(a)), (~outside[who[lo:hi]], len(b))):
                has = np.zeros((n, 4096), np.float32)
                has[row[who[lo:hi][side]], at[lo:hi][side] - first] = 1
                sides.append(has)
            common += sides[0] @ sides[1].T
        union = size[a][:, None] + size[b][None, :] - common
        u, v = np.nonzero((common * 100 >= union * percent) & (component[a][:, None] != component[b][None, :]))
        return pa.table({"u": rep[a[u]], "v": rep[b[v]]})

    return links


def _outsider_groups(members: DataFrame) -> DataFrame:
    """Members (rep, key, component, n_shingles) of open buckets, dealt into groups of outsiders and members.

    Rows (rep, component, outside, key, tile, block): a tile's outsiders and a block's members meet.
    """
    own = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    main = F.max_by("component", F.struct("n", "component"))
    most = F.max(F.struct("n", "component", "w"))
    buckets = own.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), most.alias("most"), F.count(F.lit(1)).alias("kinds"))
    buckets = buckets.where("kinds > 1")

    def parts(n, w, limit: int):
        return F.greatest(F.ceil(n / limit), F.ceil(w / WEIGHT), F.lit(1).cast("long"))

    buckets = buckets.select(
        "key",
        "main",
        parts(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w"), TILE).alias("tiles"),
        parts(F.col("n"), F.col("w"), BLOCK).alias("blocks"),
    )
    met = members.join(buckets, "key")

    def dealt(count: str):
        return F.pmod(F.xxhash64("rep"), F.col(count))

    def each(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    one = met.where("component <> main").select("key", "rep", "component", F.lit(True).alias("outside"), dealt("tiles").alias("tile"), each("blocks").alias("block"))
    other = met.select("key", "rep", "component", F.lit(False).alias("outside"), dealt("blocks").alias("block"), each("tiles").alias("tile"))
    return one.unionByName(other)


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose signatures agree enough and whose full sets reach the similarity."""
    sig = reps.select("rep", "minima", "n_shingles")
    a, b = (sig.select(F.col("rep").alias(k), F.col("minima").alias(f"{k}_min"), F.col("n_shingles").alias(f"{k}_n")) for k in "uv")
    same = F.aggregate(F.zip_with("u_min", "v_min", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    # Sets whose sizes differ too much can't reach the similarity.
    sized = F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent
    likely = stage(pairs.join(a, "u").join(b, "v").where(sized & (same >= F.lit(int(SURE_BELOW * HASHES)))).select("u", "v"), "likely")
    sets = _full_sets(likely.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), reps, docs)
    a, b = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "uv")
    common = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - common
    return likely.join(a, "u").join(b, "v").where(common * 100 >= union * percent).select("u", "v").distinct()


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked id), kept."""
    signed = stage(signatures(docs), "signed")
    classes = signed.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima")
    )
    classes = stage(classes, "classes")
    reps = classes.select("rep", "n_shingles", "minima")
    bands = stage(reps.select("rep", F.posexplode(_band_keys()).alias("band", "key")), "bands")
    drawn = F.struct(F.xxhash64("key", "rep").alias("h"), "rep")
    buckets = bands.groupBy("key").agg(F.min(drawn)["rep"].alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(buckets, "buckets")
    members = stage(bands.join(buckets, "key"), "members")
    links = _confirmed(_ordered(members, "rep", "hub"), reps, docs, percent)
    links = stage(links, "links")
    found = stage(components(links), "components")

    # Buckets of three and more are open while their members are in more than one component.
    rest = members.where("n > 2").select("rep", "key").join(found.select(F.col("u").alias("rep"), "component"), "rep", "left")
    rest = stage(rest.withColumn("component", F.coalesce("component", "rep")), "open")
    mixed = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    rest = stage(rest.join(mixed, "key").join(reps.select("rep", "n_shingles"), "rep"), "mixed")
    if not rest.isEmpty():
        sets = _full_sets(rest.select("rep").distinct(), reps, docs)
        met = _outsider_groups(rest).join(sets, "rep")
        more = met.groupBy("key", "tile", "block").applyInArrow(_outside_links(percent), "u long, v long")
        more = stage(more.distinct(), "links")
        if not more.isEmpty():
            # The components so far stand for their links.
            stars = found.select("u", F.col("component").alias("v"))
            found = stage(components(stars.union(more)), "components")

    place = classes.join(found.select(F.col("u").alias("rep"), "component"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = signed.join(place, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
