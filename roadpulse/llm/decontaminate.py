"""Benchmark passages in documents, by latent semantic retrieval and confirmed by word order.

1. Words are hashed into ``TERMS`` terms; one pass over all documents counts in how many each term
   occurs and stores every whole text as terms.
2. A randomised SVD finds the ``RANK`` main directions of the TF-IDF passages of all documents and
   of the benchmark. Every document counts the same and its passages share its weight; together
   documents weigh as much as ``CORPUS_ROWS`` passages at most, and benchmark passages weigh more.
   Products with the matrix and its transpose are summed per partition and then by blocks of
   terms, so its rows stay on the executors; the driver has thin factors of fixed size only.
3. A second pass over all documents cuts every whole text into passages of three steps of ``STEP``
   words, one step apart, folds them into the latent space and takes those whose cosine with a
   benchmark passage reaches ``MIN_COSINE``. The cosine is that of the passage itself with the
   item's latent vector, so a passage that lies mostly outside the latent space is near nothing.
   Items of which less than ``SHARE`` lies in the latent space, as in a benchmark with many more
   items than ``RANK``, are compared by their TF-IDF terms themselves.
   Beside these, whatever the weights, the same pass takes every place with as many word pairs of
   an item as a copy keeps in which words are dropped or replaced up to ``LIKELY``.
4. Candidates are checked where they stand: the longest common subsequence of the item's words and
   the words around the passage must cover ``SURE`` of the item, or ``LIKELY`` of it and also the
   item's answer, its last ``ANSWER`` words, for paraphrases. Items of fewer than ``STEP`` / 2
   words must occur as they are.

Benchmark items go to the tasks in groups of at most ``GROUP``, each with a latent space fitted on
all its passages and all documents; a larger benchmark takes more passes, so what is broadcast is
bounded. Nothing of the documents is.

Defined results: null and empty texts, and items without words, match nothing; a null ``doc_id`` or
``item_id`` is kept as null; repeated rows are found each; equal items are found each. Other
columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.text import column_bytes, mix, row_key, slices, word_hashes
from roadpulse.session import stage

TERM_BITS = 15
TERMS, RANK, EXTRA, POWER = 1 << TERM_BITS, 128, 8, 2
#: Eigenvalues below this share of the largest are rounding.
NEGLIGIBLE = 1e-6
STEP, STEPS = 16, 3
CORPUS_ROWS, BENCH_WEIGHT = 2_000, 4.0
MIN_COSINE, SHARE, SURE, LIKELY, ANSWER, ANSWER_SHARE = 0.18, 0.6, 0.8, 0.6, 6, 0.8
GROUP, TERM_BLOCK, SUM_TASKS, PAIR_BITS = 2_048, 256, 4, 20
#: Passages of a task, where there are cores enough and at most; every task passes on a matrix of terms, so there are no more tasks than that needs.
FEW_PASSAGES, TASK_PASSAGES = 200_000, 2_000_000
#: Rows of a run that are added one after the other; longer runs are added in pieces.
PIECE, PIECES = 32, 256
#: Terms whose sums a task holds at a time.
RUNS = 4_096


def terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; sorting them is faster than the hashing of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def inverse_frequency(term: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """Weights of terms; small, but never 0, for those of most documents."""
    idf = np.full(TERMS, np.log(docs + 1.0))
    idf[term] = np.maximum(np.log((docs + 1.0) / n), 0.01)
    return idf


def steps_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and row of each step of up to ``STEP`` words, and the first step of each passage."""
    n = len(row)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.empty(0, np.int64)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    first = np.flatnonzero(place % STEP == 0)
    owner = row[first]
    nth = np.arange(len(first)) - np.searchsorted(owner, owner)
    left = np.searchsorted(owner, owner, side="right") - np.arange(len(first))
    # A passage starts at each step that has two after it, and at a text's first one.
    return first, owner, np.flatnonzero((left >= STEPS) | (nth == 0))


def run_sums(values: np.ndarray, index: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``values[index]`` over runs that begin at ``start``, none of them empty."""
    size = np.diff(np.append(start, len(index)))
    pieces = -(-size // PIECE)
    end = np.cumsum(pieces)
    nth = np.arange(end[-1]) - np.repeat(end - pieces, pieces)
    first = np.repeat(start, pieces) + nth * PIECE
    length = np.minimum(np.repeat(size, pieces) - nth * PIECE, PIECE)
    # The longest pieces first: those with a row left are the first ones. Few at a time stay in the cache.
    order = np.argsort(-length, kind="stable")
    sums = np.empty((len(order), values.shape[1]), values.dtype)
    row = np.empty((min(len(order), PIECES), values.shape[1]), values.dtype)
    for lo in range(0, len(order), PIECES):
        own = order[lo : lo + PIECES]
        begin, size = first[own], -length[own]
        added = values[index[begin]]
        for k in range(1, -int(size[0])):
            left = int(np.searchsorted(size, -k, side="left"))
            np.take(values, index[begin[:left] + k], axis=0, out=row[:left], mode="clip")
            added[:left] += row[:left]
        sums[own] = added
    return sums if len(sums) == len(start) else run_sums(sums, np.arange(len(sums)), end - pieces)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (-1, passages of a text, its words' terms) and of (term, documents with it, none)."""
    seen = np.zeros(TERMS, np.int64)
    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        passages, texts = [], []
        for a, b in slices(offsets):
            h, row, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            t = terms(h)
            seen += np.bincount(distinct(row * TERMS + t) % TERMS, minlength=TERMS)
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            t = t.astype(np.uint16)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi > lo:
                    passages.append(-(-(hi - lo) // (STEP * STEPS)))
                    texts.append(t[lo:hi].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(texts), pa.int32()), pa.array(passages, pa.int64()), pa.array(texts, pa.binary())], ["term", "n", "terms"]
        )
    term = np.flatnonzero(seen).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(seen[term]), pa.nulls(len(term), pa.binary())], ["term", "n", "terms"])


def _lengths(passage: np.ndarray, term: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the TF-IDF rows of ``n`` passages."""
    key = np.sort(passage * TERMS + term)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    value = np.diff(np.append(first, len(key))) * idf[key[first] % TERMS]
    return np.sqrt(np.bincount(key[first] // TERMS, value * value, n))


def _thin(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose rows are not all zero, and those rows."""
    used = np.flatnonzero(matrix.any(axis=1)).astype(np.int32)
    return used, matrix[used]


def _whole(used: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((TERMS, rows.shape[1]), np.float32)
    out[used] = rows
    return out


@contextmanager
def _shared(spark: SparkSession, value: tuple) -> Iterator[Broadcast]:
    """``value`` on all machines; its copies leave their disks with the block, not only with the session."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def _value(thin: Broadcast | tuple) -> tuple[np.ndarray, np.ndarray]:
    return thin.value if isinstance(thin, Broadcast) else thin


def _times_transposed(idf: np.ndarray, thin: Broadcast | tuple):
    """A partition's part of A' (A right), as blocks of terms and bytes of their rows.

    ``thin`` is right or its broadcast. A has a row of unit length times ``weight`` for each passage of the texts (terms, weight).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = idf[:, None].astype(np.float32)
        right = _whole(*_value(thin))
        right *= factor
        out = np.zeros((TERMS, right.shape[1]), np.float32)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            weight = batch.column(1).to_numpy()
            for a, b in slices(offsets):
                term = data[offsets[a] : offsets[b]].view(np.uint16).astype(np.int64)
                if not len(term):
                    continue
                begin = (offsets[a : b + 1] - offsets[a]) // 2
                size = np.diff(begin)
                place = np.arange(len(term)) - np.repeat(begin[:-1], size)
                start = np.flatnonzero(place % (STEP * STEPS) == 0)
                passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
                own = np.repeat(weight[a:b], size)[start] / np.maximum(_lengths(passage, term, idf, len(start)), 1e-12)
                product = run_sums(right, term, start) * (own * own).astype(np.float32)[:, None]
                order = np.argsort(term.astype(np.uint16), kind="stable")
                term = term[order]
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                passage, end = passage[order], np.append(first, len(term))
                for lo in range(0, len(first), RUNS):
                    hi = min(lo + RUNS, len(first))
                    out[term[first[lo:hi]]] += run_sums(product, passage[end[lo] : end[hi]], first[lo:hi] - end[lo])
        # A task holds the two matrices only; its part leaves it block by block.
        del right
        out *= factor
        task = TaskContext.get().partitionId()
        for block in range(TERMS // TERM_BLOCK):
            used, rows = _thin(out[block * TERM_BLOCK : (block + 1) * TERM_BLOCK])
            if len(used):
                used += block * TERM_BLOCK
                columns = [pa.array([block], pa.int32()), pa.array([task], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (used, rows)]]
                yield pa.RecordBatch.from_arrays(columns, ["block", "task", "used", "part"])

    return run


def _added(width: int):
    """Sums of the parts of each block of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                used, part = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((2, np.int32), (3, np.float32)))
                # A task has a term once.
                sums.setdefault(block, np.zeros((TERM_BLOCK, width), np.float32))[used % TERM_BLOCK] += part.reshape(-1, width)
        for block, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["block", "rows"])

    return run


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Main directions (terms x rank) of the TF-IDF passages of (terms, weight), by randomised SVD.

    Every round multiplies by A'A on the executors; the next one starts from the orthonormalised
    thin result. The last product, with what it was taken of, also gives the singular directions in
    its span, so no round is spent on them.
    """
    core = np.random.default_rng(seed).standard_normal((TERMS, rank + EXTRA), dtype=np.float32)
    for turn in range(POWER):
        basis = core if turn == 0 else np.linalg.qr(core)[0]
        core = np.zeros(basis.shape, np.float32)
        with _shared(passages.sparkSession, _thin(basis)) as thin:
            parts = passages.mapInArrow(_times_transposed(idf, thin), "block int, task int, used binary, part binary")
            # Parts are added in one order, so that reruns agree.
            parts = parts.repartition(SUM_TASKS, "block").sortWithinPartitions("block", "task")
            for block, rows in parts.mapInArrow(_added(basis.shape[1]), "block int, rows binary").toLocalIterator():
                core[block * TERM_BLOCK : (block + 1) * TERM_BLOCK] = np.frombuffer(rows, np.float32).reshape(TERM_BLOCK, -1)
    # A'A is near core (basis' core)^-1 core' (Nystrom): eigenvectors of its small part rotate core's span to singular directions.
    span, small = np.linalg.qr(core)
    inner = (basis.T @ core + core.T @ basis).astype(np.float64) / 2
    value, vector = np.linalg.eigh(small @ np.linalg.pinv(inner, NEGLIGIBLE, hermitian=True) @ small.T)
    return np.ascontiguousarray((span @ vector[:, np.argsort(-value)][:, :rank]).astype(np.float32))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bits of one number for the places of ``a``."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        both = row & at.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hash of each word with its next one."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def begin_of(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class Items:
    """A bounded group of benchmark items: their words, latent passages and word pairs."""

    def __init__(self, rows: list[tuple[int | None, bytes]], fold: np.ndarray, idf: np.ndarray | None = None):
        idf = np.ones(TERMS) if idf is None else idf
        outside: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids, self.words, vectors, self.owner, self.low = [], [], [], [], []
        pairs, holder = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for item_id, text in rows:
            h, row, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if not len(h):
                continue
            first, _, passage = steps_of(row)
            for p in passage:
                lo = first[p]
                hi = min(lo + STEP * STEPS, len(h))
                t, n = np.unique(terms(h[lo:hi]), return_counts=True)
                vectors.append(n @ fold[t])
                outside.append((t, n * idf[t] / np.linalg.norm(n * idf[t])))
                if np.linalg.norm(vectors[-1]) < SHARE * np.linalg.norm(n * idf[t]):
                    self.low.append(len(vectors) - 1)
                self.owner.append(len(self.ids))
            # An item of one word has itself for a pair.
            pairs.append(np.unique(pairs_of(h) if len(h) > 1 else h))
            holder.append(np.full(len(pairs[-1]), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(h.tolist())
        v = np.array(vectors, np.float32).reshape(-1, fold.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.owner = np.array(self.owner, np.int64)
        # Of the passages outside the latent space: by term, the passage's place in ``low`` and the term's idf-weighted value.
        kept = [outside[p] for p in self.low]
        term = np.concatenate([t for t, _ in kept]) if kept else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.term_at = np.searchsorted(term[order], np.arange(TERMS + 2))
        self.in_low = np.repeat(np.arange(len(kept)), [len(t) for t, _ in kept])[order].astype(np.int64)
        self.value = (np.concatenate([v for _, v in kept]) * idf[term])[order] if kept else np.empty(0)
        pair, holder = np.concatenate(pairs), np.concatenate(holder)
        order = np.argsort(pair, kind="stable")
        self.pair, at, self.holders = *np.unique(pair[order], return_index=True), holder[order]
        self.pair_at = np.append(at, len(pair))
        # Which beginnings of pair hashes occur, so that few pairs of a text are looked up.
        self.begins = np.zeros(1 << PAIR_BITS, bool)
        self.begins[begin_of(self.pair)] = True
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.single = bool((self.size == 1).any())
        # A word dropped or replaced takes at most two pairs with it; a short item keeps all.
        left = self.size - 1 - 2 * (self.size - np.ceil(LIKELY * self.size - 1e-9).astype(np.int64))
        left = np.where(self.size < STEP // 2, self.size - 1, left)
        self.need = np.maximum(left, 1)

    def products(self, nth: np.ndarray, term: np.ndarray, steps: int) -> np.ndarray:
        """Products of steps, given as rows of (step, term), with the passages in ``low``."""
        n = self.term_at[term + 1] - self.term_at[term]
        at = np.repeat(self.term_at[term + 1] - np.cumsum(n), n) + np.arange(n.sum())
        key = np.repeat(nth, n) * len(self.low) + self.in_low[at]
        return np.bincount(key, self.value[at], steps * len(self.low)).reshape(steps, len(self.low)).astype(np.float32)

    def places(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first word) of places with an item's needed number of pairs, sorted."""
        own = np.empty(0, np.uint64) if len(h) < 2 else pairs_of(h)
        word = np.flatnonzero((row[1:] == row[:-1]) & self.begins[begin_of(own)])
        own = own[word]
        if self.single:
            alone = np.flatnonzero(self.begins[begin_of(h)])
            own, word = np.concatenate([own, h[alone]]), np.concatenate([word, alone])
        at = np.minimum(np.searchsorted(self.pair, own), len(self.pair) - 1)
        same = self.pair[at] == own
        at, word = at[same], word[same]
        n = self.pair_at[at + 1] - self.pair_at[at]
        word = np.repeat(word, n)
        item = self.holders[np.repeat(self.pair_at[at + 1] - np.cumsum(n), n) + np.arange(len(word))]
        order = np.lexsort((word, item, row[word]))
        word, item = word[order], item[order]
        last = np.arange(len(word)) + self.need[item] - 1
        end = np.minimum(last, max(len(word) - 1, 0))
        near = (last < len(word)) & (item[end] == item) & (row[word[end]] == row[word]) & (word[end] - word <= STEP * STEPS + self.size[item])
        return row[word[near]], item[near], word[near]

    def check(self, item: int, near: list) -> tuple[float, bool, bool]:
        """Share of the item's words in order, whether its answer is there, and the verdict."""
        words, there = self.words[item], set(near)
        # No more words can be in order than are there.
        if sum(map(there.__contains__, words)) < LIKELY * len(words):
            return 0.0, False, False
        share = lcs(words, near) / len(words)
        if share < LIKELY:
            return share, False, False
        answer = words[-ANSWER:]
        has = lcs(answer, near) / len(answer) >= ANSWER_SHARE
        if len(words) < STEP // 2:
            exact = any(near[i : i + len(words)] == words for i in range(len(near) - len(words) + 1))
            return share, has, exact
        return share, has, share >= SURE or (share >= LIKELY and has)


def _search(thin: Broadcast | tuple, idf: np.ndarray, rows: list[tuple[int | None, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.append(idf * idf, 0).astype(np.float32)
        fold = _whole(*_value(thin))
        items = Items(rows, fold, idf)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found: list[tuple] = []
            for a, b in slices(offsets, 1 << 17):
                h, row, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h) or not len(items.ids):
                    continue
                first, owner, passage = steps_of(row)
                rank = fold.shape[1]
                # The last row, of zeros, stands for steps that a passage lacks.
                step = np.zeros((len(first) + 1, rank + len(items.low)), np.float32)
                # A term counts once in a step, so that repeated words don't make a passage.
                nth = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                key = distinct(nth * TERMS + terms(h))
                # The weight 0 closes the last step.
                t = np.append(key % TERMS, TERMS)
                at = np.append(np.searchsorted(key, np.arange(len(first)) * TERMS), len(key))
                for s in range(0, len(first), 1024):
                    e = min(s + 1024, len(first))
                    step[s:e, :rank] = run_sums(fold, t[at[s] : at[e]], at[s:e] - at[s])
                squares = np.append(np.add.reduceat(weight[t], at[:-1]), np.float32(0))
                if items.low:
                    step[:-1, rank:] = items.products(key // TERMS, key % TERMS, len(first))
                sums, norm = step[passage], squares[passage]
                for k in range(1, STEPS):
                    nxt = np.minimum(passage + k, len(first) - 1)
                    nxt[(passage + k >= len(first)) | (owner[nxt] != owner[passage])] = len(first)
                    sums += step[nxt]
                    norm += squares[nxt]
                sums /= np.sqrt(np.maximum(norm, 1e-9))[:, None]
                cosine = sums[:, :rank] @ items.vectors.T
                if items.low:
                    cosine[:, items.low] = np.maximum(cosine[:, items.low], sums[:, rank:])
                ends = np.searchsorted(row, np.arange(b - a + 1))
                best: dict[tuple[int, int], tuple] = {}
                near = np.flatnonzero(cosine >= MIN_COSINE)
                near_p, near_q = np.divmod(near, cosine.shape[1])
                closest = np.argsort(-cosine.ravel()[near], kind="stable")
                for p, q in zip(near_p[closest], near_q[closest], strict=True):
                    doc, item = int(owner[passage[p]]), int(items.owner[q])
                    if best.get((doc, item), (0.0,))[0] >= SURE:
                        continue
                    reach = len(items.words[item])
                    lo = max(int(first[passage[p]]) - reach, int(ends[doc]))
                    hi = min(int(first[passage[p]]) + STEP * STEPS + reach, int(ends[doc + 1]))
                    share, answer, hit = items.check(item, h[lo:hi].tolist())
                    if hit and (share, float(cosine[p, q])) > best.get((doc, item), (0.0, 0.0))[:2]:
                        best[doc, item] = (share, float(cosine[p, q]), answer)
                past = (-1, -1, 0)
                starts = first[passage]
                for doc, item, word in zip(*(x.tolist() for x in items.places(h, row)), strict=True):
                    # Places less than a step apart are one.
                    if best.get((doc, item), (0.0,))[0] >= SURE or past[:2] == (doc, item) and word < past[2]:
                        continue
                    past = (doc, item, word + STEP)
                    reach = len(items.words[item])
                    lo, hi = max(word - reach, int(ends[doc])), min(word + STEP * STEPS + reach, int(ends[doc + 1]))
                    share, answer, hit = items.check(item, h[lo:hi].tolist())
                    if hit and share > best.get((doc, item), (0.0,))[0]:
                        p = np.searchsorted(starts, word, side="right") - 1
                        best[doc, item] = (share, float(cosine[p, items.owner == item].max()), answer)
                found += [(a + doc, items.ids[item], *v) for (doc, item), v in sorted(best.items())]
            rows_at, ids, share, cos, answer = zip(*found, strict=True) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows_at, pa.int64())), pa.array(ids, pa.int64()), pa.array(share, pa.float64()), pa.array(cos, pa.float64()), pa.array(answer, pa.bool_())],
                ["doc_id", "item_id", "lcs_share", "cosine", "has_answer"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of (doc_id, item_id, lcs_share, cosine, has_answer): documents that hold a benchmark item."""
    result = "doc_id long, item_id long, lcs_share double, cosine double, has_answer boolean"
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    items = stage(items.select("*", F.row_number().over(_by_text()).alias("nth")), "items")
    n_items, n_docs = items.count(), docs.count()
    if not n_items or not n_docs:
        return spark.createDataFrame([], result)
    statistics = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_statistics, "term int, n long, terms binary")
    statistics = stage(statistics, "terms")
    counts = statistics.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n_passages = sum(counts.filter(pc.field("term") < 0).column("n").to_pylist())
    counts = counts.filter(pc.field("term") >= 0)
    idf = inverse_frequency(counts.column("term").to_numpy(), counts.column("n").to_numpy(), n_docs)
    share = float(np.sqrt(min(1.0, CORPUS_ROWS / n_docs)))
    corpus = statistics.where("term = -1").select("terms", (F.lit(share) / F.sqrt("n")).alias("weight"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for first in range(0, n_items, GROUP):
        group = items.where(F.col("nth").between(first + 1, first + GROUP))
        bench = group.select("text").mapInArrow(_bench_terms, "terms binary").select("terms", F.lit(BENCH_WEIGHT).alias("weight"))
        passages = stage(bench, "passages")
        tasks = fit_tasks(n_passages, spark.sparkContext.defaultParallelism)
        fold = _thin((latent_space(corpus.union(passages).coalesce(tasks), idf) * idf[:, None]).astype(np.float32))
        rows = [(r.item_id, bytes(r.text)) for r in group.select("item_id", "text").collect()]
        # Leaks are few and short beside the texts.
        with _shared(spark, fold) as thin:
            part = stage(texts.mapInArrow(_search(thin, idf, rows), result), "found")
        found = part if found is None else found.union(part)
    return found


def fit_tasks(passages: int, cores: int) -> int:
    """Tasks that share ``passages``: as many as cores if that leaves each enough, more if it leaves them too many."""
    return max(1, min(cores, -(-passages // FEW_PASSAGES)), -(-passages // TASK_PASSAGES))


def _by_text():
    """Items in a fixed order; a benchmark is small beside the corpus."""
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("text"), "text", "item_id")


def _bench_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            h, row, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            first, _, passage = steps_of(row)
            out += [terms(h[first[p] : first[p] + STEP * STEPS]).astype(np.uint16).tobytes() for p in passage]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["terms"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item."""
    rows = docs.select(row_key().alias("doc_id"), "text")
    bad = contaminated(rows, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("_bad")).distinct()
    # A stored table's size is known: few keys are broadcast, and whole texts are not shuffled.
    bad = stage(bad, "leaks")
    return docs.join(bad, row_key() == F.col("_bad"), "left_anti")
