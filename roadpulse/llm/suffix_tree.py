"""Language-model scores of texts from a probabilistic suffix tree over words.

Tokens of a text are its words (A-Z as a-z) and one end. As in the base score, the symbols are the
V distinct training tokens and one more that stands for every unknown one, so both scores are
probabilities over the same symbols and can be compared.

States are the last words before a token, one to ``depth`` of them, a mark at the text's start
included; any word may be part of a state or follow it. A context is kept if its next-symbol
distribution diverges from that of the context one word shorter by more than it costs to write
down: the log-likelihood that it gains in training must exceed log N for naming the context (N
training tokens) and half of log t for each of its distinct next symbols (t: how often it occurs).
So no number of states, symbols or counts is fixed, and the tree grows with the input. A kept
context's distribution is smoothed by that of the next shorter kept one (Witten-Bell), down to the
root, where a token seen c times has (c - d) / N and the unknown symbol d * V / N, with the
discount d = n1 / (n1 + 2 n2) from the numbers of tokens seen once and twice. A token is scored by
the longest kept suffix of what stands before it; the text's score is the sum over its tokens.

Counting: texts are packed into chunks of about ``CHUNK`` bytes and stored. Words and runs of words
are 64-bit hashes. A chunk asks for the totals of its distinct keys: it sends them once with its
own counts, sorted and cut into ranges of the hash; a range adds up what all chunks sent and gives
each its totals in the order asked, so that neither words nor keys travel back. What a context
gains and how many symbols follow it are sums over training tokens, log(p / p shorter) and 1 / n,
so they are added up in the same way, and a frequent context is as light as any other: a chunk
sends it once. Runs after a context that occurs less than twice are not asked for: such a context
gains log N at most and is never kept. The tree is nowhere collected; each chunk holds the states
that its own texts meet.

Defined results: null and empty texts have the end token only; a null ``doc_id`` counts as the
empty text in the split; repeated rows are scored each and counted each; with no training rows
every token is the unknown symbol with probability one. Other columns are ignored; no rows give
no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.text import column_bytes, fold_of, mix, slices, word_hashes
from roadpulse.session import shuffles_dropped, stage, text_batches

DEPTH = 2
CHUNK, SLICE, PARTS = 12 << 20, 1 << 19, 64
#: Tokens of a chunk that are worked on together, where only sums over them are kept.
PIECE = 1 << 18
#: The end token, which also marks a text's start; and what a run of words is hashed with.
END, STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
#: Sums over tokens travel as whole numbers of these units, so that their order does not matter.
GAIN_UNIT, KIND_UNIT = 1 << 16, 1 << 24

CHUNKS = "chunk string, ids array<long>, held array<boolean>, sizes array<long>, data binary"
ASKED = "chunk string, context boolean, words int, part int, keys binary, a binary, b binary"
ANSWERS = "chunk string, context boolean, words int, part int, a binary, stats array<long>"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, all first bytes before all second ones."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of (doc_id, held_out, text) in rows of about ``CHUNK`` bytes; a longer text is a row of its own."""
    ids, held, texts, size = [], [], [], 0

    def chunk() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=1).compress(b"\n".join(texts))
        sizes = [len(t) for t in texts]
        columns = [[uuid.uuid4().hex], [ids], [held], [sizes], [data]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "held", "sizes", "data"])

    for batch in batches:
        data, offsets = column_bytes(batch.column(2))
        for i, (doc_id, out) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            if texts and size + len(text) > CHUNK:
                yield chunk()
                ids, held, texts, size = [], [], [], 0
            ids.append(doc_id)
            held.append(out)
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield chunk()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and which of them each value is, with less in memory than ``np.unique``."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    which = np.empty(len(values), np.int32)
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    which[order] = number
    return values[new], which


class Stream:
    """The tokens of a chunk, each text begun and ended by ``END``, and what is known of their runs.

    Totals are held once for each distinct run, and each token holds the number of its run, so that little is as long
    as the chunk.
    """

    def __init__(self, held: list[bool], sizes: list[int], data: bytes):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        starts = np.cumsum([0] + [n + 1 for n in sizes])
        hashes = [np.empty(0, np.uint64)]
        n = np.full(len(sizes), 2)
        first = 0
        space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
        while first < len(raw):
            # Cut at white space, wherever texts end.
            at = np.searchsorted(space, first + SLICE)
            last = int(space[at]) if at < len(space) else len(raw)
            h, _, ends = word_hashes(raw[first:last], np.array([0, last - first]))
            hashes.append(h)
            n += np.bincount(np.searchsorted(starts, ends[:, 0] + first, side="right") - 1, minlength=len(sizes))
            first = last + 1
        self.begin = np.cumsum(n) - n
        self.n_tokens = n - 1
        word = np.ones(int(n.sum()), bool)
        word[self.begin] = word[self.begin + self.n_tokens] = False
        self.token = np.full(len(word), END)
        self.token[word] = np.concatenate(hashes)
        self.place = np.arange(len(word), dtype=np.int32)
        self.place -= np.repeat(self.begin.astype(np.int32), n)
        self.train = np.repeat(~np.array(held, bool), n)
        # By length: distinct runs, which of them ends at each token (from 1, 0 for none), totals after a zero for none.
        self.keys, self.which, self.totals, self.kinds = {}, {}, {}, {}

    def run(self, words: int) -> np.ndarray:
        """Hash of the run of so many words that ends at each token."""
        out = self.token
        for n in range(2, words + 1):
            shorter, out = out, out.copy()
            for a in range(1, len(out), PIECE):
                b = min(a + PIECE, len(out))
                out[a:b] = mix(shorter[a - 1 : b - 1] * STEP + self.token[a:b] + np.uint64(n))
        return out

    def ask(self, words: int) -> None:
        """Find the runs of so many words that are asked for."""
        there = self.place >= max(words - 1, 1)
        if words > 2:
            there[1:] &= (self.totals[words - 1] >= 2)[self.which[words - 1][:-1]]
        self.keys[words], found = distinct(self.run(words)[there])
        found += 1
        self.which[words] = which = np.zeros(len(self.token), np.int32)
        which[there] = found
        if words == 1:
            # A text starts as often as it ends.
            which[self.begin] = which[self.begin + self.n_tokens]

    def contexts(self, words: int) -> np.ndarray:
        """Which runs of so many words (after the place for none) are asked for as contexts: those before a token, twice or more."""
        used = np.zeros(len(self.totals[words]), bool)
        used[self.which[words][:-1][self.place[1:] >= words]] = True
        return used & (self.totals[words] >= 2)

    def count(self, words: int, at: np.ndarray) -> np.ndarray:
        """How often the runs of so many words that end at these tokens are in training."""
        return self.totals[words][self.which[words][at]]

    def gains(self, words: int, used: np.ndarray) -> list[np.ndarray]:
        """What the tokens add to the contexts used: a context's gain, and a part of its symbols each."""
        gain, kinds = np.zeros(len(used)), np.zeros(len(used))
        for first in range(0, len(self.token), PIECE):
            at = first + np.flatnonzero(self.place[first : first + PIECE] >= words)
            at = at[used[self.which[words][at - 1]]]
            n, total = np.maximum(self.count(words + 1, at), 1), self.count(words, at - 1)
            shorter = np.maximum(self.count(words, at), 1) / (np.maximum(self.count(words - 1, at - 1), 1) if words > 1 else self.total)
            train, context = self.train[at], self.which[words][at - 1]
            np.add.at(gain, context, (np.log(n / total / shorter) - np.log(total) / (2 * n)) * train * GAIN_UNIT)
            np.add.at(kinds, context, train / n * KIND_UNIT)
        return [np.rint(v[used]).astype(np.int64) for v in (gain, kinds)]

    def learn(self, context: bool, words: int, totals: np.ndarray) -> None:
        """Take the totals of the keys asked for, in their order."""
        if context:
            self.kinds[words] = np.zeros(len(self.totals[words]), np.int64)
            self.kinds[words][self.contexts(words)] = totals
        else:
            self.ask(words)
            self.totals[words] = np.concatenate([[0], totals])

    def question(self, chunk: str, context: bool, words: int, parts: int) -> Iterator[tuple]:
        if context:
            used = self.contexts(words)
            keys, sums = self.keys[words][used[1:]], self.gains(words, used)
        else:
            self.ask(words)
            # A text's start is not counted, its end is.
            counted = self.which[words][self.train & (self.place > 0)]
            keys, sums = self.keys[words], [np.bincount(counted, minlength=len(self.keys[words]) + 1)[1:]]
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            packed = [pack(v[a:b]) for v in sums]
            yield chunk, context, words, int(part[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0))), packed[0], packed[1] if context else None

    def scores(self, total: int, distinct: int, discount: float) -> list[np.ndarray]:
        """Known tokens, base score and score of each text."""
        out = [[], [], []]
        for first, last in slices(np.append(self.begin, len(self.token)), PIECE):
            n_tokens = self.n_tokens[first:last]
            start = self.begin[first]
            at = start + np.flatnonzero(self.place[start : start + int((n_tokens + 1).sum())] > 0)
            c = self.count(1, at)
            p = np.where(c > 0, c - discount, discount * distinct) / total if total else np.ones(len(at))
            for words in sorted(self.kinds):
                kinds = self.kinds[words][self.which[words][at - 1]]
                longer = (self.count(words + 1, at) + kinds * p) / np.maximum(self.count(words, at - 1) + kinds, 1)
                p = np.where(kinds > 0, longer, p)
            base = np.log10(c + 1) - np.log10(total + distinct + 1)
            texts = np.cumsum(n_tokens) - n_tokens
            for sums, x in zip(out, ((c > 0).astype(np.int64), base, np.log10(p)), strict=True):
                sums.append(np.add.reduceat(x, texts))
        return [np.concatenate(sums) for sums in out]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "context", "words", "part", "keys", "a", "b"])


def _first_questions(parts: int):
    """Single words and pairs, for which nothing must be known."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                stream = Stream(row["held"], row["sizes"], row["data"])
                for words in (1, 2):
                    yield from _table(list(stream.question(row["chunk"], False, words, parts))).to_batches()

    return ask


def _known(chunk: pa.Table, answers: pa.Table, total: int) -> tuple[dict, Stream]:
    """The chunk's row and its stream with all answers given so far."""
    row = chunk.to_pylist()[0]
    stream = Stream(row["held"], row["sizes"], row["data"])
    stream.total = total
    given: dict[tuple, list] = {}
    for a in answers.to_pylist():
        given.setdefault((a["words"] + a["context"], a["context"], a["words"]), []).append((a["part"], a["a"]))
    # A context's answer needs the counts of runs one word longer.
    for _, context, words in sorted(given):
        blobs = sorted(given[words + context, context, words])
        stream.learn(context, words, np.concatenate([unpack(b, np.int64) for _, b in blobs]))
    return row, stream


def _further_questions(words: int, depth: int, parts: int, total: int):
    """Contexts of ``words`` words, and the runs that one word more before them makes."""

    def ask(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, stream = _known(chunk, answers, total)
        # A chunk may have asked for no run of this length.
        stream.totals.setdefault(words + 1, np.zeros(1, np.int64))
        stream.which.setdefault(words + 1, np.zeros(len(stream.token), np.int32))
        rows = list(stream.question(row["chunk"], True, words, parts))
        if words < depth:
            rows += stream.question(row["chunk"], False, words + 2, parts)
        return _table(rows)

    return ask


def _answered(total: int):
    """Totals of a range of keys, given back to each chunk in its order."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        context, words, part = rows[0]["context"], rows[0]["words"], rows[0]["part"]
        asked = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        keys, back = distinct(np.concatenate(asked))
        sums = np.bincount(back, np.concatenate([unpack(r["a"], np.int64) for r in rows]), len(keys))
        if context:
            kinds = np.bincount(back, np.concatenate([unpack(r["b"], np.int64) for r in rows]), len(keys))
            sums = np.where(sums > np.log(total) * GAIN_UNIT, np.rint(kinds / KIND_UNIT), 0)
        sums = sums.astype(np.int64)
        ends = np.cumsum([0] + [len(k) for k in asked])
        out = [pack(sums[back[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        # One row more tells tokens, distinct ones, those seen once and twice (or states kept).
        stats = [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]
        n = len(rows) + 1
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows] + [None], pa.string()),
                "context": pa.array([context] * n, pa.bool_()),
                "words": pa.array([words] * n, pa.int32()),
                "part": pa.array([part] * n, pa.int32()),
                "a": pa.array(out + [None], pa.binary()),
                "stats": pa.array([None] * len(rows) + [stats], pa.list_(pa.int64())),
            }
        )

    return add


def _scored(depth: int, total: int, distinct: int, discount: float):
    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row, stream = _known(chunk, answers, total)
        n_known, base, model = stream.scores(total, distinct, discount)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(stream.n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * len(base), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(model),
            }
        )

    return score


def language_model_scores(docs: DataFrame, folds: int = 7, held: int = 2, depth: int = DEPTH) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold_of(F.col("doc_id"), folds) == held).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    with text_batches(docs.sparkSession):
        chunks = stage(rows.mapInArrow(packed_chunks, CHUNKS), "lm-chunks")
    # A range gets about as many keys as a chunk has.
    parts = max(PARTS, chunks.count())

    def answered(asked: DataFrame, total: int) -> DataFrame:
        with shuffles_dropped(docs.sparkSession):
            return stage(asked.groupBy("context", "words", "part").applyInArrow(_answered(total), ANSWERS), "lm-answers")

    answers = answered(chunks.mapInArrow(_first_questions(parts), ASKED), 0)
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]
    total, distinct, once, twice = answers.where("chunk is null and words = 1").agg(*sums).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    given = answers.where("chunk is not null")

    def by_chunk():
        return chunks.groupBy("chunk").cogroup(given.drop("stats").groupBy("chunk"))

    for words in range(1, depth + 1) if total else ():
        asked = by_chunk().applyInArrow(_further_questions(words, depth, parts, total), ASKED)
        given = given.unionByName(answered(asked, total).where("chunk is not null"))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk().applyInArrow(_scored(depth, total, distinct, discount), result)
