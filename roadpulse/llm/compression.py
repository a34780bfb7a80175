"""Quality from compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, all of them used, and each is compressed on its own
with a dictionary trained on good and one trained on bad text. Blocks keep the dictionaries'
part in the result alike for texts of any length. The difference of the two sizes by their sum is
the main feature; the smaller size by the block's length (how repetitive it is) and how the
difference is spread over the blocks go with it into a logistic model that calibrates the score.

Dictionaries are trained on at most ``MAX_BLOCKS`` blocks per class, from at most ``max_rows``
labelled rows outside the held-out fold; other rows of that sample calibrate.

Defined results: null and empty texts count as one empty block; a null ``doc_id`` counts as the
empty text in the split; repeated rows are scored alike; equal texts count once in fitting; with
too few labelled rows to train, every score is 0.5. Other columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.labels import fit_logistic, labelled_sample, probability
from roadpulse.llm.text import fold_of
from roadpulse.session import stage

BLOCK, MAX_BLOCKS, DICTIONARY, LEVEL = 1024, 4000, 1 << 16, 3
MAX_ROWS = 16_000


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(b, label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in blocks_of(text)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.int32())], ["block", "label"])


def train_dictionary(blocks: list[bytes]) -> bytes | None:
    """A dictionary of labelled blocks; None if there is too little text."""
    if sum(map(len, blocks)) < 4096:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        # Too few blocks for the trainer: their text itself serves as the dictionary.
        return b"".join(blocks)[-DICTIONARY:]


class Compressors:
    NAMES = ("difference", "ratio", "lowest", "highest", "spread", "length", "product", "square")

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> list[float]:
        blocks = blocks_of(text)
        good, bad = ([compress(b) for b in blocks] for compress in self.by)
        g, b = np.array([len(x) for x in good], float), np.array([len(x) for x in bad], float)
        each = (b - g) / (b + g)
        difference = float((b.sum() - g.sum()) / (b.sum() + g.sum()))
        ratio = float(np.minimum(g, b).sum() / (len(text) + 16))
        return [difference, ratio, float(each.min()), float(each.max()), float(each.std()), float(np.log1p(len(text))), difference * ratio, ratio * ratio]


def _features(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(good, bad)
        for batch in batches:
            x = [tool.features(t or b"") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    return run


def _scores(dictionaries: tuple[bytes, bytes] | None, weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Compressors(*dictionaries) if dictionaries else None
        for batch in batches:
            if tool:
                x = np.array([tool.features(t or b"") for t in batch.column(2).to_pylist()]).reshape(-1, len(tool.NAMES))
                score, difference = probability(weights, x), x[:, 0]
            else:
                score, difference = np.full(batch.num_rows, 0.5), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(difference)],
                ["doc_id", "held_out", "score", "predicted", "difference"],
            )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, difference (normalised)."""
    sample = labelled_sample(docs, labels, "quality", folds, held, max_rows)
    sample = stage(sample.select(F.col("text").cast("binary").alias("text"), "label", "part"), "quality-sample")
    cut = sample.where("part < 6").select("text", "label").mapInArrow(_cut, "block binary, label int")
    trained = [
        train_dictionary([bytes(r.block) for r in cut.where(F.col("label") == k).orderBy(F.xxhash64("block")).limit(MAX_BLOCKS).select("block").collect()]) for k in (1, 0)
    ]
    dictionaries = (trained[0], trained[1]) if all(trained) else None
    weights = np.zeros(1)
    if dictionaries:
        rows = sample.where("part >= 6").select("text", "label").mapInArrow(_features(*dictionaries), "x array<double>, label int").toArrow()
        x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(Compressors.NAMES))
        weights = fit_logistic(x, rows.column("label").to_numpy().astype(float))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    return df.mapInArrow(_scores(dictionaries, weights, threshold), "doc_id long, held_out boolean, score double, predicted int, difference double")
