"""License scans by diagonal voting.

Words are runs of digits, letters and non-ASCII characters, A-Z as a-z. A license is known by one
or more templates, texts of its notice or of its terms.

1. Every window of ``K`` words of every text, as a rolling hash with its place, is joined by Spark
   with the windows of the templates; the template side has a row per template word and is small by
   construction.
2. A match of text place p and template place t votes for the diagonal p - t. Votes are counted per
   (text, template, diagonal): a copied passage is many votes on one diagonal.
3. An inserted or missing word moves the rest of a passage to a neighbouring diagonal. Diagonals of
   a text and template within ``SLACK`` of the next one are merged, places in order, into one
   candidate span.
4. Candidates with enough of a template's windows are verified on the words themselves: the longest
   common subsequence of span and template must reach ``SHARE`` of the template's words.

Equal texts are one key, so copies are voted on once; the result comes back to all rows by key. Only
texts that hold a candidate are read a second time: a bit array of fixed size tells which.

Besides, places of fixed phrases are counted exactly; their labels always stand.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows have a
row each; a null ``doc_id`` stays; no rows give no rows. Other columns are ignored. Texts are
handled whole; a span reaches from the first to the last window of its diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.llm.text import column_bytes, mix, slices, word_hashes
from roadpulse.session import stage

#: Words of a window; diagonals that differ by no more are one passage; the share that verifies it.
K, SLACK, SHARE = 4, 6, 0.8
#: Windows of a template that must vote, as a share of its own, before words are compared.
VOTES = 0.4
#: Bits that mark texts with candidates.
BITS = 1 << 23
#: Bytes of words: digits, letters and everything outside ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wordings of common licenses and notices, by label.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "distributed under the terms of the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
)


@dataclass
class Words:
    """Word hashes of rows laid end to end, the bounds of each row among them, and each word's bytes."""

    hashes: np.ndarray
    bounds: np.ndarray
    spans: np.ndarray


def row_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    h, row, spans = word_hashes(data, offsets, _INSIDE)
    return Words(h, np.searchsorted(row, np.arange(len(offsets))), spans)


def raw_words(raw: np.ndarray) -> np.ndarray:
    return row_words(raw, np.array([0, len(raw)])).hashes


def text_words(text: str) -> np.ndarray:
    return raw_words(np.frombuffer(text.encode(), np.uint8))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of ``k`` words; windows across rows are the caller's to drop."""
    if len(h) < k:
        return h[:0]
    step = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i : len(out) + i]) * step
    return mix(out)


def template_windows(spark: SparkSession, templates: tuple, k: int) -> DataFrame:
    """(gram, template, at) of every window of the templates."""
    rows = [(int(g), n, at) for n, (_, text) in enumerate(templates) for at, g in enumerate(window_hashes(text_words(text), k).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def text_key() -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"))


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                w = row_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams = window_hashes(w.hashes, k).view(np.int64)
                # A row of n words has n - k + 1 windows, from its first word on.
                size = np.maximum(np.diff(w.bounds) - k + 1, 0)
                ends = np.cumsum(size)
                pick = np.arange(ends[-1]) + np.repeat(w.bounds[:-1] - (ends - size), size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(grams[pick]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["key", "grams"])

    return run


def votes(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """(key, template, diagonal, votes, first, last): matches of each diagonal of each text, and their places."""
    texts = docs.where("text is not null").select(text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    grams = texts.mapInArrow(_grams(k), "key struct<a: long, b: long>, grams array<long>")
    grams = grams.select("key", F.posexplode("grams").alias("place", "gram"))
    # At most one row per template word, however large the corpus.
    hits = grams.join(F.broadcast(template_windows(docs.sparkSession, templates, k)), "gram")
    # Copies of a text hit the same places.
    hits = hits.groupBy("key", "template", "place", "at").agg(F.lit(1).alias("_one"))
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    return hits.groupBy("key", "template", diagonal).agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))


def candidate_spans(voted: DataFrame, templates: tuple = TEMPLATES, k: int = K, slack: int = SLACK) -> DataFrame:
    """(key, template, first, last): words of merged diagonals with enough votes; ``last`` is the last word."""
    # The windows are those of one text and template: no more rows than the text has words.
    own = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(own) > slack
    part = F.sum(F.when(apart, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    spans = voted.withColumn("part", part).groupBy("key", "template", "part")
    spans = spans.agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    need = F.array(*[F.lit(max(1, int(np.ceil(VOTES * (len(text_words(text)) - k + 1))))) for _, text in templates])
    return spans.where(F.col("votes") >= F.get(need, F.col("template"))).select("key", "template", "first", "last")


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; ``b`` is the template."""
    best = np.zeros(len(b) + 1, np.int64)
    for word in a[np.isin(a, b)]:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(b == word, best[:-1] + 1, 0)))
    return int(best[-1])


def _based(phrases: dict[str, str]):
    """(words, first_word, last_word, places, base labels) per row from its word hashes."""
    wanted = [(text_words(p), label) for p, label in phrases.items()]

    def run(w: Words, rows: int) -> list[pa.Array]:
        size = np.diff(w.bounds)
        places, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
        labels: list[set[str]] = [set() for _ in range(rows)]
        for phrase, label in wanted:
            at = np.flatnonzero(w.hashes == phrase[0])
            for i in range(1, len(phrase)):
                at = at[at + i < len(w.hashes)]
                at = at[w.hashes[at + i] == phrase[i]]
            row = np.searchsorted(w.bounds, at, side="right") - 1
            inside = at + len(phrase) <= w.bounds[row + 1]
            at, row = at[inside], row[inside]
            places += np.bincount(row, minlength=rows)
            for r, p in zip(row, at - w.bounds[row], strict=True):
                first[r] = p if first[r] < 0 else min(first[r], p)
                last[r] = max(last[r], p)
                labels[r].add(label)
        none = first < 0
        base = pa.array([",".join(sorted(s)) for s in labels], pa.string())
        return [pa.array(size), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none), base]

    return run


_BASE = "n_words long, n_base long, first_word long, last_word long, base_labels string"


def _is_set(bits: np.ndarray, place: pa.Array) -> np.ndarray:
    at = place.to_numpy()
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _scan(phrases: dict[str, str], bits: np.ndarray):
    """Base columns of each row, its key, and whether its key's bit is set."""
    base = _based(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            maybe = pa.array(_is_set(bits, batch.column(3)))
            for a, b in slices(offsets):
                w = row_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, key, some = (c.slice(a, b - a) for c in (batch.column(0), batch.column(2), maybe))
                yield pa.RecordBatch.from_arrays(
                    [ids, *base(w, b - a), key, some], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "key", "maybe"]
                )

    return run


def _marked(bits: np.ndarray):
    """(key, text) of the rows whose key's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_is_set(bits, batch.column(2))))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["key", "text"])

    return run


def _verified(templates: tuple, share: float):
    """Spans of each text whose words follow a template closely enough, with the share of its words."""
    wanted = [text_words(text) for _, text in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = []
            lists = batch.column(2)
            for i in range(batch.num_rows):
                w = raw_words(data[offsets[i] : offsets[i + 1]])
                spans = []
                for s in lists[i].as_py():
                    words = wanted[s["template"]]
                    got = common_words(w[s["first"] : s["last"] + 1], words) / len(words)
                    if got >= share:
                        spans.append({**s, "share": got})
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["key", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("share", pa.float64())]))


def license_spans(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] | None = None, k: int = K, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, the base columns, and ``spans``: (template, first, last, share) of verified passages."""
    phrases = PHRASES if phrases is None else phrases
    spans = candidate_spans(votes(docs, templates, k), templates, k, slack)
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    spans = stage(spans, "license-spans")
    # At most BITS bits, packed 64 to a row.
    place = F.pmod(F.col("key.a"), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    packed = spans.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()

    place = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(BITS)).alias("place")
    text = F.col("text").cast("binary").alias("bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, text_key().alias("key"), place)
    base = rows.mapInArrow(_scan(phrases, bits), f"doc_id long, {_BASE}, key struct<a: long, b: long>, maybe boolean")
    base = stage(base, "license-base")
    texts = docs.where("text is not null").select(text_key().alias("key"), text, place)
    texts = texts.mapInArrow(_marked(bits), "key struct<a: long, b: long>, text binary")
    # One row per text: copies are merged within tasks first.
    texts = texts.groupBy("key").agg(F.any_value("text").alias("text"))
    verified = texts.join(spans, "key").mapInArrow(
        _verified(templates, share), "key struct<a: long, b: long>, spans array<struct<template: int, first: int, last: int, share: double>>"
    )
    verified = stage(verified.where(F.size("spans") > 0), "license-verified")
    none = F.array().cast(verified.schema["spans"].dataType)
    # Rows without candidates take no part in the join.
    found = base.where("maybe").join(verified, "key", "left").select(*base.columns, F.coalesce("spans", none).alias("spans"))
    return found.unionByName(base.where("not maybe").withColumn("spans", none)).drop("key", "maybe")


def license_labels(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template's words in a verified span, and half at least where
    a phrase stands.
    """
    names = F.array(*[F.lit(label) for label, _ in templates])
    rows = license_spans(docs, templates, phrases)
    own = F.transform("spans", lambda s: F.get(names, s["template"]))
    base = F.array_remove(F.split("base_labels", ","), "")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    phrase = F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.greatest(share, phrase).alias("score"))
