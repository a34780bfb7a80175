"""The pipeline on the smallest tables, and its stages on planted cases."""

from __future__ import annotations

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))


def test_stages_keep_the_columns(shipped, documents):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60))
    item = shipped.read.parquet(f"{SF}/benchmark.parquet").first().text
    one = text()
    rows = [(10**6 + i, text(), f"s{i % 2}") for i in range(30)] + [(10**6 + 100, one, "s0"), (10**6 + 101, one + " end", "s1"), (10**6 + 102, text() + " " + item, "s0")]
    docs = documents(rows + ODD)
    ids = lambda df: sorted(r.doc_id for r in df.collect() if r.doc_id is not None and r.doc_id >= 10**6)
    for name, function in corpus_pipeline.STAGES[:4]:
        out = function(shipped, docs, SF)
        assert out.columns == docs.columns, name
        if name == "near_dup":
            assert ids(out) == [i for i in sorted(r[0] for r in rows) if i != 10**6 + 101]
        if name == "decontamination":
            assert ids(out) == [i for i in sorted(r[0] for r in rows) if i != 10**6 + 102]
        if name == "toxicity":
            assert ids(out) == sorted(r[0] for r in rows)
        assert function(shipped, docs.limit(0), SF).count() == 0
    assert "shard" in corpus_pipeline.STAGES[4][1](shipped, docs, SF).columns


def test_rows_of_one_id_are_decided_each(shipped, documents, tmp_path):
    rng = random.Random(3)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60)) for _ in range(4))
    item = shipped.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "s"), (7, c, "s"), (7, c, "s"), (9, "", "s"), (9, "", "s")]
    kept = corpus_pipeline.drop_near_duplicates(shipped, documents(rows), SF)
    assert texts(kept) == sorted([(5, a), (3, b), (7, c), (9, ""), (9, "")])
    # Rows without an id are decided by their text.
    kept = corpus_pipeline.drop_near_duplicates(shipped, documents([(None, a, "s"), (5, a, "s"), (None, c, "s"), (None, c, "t"), (None, None, "s")]), SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, a), (0, c), (0, "")])
    kept = corpus_pipeline.drop_benchmark_leaks(shipped, documents([(None, d + " " + item, "s"), (None, d, "s")]), SF)
    assert [r.text for r in kept.collect()] == [d]
    kept = corpus_pipeline.drop_benchmark_leaks(shipped, documents([(8, d, "s"), (8, c + " " + item, "s")]), SF)
    assert texts(kept) == [(8, d)]
    bad = "You are a worthless idiot. "
    given = [(i, (bad if i % 2 else "") + " ".join(rng.choices((a + " " + b).split(), k=60)), "s") for i in range(400)]
    labels = shipped.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(shipped, documents(given + [(1001, bad + a, "s"), (1001, b, "s"), (None, bad + c, "s"), (None, d, "s")]), str(tmp_path))
    assert [r.text for r in kept.collect() if r.doc_id is None] == [d]
    assert [r.text for r in kept.collect() if r.doc_id == 1001] == [b]


def test_run(shipped):
    out = corpus_pipeline.run(shipped, SF)
    assert out.count() > 0 and "shard" in out.columns
