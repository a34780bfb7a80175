"""Faults found in the third round."""

from __future__ import annotations

import itertools
import os
import tracemalloc
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadpulse.llm import decontaminate, near_dup, suffix_tree
from roadpulse.operators import histogram_trees, runs
from roadpulse.plans import bindings, queries

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


def test_mean_speed_in_any_order(spark):
    """a mean that is a whole number stays in its bin, however the runs are ordered."""
    parts = [(3400.0, 30), (4800.0, 90), (2000.0, 90), (1100.0, 30), (4000.0, 90)]
    rows = [(datetime(2024, 1, 1), g, 0, *run) for g, order in enumerate(itertools.permutations(parts)) for run in order]
    found = spark.createDataFrame(rows, "w timestamp, x int, y int, length double, seconds long").coalesce(1)
    speeds = runs.cell_speed(runs.with_run_speed(found))
    binned = speeds.select("speed", histogram_trees.binned(F.col("speed"), 1.0).alias("bin"), "num").distinct().collect()
    assert [tuple(r) for r in binned] == [(54.0, 54.0, 5)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
def test_month_scan_reads_every_month(spark):
    """the trips of all months are counted, each once."""
    trips = queries.queries()["month_scan"](spark, SF_DIR).agg(F.sum("trips")).first()[0]
    assert trips == bindings.trajectory_2016(spark, SF_DIR).count()


def test_latent_space_is_fitted_on_every_text(spark, monkeypatch):
    """all words of all documents are in the fit, however many documents there are."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 900}" for k in range(i % 90))) for i in range(2600)]
    seen = []
    own = decontaminate.latent_space

    def spy(passages, idf, *rest):
        seen.append(sum(len(r.terms) // (2 if isinstance(r.terms, (bytes, bytearray)) else 1) for r in passages.collect()))
        return own(passages, idf, *rest)

    monkeypatch.setattr(decontaminate, "latent_space", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string")
    decontaminate.contaminated(docs, bench)
    assert seen == [sum(i % 90 for i in range(2600)) + 20]


def test_latent_space_of_whole_texts(spark):
    """The directions are those of all passages' TF-IDF rows, as plain algebra finds them."""
    rng = np.random.default_rng(3)
    idf = np.full(decontaminate.TERMS, 2.0)
    idf[:50] = 0.5
    length = decontaminate.STEP * decontaminate.STEPS
    texts = [(rng.integers(0, 12, int(n)) * (i % 40 + 1)).astype(np.uint16) for i, n in enumerate(rng.integers(0, 300, 200))]
    weights = rng.uniform(0.5, 2, len(texts))
    matrix = []
    for text, weight in zip(texts, weights, strict=True):
        for k in range(0, len(text), length):
            row = np.bincount(text[k : k + length], minlength=decontaminate.TERMS) * idf
            matrix.append(row[:1000] / np.linalg.norm(row) * weight)
    matrix = np.array(matrix)
    rows = [(bytearray(t.tobytes()), float(w)) for t, w in zip(texts, weights, strict=True)]
    found = decontaminate.latent_space(spark.createDataFrame(rows, "terms binary, weight double").repartition(5), idf, 8)
    best = np.linalg.svd(matrix)[1][:8]
    assert np.linalg.norm(matrix @ found[:1000]) >= 0.98 * np.linalg.norm(best)


def test_sums_of_runs():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 9, (50, 3)).astype(np.float32)
    size = np.array([1, 2, 31, 32, 33, 5_000, 1, 70])
    index = rng.integers(0, 50, size.sum())
    start = np.cumsum(size) - size
    assert (decontaminate.run_sums(values, index, start) == np.add.reduceat(values[index], start, axis=0)).all()


def test_each_product_takes_part_in_the_span(spark, monkeypatch):
    """op10_decontamination: no pass over all passages beyond the products that widen the span."""
    taken = []
    own = decontaminate._times_transposed

    def spy(idf, thin):
        taken.append(thin)
        return own(idf, thin)

    monkeypatch.setattr(decontaminate, "_times_transposed", spy)
    rng = np.random.default_rng(5)
    rows = [(bytearray(rng.integers(0, 900, 60).astype(np.uint16).tobytes()), 1.0) for _ in range(50)]
    found = decontaminate.latent_space(spark.createDataFrame(rows, "terms binary, weight double"), np.ones(decontaminate.TERMS), 8)
    assert len(taken) == decontaminate.POWER
    assert np.allclose(found.T @ found, np.eye(8), atol=1e-4)


def test_fewer_passages_than_directions(spark):
    """The span of few passages is found whole, and its other directions are finite."""
    rows = [(bytearray(np.arange(k * 20, k * 20 + 30, dtype=np.uint16).tobytes()), 1.0) for k in range(5)]
    found = decontaminate.latent_space(spark.createDataFrame(rows, "terms binary, weight double"), np.ones(decontaminate.TERMS), 8)
    assert np.isfinite(found).all()
    for k in range(5):
        assert abs(np.linalg.norm(found[k * 20 : k * 20 + 30].sum(axis=0)) - 30**0.5) < 1e-3


def test_few_leaks_are_dropped_without_a_shuffle_of_texts(spark):
    """pipeline, decontamination: the documents' texts stay where they are when few ids are dropped."""
    words = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"a {words} z" if i % 9 == 0 else f"w{i} x y z") for i in range(40)], "doc_id long, text string")
    kept = decontaminate.clean_documents(docs, spark.createDataFrame([(1, words)], "item_id long, text string"))
    assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(40) if i % 9]


def test_distinct_keys():
    for n in (0, 1, 500):
        keys = np.random.default_rng(n).integers(0, 90, n)
        assert (decontaminate.distinct(keys) == np.unique(keys)).all()


def test_sums_of_a_task_are_bounded(monkeypatch):
    """pipeline, decontamination: a task of the fit sums few terms at a time, with the same result."""
    sizes = []
    own = decontaminate.run_sums

    def spy(values, index, start):
        sizes.append(len(start))
        return own(values, index, start)

    monkeypatch.setattr(decontaminate, "run_sums", spy)
    monkeypatch.setattr(decontaminate.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    rng = np.random.default_rng(8)
    text = rng.permutation(decontaminate.TERMS)[:20_000].astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array([text.tobytes()], pa.binary()), pa.array([2.0])], ["terms", "weight"])
    basis = rng.standard_normal((decontaminate.TERMS, 3), dtype=np.float32)
    parts = list(decontaminate._times_transposed(np.ones(decontaminate.TERMS), decontaminate._thin(basis))(iter([batch])))
    assert max(sizes) <= 4_096
    found = np.zeros(basis.shape, np.float32)
    for _, task, used, rows in (r.values() for p in parts for r in p.to_pylist()):
        assert task == 3
        found[np.frombuffer(used, np.int32)] += np.frombuffer(rows, np.float32).reshape(-1, 3)
    length = decontaminate.STEP * decontaminate.STEPS
    best = np.zeros(basis.shape)
    for k in range(0, len(text), length):
        own_terms = text[k : k + length]
        best[own_terms] += basis[own_terms].sum(axis=0) * 4 / len(own_terms)
    assert np.allclose(found, best, atol=1e-4)


def test_decontamination_leaves_no_broadcast_behind(spark):
    """pipeline, decontamination: the fit's matrices go from the disks with the step that reads them."""

    def kept() -> int:
        top = spark.sparkContext._temp_dir
        return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)

    words = " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"a {words} z" if i % 9 == 0 else " ".join(f"w{i * 500 + k}" for k in range(500))) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    before = kept()
    found = decontaminate.contaminated(docs, bench)
    assert sorted(r.doc_id for r in found.collect()) == [i for i in range(40) if i % 9 == 0]
    assert kept() - before < 1 << 20


def test_few_passages_make_few_parts_of_the_fit(spark, monkeypatch):
    """pipeline, decontamination: a task's part of a product is as large as all terms, so small corpora get few tasks."""
    parts = []
    own = decontaminate.latent_space

    def spy(passages, *args):
        parts.append(passages.rdd.getNumPartitions())
        return own(passages, *args)

    monkeypatch.setattr(decontaminate, "latent_space", spy)
    docs = spark.createDataFrame([(i, f"w{i} x y z") for i in range(40)], "doc_id long, text string").repartition(4)
    decontaminate.contaminated(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    assert parts == [1]
    assert [decontaminate.fit_tasks(n, 6) for n in (0, 1, 200_001, 600_000, 3_000_000, 30_000_000)] == [1, 1, 2, 3, 6, 15]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are absent")
def test_stages_with_workers_get_small_batches(spark, monkeypatch):
    """pipeline: whole texts stand in executors and workers a thousand rows at a time; the session's setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    for module, function in ((corpus_pipeline.toxicity, "toxicity_scores"), (near_dup, "near_duplicates"), (decontaminate, "clean_documents")):

        def spy(*args, own=getattr(module, function), **more):
            seen.append(int(spark.conf.get(name)))
            return own(*args, **more)

        monkeypatch.setattr(module, function, spy)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    for _, function in corpus_pipeline.STAGES[:3]:
        function(spark, docs, SF_DIR)
        assert spark.conf.get(name) == before
    assert seen == [1_000] * 3


def test_links_of_a_group_in_several_batches():
    """pipeline, near_dup: a group that comes in several batches gives the same links."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.append(np.arange(40), rng.integers(100, 200, 3))) for _ in range(30)]
    columns = [list(range(30)), [0 if i < 10 else i for i in range(30)], [i >= 10 for i in range(30)], [s.tolist() for s in sets]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "component", "outside", "shingles"])
    links = near_dup._outside_links(75)
    whole, cut = links(pa.Table.from_batches([batch])), links(pa.Table.from_batches([batch.slice(k, 7) for k in range(0, 30, 7)]))
    assert whole.num_rows and whole.equals(cut)


def test_suffix_tree_memory_of_a_chunk(monkeypatch):
    """F1, op5_suffix_tree: a task holds 54 bytes for each token of its chunk; it held 148."""
    monkeypatch.setattr(suffix_tree, "PIECE", 1 << 13, raising=False)
    monkeypatch.setattr(suffix_tree, "SLICE", 1 << 14)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 1000) % 5000).encode() for _ in range(200)]
    ids = pa.array(range(len(texts)), pa.int64())
    rows = pa.RecordBatch.from_arrays([ids, pa.array([i % 7 == 2 for i in range(len(texts))]), pa.array(texts, pa.binary())], ["doc_id", "held_out", "text"])
    chunk = pa.Table.from_batches(suffix_tree.packed_chunks([rows]))
    # The table of powers stays with the process.
    suffix_tree.word_hashes(np.zeros(1, np.uint8), np.array([0, 1]))
    assert chunk.num_rows == 1

    def answers(asked, total):
        given = [suffix_tree._answered(total)(asked.take([i])) for i in range(asked.num_rows)]
        return pa.concat_tables(g.filter(g["chunk"].is_valid()) for g in given).drop_columns("stats")

    most = []

    def held(work):
        tracemalloc.start()
        out = work()
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    given = answers(pa.Table.from_batches(held(lambda: list(suffix_tree._first_questions(4)(chunk.to_batches())))), 0)
    total = sum(len(t.split()) + 1 for i, t in enumerate(texts) if i % 7 != 2)
    for words in (1, 2):
        asked = held(lambda words=words, given=given: suffix_tree._further_questions(words, 2, 4, total)(chunk, given))
        given = pa.concat_tables([given, answers(asked, total)])
    scores = held(lambda: suffix_tree._scored(2, total, 5000, 0.5)(chunk, given))
    assert sum(scores["n_tokens"].to_pylist()) == 200 * 1001
    assert max(most) < 80 * 200 * 1001, [m / (200 * 1001) for m in most]


def test_suffix_tree_leaves_no_shuffle_files(spark, monkeypatch):
    """F1, op5_suffix_tree: the shuffle files of a step go when its answers are stored."""
    own, left = suffix_tree.stage, []
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        return {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}

    def spy(df, name):
        before = shuffle_files()
        out = own(df, name)
        left.append((name, len(shuffle_files() - before)))
        return out

    monkeypatch.setattr(suffix_tree, "stage", spy)
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(60))) for i in range(200)]
    suffix_tree.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert left[1:] == [("lm-answers", 0)] * 3
