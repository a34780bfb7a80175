"""Host-level quality rules with shrunk failure rates.

Each document is measured and tested by document rules. Per host (``source``) the failures are
added up; hosts' rates are shrunk by a beta prior fitted to all hosts (method of moments), so a host
with few documents is judged mostly by what hosts are like. A host whose shrunk rate exceeds
``max_rate`` is bad, and the verdict is joined back: a document is kept if it passes the base rules,
its host is not bad, and it fails fewer than ``max_failures`` of the softer rules.

Only built-in expressions. The text is read once: the measures are stored without it. Failures are
added up per task before their shuffle; the few host rows are joined back, by broadcast if their
measured size allows, otherwise as a join that adaptive execution splits on large hosts.

Defined results: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows count each; with fewer than two hosts, or no spread between them, the prior has the
weight of one document. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.text import words
from roadpulse.session import stage

WIDTH = 5
GAPS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def repeated_window_words(hashes: Column) -> Column:
    """Of an array of word hashes, how many positions lie in a five-word window found twice or more.

    Windows are hashed, sorted with their places, and those equal to a neighbour are taken; sorted
    by place again, each adds what it does not share with the next: linear but for the two sorts.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WIDTH),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]),
    )
    return F.when(F.size(hashes) >= WIDTH, windows)


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source and the base measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    df = df.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    df = df.select(
        "doc_id",
        "source",
        F.size("hashes").cast("long").alias("n_words"),
        F.length(F.translate("text", GAPS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        repeated_window_words(F.col("hashes")).alias("windows"),
    )
    # Only texts with some repeated window are sorted.
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        "sorted",
        lambda x, j: (x["h"] == F.get("sorted", j - 1)["h"]) | (x["h"] == F.get("sorted", j + 1)["h"]),
    )
    df = df.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("places", lambda p, j: F.least(F.lit(WIDTH), F.coalesce(F.get("places", j + 1) - p, F.lit(WIDTH)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.select(
        "doc_id",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )


def host_verdicts(failures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """(source, failed boolean) rows to source, n, failures, shrunk rate and verdict."""
    hosts = stage(failures.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures")), "hosts")
    rate = F.col("failures") / F.col("n")
    # Pooled mean, and the part of the spread between hosts that sampling does not explain.
    mean = F.sum("failures") / F.sum("n")
    moments = hosts.agg(
        mean.alias("mean"),
        F.var_samp(rate).alias("var"),
        F.avg(1 / F.col("n")).alias("inverse"),
    ).first()
    m = min(max(moments["mean"] if moments["mean"] is not None else 0.5, 1e-6), 1 - 1e-6)
    between = (moments["var"] or 0.0) - m * (1 - m) * (moments["inverse"] or 0.0)
    strength = max(m * (1 - m) / between - 1, 1.0) if between > 0 else 1.0
    if between <= 0 and moments["var"] is not None:
        # Hosts differ no more than chance: rates are drawn close to the mean.
        strength = 1e4
    shrunk = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > max_rate)


def host_quality(docs: DataFrame, max_rate: float = 0.5, max_failures: int = 1) -> DataFrame:
    """Per row: the base measures, base_failed, n_failed soft rules, the host's rate, and kept."""
    df = stage(measures(docs), "measures")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    chars = F.greatest("word_chars", F.lit(1))
    per_word = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    soft = [
        F.col("n_symbols") * 100 > chars * 5,
        F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
        (per_word < 2) | (per_word > 20),
    ]
    df = df.withColumn("base_failed", base).withColumn("n_failed", sum((c.cast("int") for c in soft[1:]), soft[0].cast("int")))
    failed = F.col("base_failed") | (F.col("n_failed") > 0)
    hosts = host_verdicts(df.select("source", failed.alias("failed")), max_rate).select(F.col("source").alias("host"), "host_rate", "host_bad")
    out = df.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & ~F.col("host_bad") & (F.col("n_failed") < max_failures)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_failed", "host_rate"
    )
