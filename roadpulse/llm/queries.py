"""One query per operator over its whole table, with production parameters, and the SQL of some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import (
    chat,
    compression,
    decontaminate,
    host_rules,
    html_blocks,
    licenses,
    merkle,
    merkle_sql,
    mixing,
    near_dup,
    slots,
    suffix_tree,
    toxicity,
    whitening,
)
from roadpulse.session import ship_package

#: A conversation that says nothing but the template's own control strings.
CONTROL_CASE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(_table(spark, sf_dir, "pages"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.host_quality(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(control)))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.language_model_scores(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_rows(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_rows(_table(spark, sf_dir, "embeddings"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_rows(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_html_blocks,
        op3_host_rules,
        op4_chat_format,
        op5_suffix_tree,
        op6_mixing,
        op7_near_dup,
        op8_compression,
        op9_slots,
        op10_decontamination,
        op11_whitening,
        op12_licenses,
        op13_merkle,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op3_host_rules": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ), w AS (
            SELECT rid, i, ws[i:i + 4] AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
        ), r AS (
            SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM w) WHERE n > 1
        ), c AS (
            SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) AS t(k) GROUP BY rid
        ), m AS (
            SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
            FROM d LEFT JOIN c USING (rid)
        ), f AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_symbols * 100 > greatest(word_chars, 1) * 5 OR n_dup_lines * 100 > n_lines * 30
                   OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 20 AS soft_failed
            FROM m
        ), h AS (
            SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS k FROM f GROUP BY source
        ), g AS (
            SELECT least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS m, var_samp(k / n) AS v, avg(1 / n) AS inv FROM h
        ), p AS (
            SELECT m, CASE WHEN v IS NULL THEN 1.0 WHEN v - m * (1 - m) * inv > 0 THEN greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1.0) ELSE 1e4 END AS s FROM g
        ), b AS (
            SELECT source, (k + m * s) / (n + s) > 0.5 AS bad FROM h, p
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT soft_failed AND NOT bad AS kept
        FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
    """,
    "op4_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) AS inner_chars
            FROM t
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(inner_chars + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 18 WHEN 'assistant' THEN 5
                   ELSE 19 + length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}


ORACLE_SQL["op13_merkle"] = merkle_sql.manifest_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
