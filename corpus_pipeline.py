"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: stages handle nulls, empty texts and extra columns as their operators do; no rows
give no rows. Rows are told apart by ``doc_id`` and text, those with a null ``doc_id`` by their text;
of copies with and without an id one with an id stays: other texts of a removed row's id stay, and one of the rows with an id and the same words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontaminate, mixing, near_dup, slots, toxicity
from roadpulse.llm.text import row_key
from roadpulse.session import ship_package, stage, text_batches


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not a ``doc_id`` of ``gone``."""
    gone = gone.where("doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, key == F.col("_gone"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    with text_batches(spark):
        scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=row_key())
        decisions = stage(scores.select("doc_id", (F.col("predicted") == 1).alias("toxic")), "toxic")
    return _without(docs, decisions.where("toxic"), row_key())


def _one_key_a_row(docs: DataFrame) -> DataFrame:
    """``docs`` and ``_key``: the id, or for null ids and ids with several texts a number above them; one of identical rows."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("_id"), row_key().alias("_row")).groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("n"))
    again = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_texts"), F.max("n").alias("_most")).where("_texts > 1 or _most > 1 or _id is null")
    again = stage(again.select("_id", F.when(F.col("_id").isNull(), 2).otherwise(F.col("_texts")).alias("_texts")), "again")
    if again.isEmpty():
        return docs.withColumn("_key", id_)
    above = F.shiftrightunsigned(row_key(), 2) + F.lit(1 << 62)
    keyed = docs.join(again, id_.eqNullSafe(F.col("_id")), "left").withColumn("_key", F.when(F.col("_texts") > 1, above).otherwise(id_))
    # Texts without words are copies of nothing.
    repeated = F.col("_texts").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = keyed.where(repeated).dropDuplicates(["_key"])
    return stage(keyed.where(~repeated).unionByName(one).select(*docs.columns, "_key"), "one-key")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    keyed = _one_key_a_row(docs)
    with text_batches(spark):
        decisions = near_dup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    return _without(keyed, decisions.where(~F.col("kept")), F.col("_key")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    with text_batches(spark):
        return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return slots.sharded_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned scores, hash draws and components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
