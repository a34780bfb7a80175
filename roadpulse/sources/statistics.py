"""Readers and writers of statistics: link times, link speeds, panels, no-signal cells, results.

The default store is parquet. The text forms keep one line per road or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.timing import format_time, parse_time
from roadpulse.spec import GridSpec

# Roads per line of the link speed text form.
ROADS_PER_LINE = 4096
#: Rows of a panel file at most, and ranges of a stored change ranking.
ROWS_PER_FILE, CHANGE_PARTS = 4_000_000, 32
_RANKS = "w timestamp, diff double, part int"


def _tuples(spark: SparkSession, path: str, parts_only: bool = True) -> DataFrame:
    """``head|(a,b,c)|(d,e,f)...`` lines as rows (head, v array<string>), one per tuple."""
    reader = spark.read.option("pathGlobFilter", "part*") if parts_only else spark.read
    lines = reader.text(path).filter(F.trim("value") != "")
    return lines.select(
        F.trim(F.substring_index("value", "|", 1)).alias("head"),
        F.explode(F.regexp_extract_all("value", F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("tuple"),
    ).select("head", F.split("tuple", r"\s*,\s*").alias("v"))


def read_link_stats(spark: SparkSession, path: str) -> DataFrame:
    """``edge|(time,seconds,num)|...`` of a result folder's part files."""
    return _tuples(spark, path).select(
        F.col("head").cast("bigint").alias("edge_id"),
        parse_time(F.col("v")[0]).alias("w"),
        F.col("v")[1].cast("bigint").alias("travel_time"),
        F.col("v")[2].cast("bigint").alias("num"),
    )


def read_link_speed(spark: SparkSession, path: str) -> DataFrame:
    """``time|(edge,speed,num)|...`` of a result folder's part files."""
    return _tuples(spark, path).select(
        F.col("v")[0].cast("bigint").alias("edge_id"),
        parse_time(F.col("head")).alias("w"),
        F.col("v")[1].cast("double").alias("speed"),
        F.col("v")[2].cast("bigint").alias("num"),
    )


def read_panel(spark: SparkSession, path: str, parts_only: bool = False) -> DataFrame:
    """``time|(x,y,value[,num])|...``; a missing weight is 0, blank lines are skipped."""
    return _tuples(spark, path, parts_only).select(
        parse_time(F.col("head")).alias("w"),
        F.col("v")[0].cast("int").alias("x"),
        F.col("v")[1].cast("int").alias("y"),
        F.col("v")[2].cast("double").alias("speed"),
        F.coalesce(F.get(F.col("v"), F.lit(3)).cast("bigint"), F.lit(0)).alias("num"),
    )


def read_panel_times(spark: SparkSession, path: str) -> DataFrame:
    """Windows named by a panel file, including those whose line holds no cell."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(parse_time(F.trim(F.substring_index("value", "|", 1))).alias("w")).distinct()


def read_no_signal(spark: SparkSession, path: str, grid: GridSpec) -> DataFrame:
    """Count line and comma list of cell ids to (x, y); a wrong count fails the job."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    ids = F.filter(F.split(F.coalesce(F.get("l", F.lit(1)), F.lit("")), ","), lambda v: F.trim(v) != "")
    listed = whole.select(F.trim(F.col("l")[0]).cast("int").alias("count"), ids.alias("ids"))
    checked = F.when(F.size("ids") == F.col("count"), F.col("ids")).otherwise(
        F.raise_error(F.lit("the number of no-signal cells differs from the count line")).cast("array<string>")
    )
    cells = listed.select(F.explode(checked).alias("id")).select(F.trim("id").cast("int").alias("id"))
    return cells.select(
        F.floor(F.col("id") / grid.ny).cast("int").alias("x"), (F.col("id") % grid.ny).alias("y")
    )


def write_no_signal(no_signal: DataFrame, path: str, grid: GridSpec) -> None:
    """Count line and comma list. At most one id per grid cell, so this is one small file."""
    ids = F.array_sort(F.collect_list(F.col("x") * grid.ny + F.col("y")))
    text = no_signal.agg(ids.alias("ids")).select(
        F.concat(
            F.size("ids").cast("string"), F.lit("\n"), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit(",")
        ).alias("value")
    )
    text.write.mode("overwrite").text(path)


def _tuple(*columns: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *[c.cast("string") for c in columns]), F.lit(")"))


def write_panel(panel: DataFrame, path: str, text: bool = False, drop_zero: bool = False) -> None:
    """The panel as parquet by day, or as text with one line per window.

    A text line holds at most one tuple per grid cell. ``drop_zero`` leaves out cells without
    speed.
    """
    kept = panel.filter(F.col("speed") != 0) if drop_zero else panel
    if not text:
        # Days come together, and those beyond the advisory partition size are dealt to several tasks.
        days = kept.withColumn("day", F.to_date("w")).hint("rebalance", F.col("day"))
        days.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("day").parquet(path)
        return
    cells = F.array_sort(F.collect_list(F.struct("x", "y", "speed", "num")))
    lines = kept.groupBy("w").agg(cells.alias("cells"))
    tuples = F.transform("cells", lambda c: _tuple(c["x"], c["y"], c["speed"], c["num"]))
    lines.select(F.concat_ws("|", format_time(F.col("w")), F.array_join(tuples, "|")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel stored as parquet."""
    return spark.read.parquet(path)


def write_link_stats(stats: DataFrame, path: str, text: bool = False) -> None:
    """Link statistics as parquet, or as text: one line per road, its windows in time order.

    A road has one entry per window, so a line grows with the calendar only.
    """
    if not text:
        stats.write.mode("overwrite").parquet(path)
        return
    entries = F.array_sort(F.collect_list(F.struct("w", "travel_time", "num")))
    lines = stats.groupBy("edge_id").agg(entries.alias("entries"))
    tuples = F.transform("entries", lambda e: _tuple(format_time(e["w"]), e["travel_time"], e["num"]))
    lines.select(
        F.concat_ws("|", F.col("edge_id").cast("string"), F.array_join(tuples, "|")).alias("value")
    ).write.mode("overwrite").text(path)


def write_link_speed(speeds: DataFrame, path: str) -> None:
    """Link speeds as text. A window has several lines when it holds many roads."""
    part = F.floor(F.col("edge_id") / ROADS_PER_LINE)
    entries = F.array_sort(F.collect_list(F.struct("edge_id", "speed", "num")))
    lines = speeds.groupBy("w", part.alias("part")).agg(entries.alias("entries"))
    tuples = F.transform("entries", lambda e: _tuple(e["edge_id"], e["speed"], e["num"]))
    lines.select(F.concat_ws("|", format_time(F.col("w")), F.array_join(tuples, "|")).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_partitioned(df: DataFrame, path: str, **params: str | int | float) -> None:
    """Store a result under folders that name its parameters (``min_edges=10/...``).

    Writing the same parameters again replaces their result and leaves the others.
    """
    for name, value in params.items():
        df = df.withColumn(name, F.lit(value))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*params).parquet(path)


def load_partitioned(spark: SparkSession, path: str, **params: str | int | float) -> DataFrame:
    """Results of the given parameters; other folders are not read."""
    df = spark.read.parquet(path)
    for name, value in params.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def save_changes(change: DataFrame, path: str, parts: int = CHANGE_PARTS) -> None:
    """Changes (w, diff) ranked by size, of equal ones the earlier first, in folders ``part=..`` in that order.

    A small table beside them has the number of rows of each part.
    """
    order = [F.col("diff").desc(), F.col("w")]
    ranked = change.select("w", "diff").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(f"{path}/ranks")
    stored = change.sparkSession.read.schema(_RANKS).parquet(f"{path}/ranks")
    stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")


def load_top_changes(spark: SparkSession, path: str, top: int) -> DataFrame:
    """The ``top`` first of stored changes; parts after the one that completes them are not read."""
    stored = spark.read.schema(_RANKS).parquet(f"{path}/ranks")
    # One row per part.
    sizes = spark.read.schema("part int, n long").parquet(f"{path}/sizes").orderBy("part").collect()
    last, seen = -1, 0
    for part, n in sizes:
        if seen >= top:
            break
        last, seen = part, seen + n
    return stored.filter(F.col("part") <= last).orderBy(F.col("diff").desc(), "w").limit(top).select("w", "diff")


def save_result(pred: DataFrame, path: str) -> None:
    """Predictions (w, flow, x, y, predict, real)."""
    pred.select("w", "flow", "x", "y", "predict", "real").write.mode("overwrite").parquet(path)


def load_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_road_num(counts: DataFrame, path: str, minimum: int) -> str:
    """``road,num`` lines of roads with at least ``minimum``, and a line with the minimum."""
    target = f"{path}_min{minimum}"
    kept = counts.filter(F.col("num") >= minimum)
    lines = kept.select(F.concat_ws(",", F.col("edge_id").cast("string"), F.col("num").cast("string")).alias("value"))
    head = counts.sparkSession.range(1).select(F.lit(str(minimum)).alias("value"))
    head.unionByName(lines).write.mode("overwrite").text(target)
    return target


def load_road_num(spark: SparkSession, path: str) -> DataFrame:
    """(edge_id, num) of roads that reach the stored minimum."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    minimum = lines.filter(~F.contains("value", F.lit(","))).agg(F.max(F.trim("value").cast("bigint"))).scalar()
    roads = lines.filter(F.contains("value", F.lit(","))).select(F.split("value", ",").alias("f"))
    roads = roads.select(F.col("f")[0].cast("bigint").alias("edge_id"), F.col("f")[1].cast("bigint").alias("num"))
    return roads.filter(F.col("num") >= minimum)
