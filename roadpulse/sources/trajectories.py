"""Readers for trajectory files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import point
from roadpulse.functions.timing import format_second, parse_second

MAX_EDGES = 2**31 - 1


def read_trajectories(
    spark: SparkSession,
    path: str,
    min_edges: int = 0,
    max_edges: int = MAX_EDGES,
    count_id_token: bool = True,
) -> DataFrame:
    """``id,time|edge,time|edge,...`` lines to (traj_id, path array<struct<t, edge_id>>).

    Lines are kept by their number of tokens; with ``count_id_token`` the id is one of them.
    Short lines are dropped before anything in them is parsed.
    """
    lines = spark.read.text(path).select(F.split(F.rtrim(F.col("value"), F.lit(",")), ",").alias("f"))
    size = F.size("f") - (0 if count_id_token else 1)
    kept = lines.filter(size.between(min_edges, max_edges) & (F.trim(F.col("f")[0]) != ""))

    def step(token: Column) -> Column:
        parts = F.split(token, r"\|")
        return F.struct(parse_second(parts[0]).alias("t"), parts[1].cast("bigint").alias("edge_id"))

    tokens = F.slice("f", 2, F.size("f") - 1)
    return kept.select(F.trim(F.col("f")[0]).cast("bigint").alias("traj_id"), F.transform(tokens, step).alias("path"))


def trajectory_lines(traj: DataFrame) -> DataFrame:
    """Legacy trips as text lines, the inverse of :func:`read_trajectories`."""
    steps = F.transform("path", lambda s: F.concat_ws("|", format_second(s["t"]), s["edge_id"].cast("string")))
    return traj.select(F.concat(F.col("traj_id").cast("string"), F.lit(","), F.array_join(steps, ",")).alias("value"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(value, file, line) of read text files: the line's place in its file, whatever the splits.

    A split's lines come in order, so a line's place in its split is its running number less the
    split's first one. Splits are counted first, one row each, and their counts added up per file;
    the lines themselves are not shuffled.
    """
    source = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    read = lines.select("value", *source, F.monotonically_increasing_id().alias("_n"))
    splits = read.groupBy("file", "block").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    line = F.col("_before") + F.col("_n") - F.col("_first")
    return read.join(splits, ["file", "block"]).select("value", "file", line.alias("line"))


def month_path(base: str, month: int | None) -> str:
    """Day folders of one month, or of all months when there is none."""
    return f"{base.rstrip('/')}/{f'{month:02d}' if month and month > 0 else '*'}/*/"


def read_trajectories_2016(
    spark: SparkSession,
    path: str,
    min_edges: int = 0,
    max_edges: int = MAX_EDGES,
    month: int | None = None,
    by_month: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(trips, corrupt lines) of 28-field files.

    Fields: 4 edges, 8 times, 10 lengths (``|`` lists), 11 edge count, 22 to 25 start and end
    lon and lat, 27 end time. The end time is appended to the times. Lines lacking one of them
    or with a wrong number go to the corrupt lines, with their file and line. Trips are kept by
    their declared count; a wrong number inside a kept list fails the job. A trip's id is the hash of its file
    and line, the same for any file splits. ``by_month`` reads month and day folders.
    """
    return _trips_2016(spark.read.text(month_path(path, month) if by_month else path), min_edges, max_edges)


def write_months(lines: DataFrame, path: str) -> None:
    """Trip lines (value, month, day) as text in folders ``month=../day=..``."""
    lines.select("value", "month", "day").write.mode("overwrite").partitionBy("month", "day").text(path)


def read_months_2016(spark: SparkSession, path: str, months: list[int], min_edges: int = 0, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """(trips, corrupt lines) of the given months of a ``month=../day=..`` store; other folders are not read."""
    return _trips_2016(spark.read.text(path).filter(F.col("month").isin(months)), min_edges, max_edges)


def _trips_2016(read: DataFrame, min_edges: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    lines = numbered_lines(read).select("value", "file", "line", F.split("value", ",").alias("f"))

    def field(n: int) -> Column:
        return F.get(F.col("f"), F.lit(n))

    lengths = F.split(field(10), r"\|")
    parsed = lines.select(
        "value",
        "file",
        "line",
        field(4).alias("edges"),
        field(8).alias("times"),
        field(11).try_cast("int").alias("declared"),
        *[field(n).try_cast("double").alias(f"p{n}") for n in (22, 23, 24, 25)],
        field(27).try_cast("bigint").alias("end_time"),
        F.get(lengths, F.lit(0)).try_cast("int").alias("first_len"),
        F.try_element_at(lengths, F.lit(-1)).try_cast("int").alias("last_len"),
    )
    needed = [c for c in parsed.columns if c not in ("value", "file", "line")]
    whole = F.lit(True)
    for name in needed:
        whole = whole & F.col(name).isNotNull()

    def numbers(name: str) -> Column:
        return F.transform(F.split(F.col(name), r"\|"), lambda v: v.cast("bigint"))

    good = parsed.filter(whole & F.col("declared").between(min_edges, max_edges)).select(
        F.xxhash64("file", "line").alias("traj_id"),
        numbers("edges").alias("edges"),
        F.array_append(numbers("times"), F.col("end_time")).alias("times"),
        point(F.col("p22"), F.col("p23")).alias("start_pt"),
        point(F.col("p24"), F.col("p25")).alias("end_pt"),
        "first_len",
        "last_len",
    )
    return good, parsed.filter(~whole).select("value", "file", "line")


def trajectory_lines_2016(traj: DataFrame) -> DataFrame:
    """2016 trips as 28-field lines; fields without a meaning here are left empty."""
    n = F.size("edges")
    inner = F.when(n > 2, F.array_repeat(F.lit("0"), n - 2)).otherwise(F.array().cast("array<string>"))
    lengths = F.array_join(
        F.concat(
            F.array(F.col("first_len").cast("string")),
            inner,
            F.when(n > 1, F.array(F.col("last_len").cast("string"))).otherwise(F.array().cast("array<string>")),
        ),
        "|",
    )
    filled = {
        4: F.array_join(F.col("edges").cast("array<string>"), "|"),
        8: F.array_join(F.slice("times", 1, n).cast("array<string>"), "|"),
        10: lengths,
        11: n.cast("string"),
        22: F.col("start_pt.lon").cast("string"),
        23: F.col("start_pt.lat").cast("string"),
        24: F.col("end_pt.lon").cast("string"),
        25: F.col("end_pt.lat").cast("string"),
        27: F.element_at("times", -1).cast("string"),
    }
    return traj.select(F.concat_ws(",", *[filled.get(i, F.lit("")) for i in range(28)]).alias("value"))
