"""Session settings and the shared folder for checkpoints and stage tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app: str = "roadpulse", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call sites per column expression cost a round trip each and are not used here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders made for sessions that name none, by application id.
_own_dirs: dict[str, str] = {}


# Applications whose Python workers have been given the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed or on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="roadpulse-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch of whole texts.
TEXT_ROWS = 1_000


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Jobs that run in the block give Python workers ``rows`` rows at a time.

    A batch stands in the executor and in its worker at once; of whole texts Spark's 10,000 rows are tens of MB.
    """
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


SHUFFLES_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in the block leave no shuffle files; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLES_CONF)
    spark.conf.set(SHUFFLES_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_CONF, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none, as in tests, gets a new one.

    A session on several machines must name one: a folder of one machine is not seen by the others.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="roadpulse-")
    return _own_dirs[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared folder, so lost executors lose nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Store ``df`` as a parquet table in the shared folder and go on from there.

    For tables that several later steps read: they are computed once, their size is known to
    the optimizer and each reader takes only its columns.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
