"""Durable intermediate tables and size-checked access to small frames."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 200_000
DRIVER_ROWS = 2_000_000
_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that must survive the loss of executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    # the setting cannot be changed in a running session, so the folder is remembered here
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="causeway-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``durable`` writes inside the block when it ends.

    Frames that read them must have been written or collected by then.
    """
    first = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[first:]:
            _delete(spark, path)
        del _WRITTEN[first:]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` returned; frames that read them must have been written or collected by then."""
    for table in tables:
        _delete(table.sparkSession, table._written)
        _WRITTEN.remove(table._written)


def durable(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    This cuts the lineage of iterative plans, and pins values (row ids, draws) that a
    recomputed task could otherwise produce differently. The shuffles of the write are removed with it,
    not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"table-{uuid.uuid4().hex}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _WRITTEN.append(path)
    with _shuffles_removed(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def is_scan(df: DataFrame) -> bool:
    """Do the rows come straight from the files of one table, so that reading them twice is cheap?

    Joins and unions hand on the file columns of their inputs, so the sources are counted as well.
    """
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index")).schema
    except PySparkException:
        return False
    return df._jdf.queryExecution().analyzed().collectLeaves().size() == 1


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that is read in fewer pieces than there are cores.

    Large files are read in many pieces, and joins deal their rows themselves; these frames are returned
    unchanged, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_scan(df) and df.rdd.getNumPartitions() < cores else df


def collect_bounded(df: DataFrame, what: str, limit: int = DRIVER_ROWS) -> list[Row]:
    """Collect a frame whose size depends on the number of variables, never on rows.

    The bound is checked, not assumed: one row more than ``limit`` is an error.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too large for the driver")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a count shows at most ``limit`` rows.

    Larger frames are returned as they are, so Catalyst joins them by shuffle.
    """
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def by_shuffle(df: DataFrame) -> DataFrame:
    """Let the next join of a frame that grows with the rows shuffle it.

    Catalyst judges a written table by its compressed files, which are far smaller than its rows, and would
    send the whole table through the driver.
    """
    return df.hint("merge")


def local_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Metadata rows (names, edges, configurations) as a DataFrame."""
    return spark.createDataFrame(rows, schema)
