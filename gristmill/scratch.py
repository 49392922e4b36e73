"""Scratch tables in the folder that driver and executors share, and the size checks of broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A table of at most this many rows (of a few numbers each) may be broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000
#: The same for rows of one or two numbers.
BROADCAST_NUMBERS = 1_000_000
#: Tables that Spark takes to be larger are not broadcast unasked. It goes by compressed files and counts an array as one value, so true sizes are up to a hundred times that.
BROADCAST_BYTES = 256 << 10

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all run on one machine."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        folder = tempfile.TemporaryDirectory(prefix="gristmill-")
        atexit.register(folder.cleanup)
        _own_dir.append(f"file://{folder.name}")
    return _own_dir[0]


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside broadcast tables of up to BROADCAST_BYTES, or of what the session allows if that is less."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    allowed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if allowed <= BROADCAST_BYTES:
        yield
        return
    before = spark.conf.get(key)
    spark.conf.set(key, str(BROADCAST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    A lost executor then costs only its running tasks. Returns the frame and its path.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with few_broadcasts(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, by: str, then: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Callable[[], None]]:
    """Write then(df placed by a hash of the column `by`) as a table in the shared folder whose buckets, sorted by that column, later joins and groups by it need not shuffle.

    Returns the frame and what deletes the table.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path, table, parts = f"{shared_dir(spark)}/gristmill/{name}-{mark}", f"gristmill_{name}_{mark}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with few_broadcasts(spark):
        then(df.repartition(parts, by)).write.option("compression", "zstd").option("path", path).bucketBy(parts, by).sortBy(by).format("parquet").saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(spark, path)

    return spark.table(table), drop


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a materialised table of short rows, may be broadcast."""
    return df.limit(rows + 1).count() <= rows
