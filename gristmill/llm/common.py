"""Shared plumbing of the training-data operators: scratch tables, Arrow helpers, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.scratch import BROADCAST_BYTES, BROADCAST_NUMBERS, BROADCAST_ROWS, discard, few_broadcasts, materialize, shared_dir, small_enough

__all__ = [
    "BROADCAST_BYTES", "BROADCAST_NUMBERS", "BROADCAST_ROWS", "bound_batches", "column", "connected_components", "discard", "few_broadcasts", "map_rows",
    "materialize", "release", "shared_dir", "small_enough",
]


def column(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches, as rows hold whole texts: a task then holds a few MB of them at a time."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        spark.conf.set(key, value)


def map_rows(
    df: DataFrame,
    schema: T.StructType | str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
) -> DataFrame:
    """mapInArrow whose state is built once a task by make()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) of the graph with edges (a, b), both long; root is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a few joins and aggregates over
    the edges, hubs are split by AQE's skew join, and no component is gathered anywhere. Each
    round is written to the shared folder. Nodes without edges are not returned. The second
    result lists scratch paths that back the frame.
    """
    spark = edges.sparkSession
    current, path = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        following, new_path = materialize(small, "edges")
        state = tuple(following.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        discard(spark, path)
        current, path = following, new_path
        if state == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")), [path]
        mark = state
