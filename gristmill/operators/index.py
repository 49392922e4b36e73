"""Index lifecycle: hash diff, upsert, delete, embedding cache, state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import materialize


def state_diff(current: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status) of every path in either (path, hash) table: added, changed, unchanged or deleted."""
    joined = current.select("path", F.col("hash").alias("_new")).join(state.select("path", F.col("hash").alias("_old")), "path", "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return joined.select("path", status.alias("status"))


def next_state(current: DataFrame, state: DataFrame, in_scope: Column, flushed: DataFrame) -> DataFrame:
    """State after a run: out-of-scope rows as they were, unchanged ones, and hashes of flushed paths only."""
    outside = state.where(~in_scope)
    same = current.join(state, ["path", "hash"], "left_semi").where(in_scope)
    return outside.select("path", "hash").union(same.select("path", "hash")).union(current.join(flushed, "path", "left_semi").select("path", "hash")).distinct()


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """Rows of both, the latest for each key."""
    order = Window.partitionBy(*keys).orderBy(*version)
    return base.unionByName(changes).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def delete_where(base: DataFrame, predicate: Column) -> DataFrame:
    """Rows of base that the predicate does not hold for."""
    return base.where(~F.coalesce(predicate, F.lit(False)))


def replace_files(base: DataFrame, fresh: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """base with all rows of `files` replaced by fresh ones."""
    return base.join(files, key, "left_anti").unionByName(fresh)


def cached_embeddings(chunks: DataFrame, cache: DataFrame, now: Column, embed: Callable[[Column], Column], days: int = 30) -> DataFrame:
    """chunks with `embedding`, from a cache row (hash, embedding, created_at) that is young enough or from embed()."""
    young = cache.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS")).select("hash", F.col("embedding").alias("_e"))
    joined = chunks.join(young, "hash", "left")
    return joined.withColumn("cached", F.col("_e").isNotNull()).withColumn("embedding", F.coalesce("_e", embed(F.col("hash")))).drop("_e")


def orphans(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed paths that are no longer there."""
    return index.select("path").distinct().join(files, "path", "left_anti")


def forward_fill(rows: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with `value` carried forward over nulls."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, True).over(w))


def forward_fill_ranges(rows: DataFrame, value: str, order: Sequence[str], parts: int = 200) -> DataFrame:
    """rows of one long sequence with `value` carried forward over nulls, in `parts` ranges of `order` (together a position of its own for each row).

    Each range is filled by itself, and what its first rows lack is the last value of the ranges before:
    a row a range is all that is ordered together. The ranges are written, so that they hold still.
    """
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    held, _ = materialize(ranged, "ranges")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tails = held.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    everywhere = held.select("_part").distinct().join(tails, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows at most
    carried = everywhere.select("_part", F.last("_tail", True).over(before).alias("_carried"))
    filled = held.withColumn(value, F.last(value, True).over(within)).join(F.broadcast(carried), "_part")
    return filled.withColumn(value, F.coalesce(value, "_carried")).select(*rows.columns)
