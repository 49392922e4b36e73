"""Aggregates over chunks, files and query logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import discard, materialize


def code_files(chunks: DataFrame, names: int = 20) -> DataFrame:
    """Per file: language, chunk count, named chunks, newest update and the first names, by file."""
    named = F.nullif("name", F.lit(""))
    return chunks.groupBy("file_path").agg(
        F.max("language").alias("language"), F.count("*").alias("n_chunks"), F.count(named).alias("n_named"), F.max("updated_at").alias("updated_at"),
        F.array_join(F.slice(F.sort_array(F.collect_set(named)), 1, names), ",").alias("names"),
    )


def overview(chunks: DataFrame, complexity: str) -> DataFrame:
    """Per language: chunks, mean and largest complexity, and how many are above ten."""
    return chunks.groupBy("language").agg(
        F.count("*").alias("n"), F.round(F.avg(complexity), 1).alias("avg_complexity"), F.max(complexity).alias("max_complexity"),
        F.count(F.when(F.col(complexity) > 10, 1)).alias("n_complex"),
    )


#: Rows that a last step of a selection may order, all groups together, and ranges that a value's span is cut into.
ORDERED_ROWS, RANGES = 1_000_000, 4096


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = ()) -> DataFrame:
    """by, `n` and, for each name of ranks, the value at that rank (from 0, a function of n) of each group; nulls are left out.

    A distributed selection: rows are counted by ranges of the value, and only the range that holds a
    rank is looked at again, until what is left of all groups is small enough to be ordered. No group's
    values are gathered or ordered as a whole. Each round is written.
    """
    keys = list(by) or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("k")) for name, rank in ranks.items()]))
    state, path = materialize(sizes.select(*keys, "n", "lo", "hi", F.col("n").alias("left"), asked.alias("_a")).select(*keys, "n", "lo", "hi", "left", "_a.*"), "ranks")
    spark = df.sparkSession

    def within(state: DataFrame) -> DataFrame:
        """Rows that may hold a rank still looked for."""
        open_ = state.where("lo != hi").select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "n", "lo", "hi", "name", "k")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
        return rows.join(open_, same & F.col("_v").between(F.col("lo"), F.col("hi")))

    before = None
    while True:
        left = state.where("lo != hi").agg(F.sum("left")).first()[0] or 0
        if left <= ORDERED_ROWS or left == before:  # the latter where doubles cannot part the values
            break
        before = left
        span = F.try_divide(F.col("_v").cast("double") - F.col("lo").cast("double"), F.col("hi").cast("double") - F.col("lo").cast("double"))
        part = F.coalesce(F.least(F.floor(span * RANGES), F.lit(RANGES - 1)), F.lit(0))
        counts = within(state).groupBy(*keys, "n", "name", "k", part.alias("part")).agg(F.count("*").alias("left"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("left").over(Window.partitionBy(*keys, "name").orderBy("part"))  # RANGES rows at most
        hit = counts.withColumn("upto", upto).where("k < upto AND k >= upto - left").withColumn("k", F.col("k") - F.col("upto") + F.col("left"))
        new, new_path = materialize(hit.select(*state.columns).union(state.where("lo = hi")), "ranks")
        discard(spark, path)
        state, path = new, new_path
    counted = within(state).groupBy(*keys, "n", "name", "k", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("_v"))  # ORDERED_ROWS at most, all groups together
    last = counted.withColumn("upto", upto).where("k < upto AND k >= upto - c").select(*keys, "n", "name", "_v")
    found = last.union(state.where("lo = hi").select(*keys, "n", "name", "lo"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks]).select(*by, "n", *ranks)


def nearest_rank(df: DataFrame, value: str, percents: list[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles: the value at rank round(p / 100 * (n - 1))."""
    return at_ranks(df, value, {f"p{p:g}": lambda n, p=p: F.floor(F.lit(p) / 100.0 * (n - 1) + 0.5) for p in percents}, by).drop("n")


def query_stats(log: DataFrame, now: Column | None = None, last: int = 100) -> DataFrame:
    """Statistics over the last rows of a query log (id, ts, latency_ms, results)."""
    rows = log.orderBy(F.desc("id")).limit(last)
    end = F.max("ts")
    base = rows.agg(
        F.count("*").alias("n"), F.round(F.sum("results") / F.count("*"), 2).alias("avg_results"), (now if now is not None else end).alias("_now"),
        F.collect_list("ts").alias("_ts"),
    ).select("n", "avg_results", F.size(F.filter("_ts", lambda t: t > F.col("_now") - F.expr("INTERVAL 60 SECONDS"))).cast("long").alias("last_minute"))
    ordered = rows.where("latency_ms IS NOT NULL").agg(F.sort_array(F.collect_list("latency_ms")).alias("_l"))  # `last` rows
    rank = lambda p: F.round(F.get("_l", F.floor(F.lit(p) / 100.0 * (F.size("_l") - 1) + 0.5).cast("int")), 1)
    ranks = ordered.select(rank(50).alias("p50"), rank(95).alias("p95"))
    return base.join(F.broadcast(ranks), F.lit(True))  # one row each
