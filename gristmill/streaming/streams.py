"""Streams: the event log, queries per minute, and the anchored rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import discard, materialize

WINDOW_SECONDS, LIMIT = 60, 120


def newest(events: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The last n events."""
    return events.orderBy(F.desc(order)).limit(n)


def per_minute(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events by minute; on a stream, late events are waited for."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def fold_window(stamps: list[float], start: float | None, count: int, limit: int, seconds: float) -> tuple[list[bool], float | None, int]:
    """Verdicts of requests in order, and the state: a window starts at the first request after the last one ended."""
    out = []
    for t in stamps:
        if start is None or t - start >= seconds:
            start, count = t, 0
        out.append(count < limit)
        count += count < limit
    return out, start, count


def window_starts(times: DataFrame, width: int) -> tuple[DataFrame, str]:
    """(k, t) where windows of a key begin, of distinct times (k, t): its first, then each first time `width` or more after the last start.

    Every time points to the first one `width` later, which lies in one of the next slices of time, so no
    key is gathered. The starts are found by doubling: each round follows pointers twice as far.
    Returns the frame and its scratch path.
    """
    spark, slice_of = times.sparkSession, lambda t: F.expr(f"{t} div {width}")
    sliced, sliced_path = materialize(times.select("k", "t", slice_of("t").alias("b")), "times")
    first = sliced.groupBy("k", "b").agg(F.min("t").alias("lead"))
    # a slice's next one with any time, by key: a row a slice, however many times it holds
    later = first.select("k", "b", F.lead("lead").over(Window.partitionBy("k").orderBy("b")).alias("after"))
    probes = sliced.select("k", "t", (F.col("b") + 1).alias("b"), F.lit(False).alias("is_time"), (F.col("t") + width).alias("at"))
    known = sliced.select("k", "t", "b", F.lit(True).alias("is_time"), F.col("t").alias("at"))
    onward = Window.partitionBy("k", "b").orderBy(F.desc("at"), F.desc("is_time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = probes.union(known).withColumn("hit", F.last(F.when(F.col("is_time"), F.col("at")), ignorenulls=True).over(onward)).where("NOT is_time")
    # nothing left in that slice: the first time of the next slice that has any, after the probe's own or, if that is empty, after the one before
    beyond = within.where("hit IS NULL").join(later.withColumnRenamed("after", "own"), ["k", "b"], "left")
    beyond = beyond.withColumn("b", F.col("b") - 1).join(later.withColumnRenamed("after", "prior"), ["k", "b"], "left")
    next_slice = F.when(F.col("own").isNotNull() | (F.col("prior") < F.col("t") + width), F.col("own")).otherwise(F.col("prior"))
    hits = within.where("hit IS NOT NULL").select("k", "t", F.col("hit").alias("to")).union(beyond.select("k", "t", next_slice.alias("to")))
    pointers, path = materialize(hits.where("to IS NOT NULL"), "pointers")
    starts, starts_path = materialize(sliced.groupBy("k").agg(F.min("t").alias("t")), "starts")
    discard(spark, sliced_path)
    while True:
        found, found_path = materialize(starts.join(pointers, ["k", "t"]).select("k", F.col("to").alias("t")), "starts")
        if found.isEmpty():
            discard(spark, path, found_path)
            return starts, starts_path
        grown, grown_path = materialize(starts.union(found), "starts")
        twice, twice_path = materialize(
            pointers.join(pointers.select("k", F.col("t").alias("to"), F.col("to").alias("far")), ["k", "to"]).select("k", "t", F.col("far").alias("to")), "pointers"
        )
        discard(spark, path, starts_path, found_path)
        pointers, path, starts, starts_path = twice, twice_path, grown, grown_path


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """events with `accepted`, in batch: windows are anchored at a key's first request, and the first `limit` of each window pass.

    `order` tells requests of one time apart. Requests without key or time have no verdict.
    """
    width = seconds * 1_000_000
    named = events.withColumn("_k", F.col(key)).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_o", F.col(order))
    timed = named.where("_k IS NOT NULL AND _t IS NOT NULL")
    starts, _ = window_starts(timed.select(F.col("_k").alias("k"), F.col("_t").alias("t")).distinct(), width)
    # a request's window began in its own slice of time or in the one before
    own = starts.select(F.col("k").alias("_k"), F.expr(f"t div {width}").alias("_b"), F.col("t").alias("_own"))
    prior = own.select("_k", (F.col("_b") + 1).alias("_b"), F.col("_own").alias("_prior"))
    placed = timed.withColumn("_b", F.expr(f"_t div {width}")).join(own, ["_k", "_b"], "left").join(prior, ["_k", "_b"], "left")
    placed = placed.withColumn("_s", F.when(F.col("_own") <= F.col("_t"), F.col("_own")).otherwise(F.col("_prior")))
    rank = F.row_number().over(Window.partitionBy("_k", "_s").orderBy("_t", "_o"))
    passing = placed.select("_k", "_s", "_t", "_o").withColumn("_n", rank).where(F.col("_n") <= limit)  # each task keeps a window's first `limit` before the shuffle
    last = passing.groupBy("_k", "_s").agg(F.max(F.struct("_t", "_o")).alias("_last"))
    judged = placed.join(last, ["_k", "_s"], "left").select(*events.columns, (F.coalesce(F.struct("_t", "_o") <= F.col("_last"), F.lit(False))).alias("accepted"))
    return judged.union(named.where("_k IS NULL OR _t IS NULL").select(*events.columns, F.lit(None).cast("boolean").alias("accepted")))


def rate_limit_stream(events: DataFrame, key: str, ts: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same on a stream, in order of arrival; a key's state ends when its window is over."""

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for pdf in frames:
            pdf = pdf.sort_values(ts)
            stamps = (pdf[ts].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1}[pdf[ts].dt.unit]).tolist()
            verdicts, start, count = fold_window(stamps, start, count, limit, seconds)
            yield pd.DataFrame({"key": [k[0]] * len(pdf), "ts": pdf[ts].to_numpy(), "accepted": verdicts})
        state.update((start, count))
        state.setTimeoutDuration(seconds * 1000)

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, ts {events.schema[ts].dataType.simpleString()}, accepted boolean", "start double, n long", "append", "ProcessingTimeTimeout")


def follow(spark, path: str, schema, table_path: str, checkpoint: str):
    """Append new event files to a table, once each."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table_path)


def latest_per_key(events: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
