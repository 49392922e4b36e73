"""State of the service as relations: collections, registries, logs, staleness, diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a git reference a date.
SINCE_WORDS = ("day", "days", "week", "weeks", "month", "months", "year", "years", "hour", "hours", "ago", "yesterday")


def by_ids(points: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Points with a wanted id; missing ids are absent."""
    return points.join(ids, key, "left_semi")


def next_page(rows: DataFrame, key: str, last, size: int = 256) -> DataFrame:
    """The page of a scan after key `last`."""
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(size)


def counts_of(names: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of every name, zero for those without rows."""
    return names.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def symbol_stats(tables: dict[str, DataFrame], collection: str = "collection") -> DataFrame:
    """(collection, and a count for each table)."""
    parts = None
    for name, rows in tables.items():
        one = rows.groupBy(collection).agg(*(F.sum(F.lit(int(name == other))).alias(other) for other in tables))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(collection).agg(*(F.sum(name).alias(name) for name in tables))


def delete_of_files(rows: DataFrame, files: DataFrame, gone: Column) -> DataFrame:
    """Rows of a symbol table without those of the files that `gone` selects."""
    return rows.join(files.where(gone).select("file_id"), "file_id", "left_anti")


def stale(indexed: DataFrame, on_disk: DataFrame, slack: float = 2.0) -> DataFrame:
    """Paths of files changed over `slack` seconds after they were indexed; (path, indexed_at) and (path, mtime)."""
    return indexed.join(on_disk, "path").where(F.col("mtime") > F.col("indexed_at") + slack).select("path")


def named(symbols: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """wanted with `found`: whether the index has the name."""
    return wanted.join(symbols.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").select(*wanted.columns, F.coalesce("_f", F.lit(False)).alias("found"))


def is_since(reference: Column) -> Column:
    """Whether a git reference reads as a date."""
    return F.exists(F.split(F.lower(reference), r"[\s.]+"), lambda w: w.isin(*SINCE_WORDS))


def test_path(path: Column) -> Column:
    """Whether the SQL mirror takes a path for a test file."""
    return path.ilike("%/test/%") | path.ilike("%/tests/%") | path.ilike("%Test.%")


def graph_files(chunks: DataFrame, part: str = "", order: Sequence[str] = ("start_line",)) -> DataFrame:
    """(file_path, n_chunks, names): files whose path or a name holds `part`; names in order of first appearance."""
    low = part.lower()
    kept = chunks.where(F.contains(F.lower("file_path"), F.lit(low)) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(low)))
    named = F.when(F.coalesce("name", F.lit("")) != "", F.struct(*order, "name"))
    ordered = F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"])
    return kept.groupBy("file_path").agg(F.count("*").alias("n_chunks"), F.array_distinct(ordered).alias("names"))


def last_error(log: DataFrame, order: str = "event_id", newest: int = 200, among: int = 6) -> DataFrame:
    """(error): of the newest rows the first of the last errors that has a text, else the last error's message."""
    tail = log.orderBy(F.desc(order)).limit(newest).where("level = 'error'")
    errors = tail.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(order))))  # newest rows only
    said = F.min_by("error", F.when((F.col("error") != "") & (F.col("_n") <= among), F.col("_n")))
    return errors.agg(F.coalesce(said, F.min_by("message", "_n")).alias("error"))


def diagnose(cards: DataFrame) -> DataFrame:
    """(service, status, hint) of service cards, each with the overall verdict: degraded unless all but docker are ok."""
    bad = F.max(F.when((F.col("service") != "docker") & (F.col("status") != "ok"), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))  # a handful of cards
    return cards.select("service", "status", F.when(F.contains("detail", F.lit("/")), "model name holds a slash").alias("hint"), F.when(bad == 1, "degraded").otherwise("ok").alias("overall"))


def golden_hits(hits: DataFrame, golden: DataFrame, key: str = "qid") -> DataFrame:
    """(key, golden, rank): best rank of a hit equal to a golden path or ending in it, or the other way round.

    Ends of the longer path are listed, so that the match is an equality join.
    """
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.lit(1 << 20)), "/"))
    a = hits.select(key, "rank", F.explode(ends(F.col("file_path"))).alias("path")).join(golden.withColumnRenamed("golden", "path"), [key, "path"]).select(key, F.col("path").alias("golden"), "rank")
    b = golden.select(key, "golden", F.explode(ends(F.col("golden"))).alias("path")).join(hits.withColumnRenamed("file_path", "path"), [key, "path"]).select(key, "golden", "rank")
    return a.union(b).groupBy(key, "golden").agg(F.min("rank").alias("rank"))


def grounded(inferred: DataFrame, index: DataFrame, hits: DataFrame, vocab: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, name, origin): inferred symbols that the index has, then names of the best hits, then vocabulary anchors where fewer than two were found."""
    found = inferred.join(index.select("name").distinct(), "name", "left_semi").select(key, "name", F.lit(0).alias("origin"), "pos")
    both = found.unionByName(hits.where(F.col("name").rlike("^[A-Z][A-Za-z0-9]*$")).select(key, "name", F.lit(1).alias("origin"), "pos"))
    first = Window.partitionBy(key, "name").orderBy("origin", "pos")
    both = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    poor = inferred.select(key).distinct().join(both.groupBy(key).agg(F.count("*").alias("n")), key, "left").where(F.coalesce("n", F.lit(0)) < 2).select(key)
    anchors = vocab.where(F.col("name").rlike("^[A-Z][^.]{3,}$")).select(key, "name", F.lit(2).alias("origin"), "pos").join(poor, key, "left_semi")
    out = both.unionByName(anchors).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy(key).orderBy("origin", "pos", "name")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "name", "origin", "place")
