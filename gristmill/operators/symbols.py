"""Symbol tables and graphs: resolution, usages, relations, traversal, impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import materialize

MOST = 1000
DEFINITION_ORDER = "CASE kind WHEN 'impl' THEN 2 WHEN 'property' THEN 1 ELSE 0 END"
USAGE_ORDER = "CASE kind WHEN 'call' THEN 0 WHEN 'member' THEN 1 WHEN 'type' THEN 2 WHEN 'import' THEN 3 ELSE 4 END"
HERITAGE = ("inherits", "implements")


def with_files(rows: DataFrame, files: DataFrame, collection: str) -> DataFrame:
    """Rows of a symbol table with their file, of one collection."""
    return rows.join(files.where(F.col("collection") == collection), "file_id")


def resolve(defs: DataFrame, names: Sequence[str], limit: int = 20) -> DataFrame:
    """Definitions of exact names: declarations, then properties, then impl blocks."""
    return defs.where(F.col("name").isin(*names)).orderBy(F.expr(DEFINITION_ORDER), "file_path", "start_line", "name").limit(min(limit, MOST))


def usages(refs: DataFrame, name: str, limit: int = MOST, kinds: Sequence[str] | None = None) -> DataFrame:
    """References to a name: calls, members, types, imports, others."""
    found = refs.where(F.col("name") == name)
    if kinds:
        found = found.where(F.col("kind").isin(*kinds))
    return found.orderBy(F.expr(USAGE_ORDER), "file_path", "line", *(c for c in ("container_name",) if c in refs.columns)).limit(min(limit, MOST))


def callees(edges: DataFrame, container: str, limit: int = MOST) -> DataFrame:
    return edges.where((F.col("relation") == "calls") & (F.col("from_name") == container)).select("to_name").distinct().orderBy("to_name").limit(min(limit, MOST))


def implementations(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("relation").isin(*HERITAGE) & (F.col("to_name") == name))


def supertypes(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("relation").isin(*HERITAGE) & (F.col("from_name") == name))


def related_files(edges: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """One row a file that mentions name, by its strongest relation: implementor, usage, reference."""
    heir = F.col("relation").isin(*HERITAGE)
    a = edges.where(F.col("to_name") == name).select(
        "file_path", F.when(heir, "implementor").otherwise("reference").alias("relation"), F.col("from_name").alias("label"), "line", F.when(heir, 0).otherwise(2).alias("rank")
    )
    used = F.col("kind").isin("call", "member")
    b = refs.where(F.col("name") == name).select(
        "file_path", F.when(used, "usage").otherwise("reference").alias("relation"), F.coalesce(F.nullif("container_name", F.lit("")), F.lit(name)).alias("label"), "line", F.when(used, 1).otherwise(2).alias("rank")
    )
    best = Window.partitionBy("file_path").orderBy("rank", "line", "relation", "label")
    return a.unionByName(b).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cap_per_relation(related: DataFrame, most: int = 12) -> DataFrame:
    order = Window.partitionBy("relation").orderBy("rank", "file_path")
    return related.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def structural_rank(score: Column, start: Column, end: Column, signature: Column, code: Column) -> Column:
    """Score raised by length and overriding, lowered for one-liners and deprecation."""
    lines = end - start + 1
    over = F.trim(signature).startswith("override ") | F.trim(code).startswith("override ")
    return (
        score + F.least(lines / 20.0, F.lit(2.0)) + F.when(over, 1.5).otherwise(0.0)
        - F.when((lines <= 1) & ~F.contains(code, F.lit("{")) & ~F.contains(code, F.lit("=")), 1.0).otherwise(0.0) - F.when(F.contains(code, F.lit("@Deprecated")), 0.75).otherwise(0.0)
    )


def traverse(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop) within `hops` of the start nodes over calls and inherits in both directions, start nodes excluded.

    Each hop is one join and one anti-join against the visited nodes, and is written: a plan holds one
    hop, and the walk ends where a hop finds nothing.
    """
    kept = edges.where(F.col("relation").isin("calls", "inherits"))
    both, _ = materialize(kept.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).union(kept.select("to_node", "from_node")).distinct(), "links")
    visited, _ = materialize(start.select("node").distinct().withColumn("hop", F.lit(0)), "hop")
    frontier = visited
    for hop in range(1, hops + 1):
        reached = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        frontier, _ = materialize(reached.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited.where("hop > 0")


def related_tests(tests: DataFrame, anchors: DataFrame, path: str = "file_path") -> DataFrame:
    """(file_path, score) of test files: 5 for an anchor in the base name, else 2 in the path, 1 for the module prefix.

    anchors (anchor, module) are the stated changed files, a bounded set.
    """
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    hit = F.when(F.contains(base, F.col("anchor")), 5).when(F.contains(F.lower(F.col(path)), F.col("anchor")), 2).otherwise(0)
    points = hit + F.when((F.col("module") != "") & F.col(path).startswith(F.col("module")), 1).otherwise(0)
    pairs = tests.join(F.broadcast(anchors), F.contains(F.lower(F.col(path)), F.col("anchor")) | F.col(path).startswith(F.col("module")))
    return pairs.groupBy(path).agg(F.sum(points).cast("long").alias("score")).where("score > 0")


def affected_files(*parts: DataFrame) -> DataFrame:
    """Distinct files of several results."""
    out = parts[0].select("file_path")
    for p in parts[1:]:
        out = out.union(p.select("file_path"))
    return out.distinct()


def modules_for(paths: DataFrame, path: str = "path") -> DataFrame:
    """(module, n_files): the first one to three directories of each path."""
    parts = F.split(path, "/")
    depth = F.greatest(F.lit(1), F.least(F.lit(3), F.size(parts) - 1))
    return paths.select(F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("module")).groupBy("module").agg(F.count("*").alias("n_files"))


def disambiguate(defs: DataFrame, name: str, path: str) -> DataFrame:
    """Names with several definitions in several files."""
    return (
        defs.groupBy(name).agg(F.count("*").alias("n_defs"), F.countDistinct(path).alias("n_paths"), F.array_join(F.sort_array(F.collect_set(path)), ",").alias("paths"))
        .where("n_defs > 1 AND n_paths > 1")
    )


