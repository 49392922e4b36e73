"""Communities of a graph by label propagation in written rounds, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.scratch import bucketed, discard, materialize


def label_propagation(edges: DataFrame, rounds: int = 5) -> tuple[DataFrame, str]:
    """(node, label) of an undirected graph (a, b, weight): each round a node takes the label of most weight among its neighbours and itself, ties to the least.

    A node's own label weighs one. All nodes change together, so the result does not depend on order.
    Links are shuffled once, into buckets by the node that is heard, which the rounds join as they lie.
    In the first round a node hears its neighbours' names, which its own bucket holds. In the others,
    weights of equal labels are summed inside the tasks before the shuffle, so a hub that listens costs
    a row for each label and task; the links of a hub that is heard lie in one bucket, whose task passes
    over them once a round. Each round is written. Returns the frame and its scratch path.
    """
    spark = edges.sparkSession
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = kept.select("a", "b", "weight").union(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    links, drop_links = bucketed(both, "links", "b", lambda placed: placed.groupBy("b", "a").agg(F.sum("weight").alias("weight")))
    first = F.col("b").alias("node")
    if rounds:
        kind = links.schema["weight"].dataType
        vote = lambda weight, label: F.struct((-weight).cast(kind).alias("w"), F.col(label).alias("label"))
        start = links.groupBy("b").agg(F.min(vote(F.col("weight"), "a")).alias("heard")).select(first, F.least("heard", vote(F.lit(1), "b"))["label"].alias("label"))
    else:
        start = links.select(first).distinct().withColumn("label", F.col("node"))
    labels, path = materialize(start, "labels")
    for _ in range(rounds - 1):
        heard = links.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").select(F.col("a").alias("node"), "label", "weight")
        votes = heard.union(labels.select("node", "label", F.lit(1).alias("weight"))).groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        best = F.min_by("label", F.struct((-F.col("weight")).alias("w"), "label"))
        new, new_path = materialize(votes.groupBy("node").agg(best.alias("label")), "labels")
        discard(spark, path)
        labels, path = new, new_path
    drop_links()
    return labels, path


def community_cards(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, n_members, n_files, language) of communities, from labels and nodes (node, file_path, language): the language of most members, ties to the first by name."""
    joined = labels.join(nodes, "node", "left")
    sizes = joined.groupBy("label").agg(F.count("*").alias("n_members"), F.countDistinct("file_path").alias("n_files"))
    spoken = joined.where("language IS NOT NULL").groupBy("label", "language").agg(F.count("*").alias("n"))
    first = Window.partitionBy("label").orderBy(F.desc("n"), "language")  # a row a language
    return sizes.join(spoken.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("label", "language"), "label", "left")
