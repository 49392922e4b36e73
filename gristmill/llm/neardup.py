"""Near copies by SimHash and exact similarity of five-word shingles: operator 6 as a pipeline stage.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at
least 4/5; groups are the connected components of that relation, and one row of each stays: that
with the smallest doc_id (null ones last), then the smallest row number.

Candidates come first from the multi-index over five-word fingerprints. At a similarity of 4/5
fingerprints differ by some ten bits of 64, beyond any ball that can be enumerated, so a second
source completes them: of each set the SAMPLE shingles of least hash are posted, the rarest of
them first. Sets of up to EXACT shingles are posted by their exact bound, which loses nothing. Of
larger sets, two of that similarity share a hypergeometric number of their samples, and all but
one pair in a million have at most five standard deviations less than its mean; they share a
shingle among the first that this leaves to each. The places of a pair's first shared shingle bound
its similarity in the same way, before anything is compared. Passages that very many texts share are among
the last and give no candidates. All candidates are verified on whole sets. Equal sets count once.

Skew: a shingle's texts never give all their pairs. Every bucket is first compared with one of
its texts, which joins a large group of copies; a bucket is done once its texts are of one
component. Small ones that are left give the pairs of different components. The texts of large
ones that are left are posted once more, by whole sets and their exact bounds, and go through the
same rounds, in the last of which ever more texts of a bucket's minority are compared with the
rest, until it is done.

Defined cases: fewer than five words are one shingle; null and blank texts have no shingle and are
copies of each other; repeated rows are copies; very long texts give a sample of the same size;
extra columns are carried whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_NUMBERS, column, connected_components, discard, map_rows, materialize, release, small_enough
from gristmill.llm.simhash import majority, near_links, shingle_hashes

WORDS = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
SAMPLE = 128
#: Sets so small that all that are alike have their whole set as sample.
EXACT = SAMPLE * NUM // DEN
#: Texts of a shingle that give the pairs of different components at once.
FEW = 32


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, WORDS).astype(np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def summaries(texts: DataFrame) -> DataFrame:
    """(row, id, sig, n, fp, sample) of every text: digest, size, fingerprint and sample of its shingles."""

    def make():
        def step(batch: pa.RecordBatch):
            sigs, sizes, prints, samples = [], [], [], []
            for text in batch.column(2).to_pylist():
                every = shingle_hashes(text, WORDS)
                distinct = np.unique(every.astype(np.uint64))
                sigs.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                sizes.append(len(distinct))
                prints.append(majority(every))
                samples.append(distinct[:SAMPLE].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(samples, pa.list_(pa.int64()))],
                names=["row", "id", "sig", "n", "fp", "sample"],
            )

        return step

    return map_rows(texts, "row long, id long, sig binary, n int, fp long, sample array<long>", make)


def postings(sets: DataFrame, whole: bool) -> tuple[DataFrame, str]:
    """(key, row, x): the sets under the rarest shingles of their samples, where more than one set has the shingle.

    x is a struct of n, the shingle's place pos and the sample's largest hash. whole: the samples
    are whole sets. Also the table that holds them.
    """
    spark = sets.sparkSession
    entries = sets.select("row", F.explode("sample").alias("key"))
    common, common_path = materialize(entries.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "common")
    shared, shared_path = materialize(entries.join(common, "key"), "shared")
    release(spark)
    one = Window.partitionBy("row")  # a sample at most
    share = NUM / DEN
    exact = f"(n * {NUM} + {DEN - 1}) div {DEN}"
    spread = f"sqrt({SAMPLE * share * (1 - share)} * greatest(0, n / {share} - {SAMPLE}) / (n / {share} - 1))"
    least = F.expr(exact if whole else f"CASE WHEN n <= {EXACT} THEN {exact} ELSE CAST(least({share} * least(n, {SAMPLE}), {share * SAMPLE} - 5 * {spread}) AS INT) END")
    taken = F.col("n") if whole else F.least("n", F.lit(SAMPLE))
    top = F.when(F.lit(not whole) & (F.col("n") > SAMPLE), F.shiftrightunsigned(F.element_at("sample", -1), 1)).otherwise((1 << 63) - 1)
    # shingles of one set alone are the rarest, and need no posting
    ranked = shared.join(sets.select("row", "n", top.alias("top")), "row").withColumn("pos", F.row_number().over(one.orderBy("df", "key")) - F.count("*").over(one) + taken - 1)
    posts, path = materialize(ranked.where(F.col("pos") <= taken - least).select("key", "row", F.struct("n", F.col("pos").cast("int").alias("pos"), "top").alias("x")), "posts")
    discard(spark, common_path, shared_path)
    release(spark)
    return posts, path


def _fits(x: str, y: str, whole: bool):
    """Whether the sets of two postings can be alike, if the postings are the first that they share.

    Of whole sets the places bound what is shared. Of samples, all shared shingles of the one with
    the lower largest hash are in the other, so those before the first are not shared, and no more
    are to be expected than its share of the set's other shingles and five standard deviations.
    """
    out = f"({NUM}D / {NUM + DEN} * ({x}.n + {y}.n))"  # least number of shared shingles
    side = lambda z: f"""{z}.pos <= least({z}.n, {SAMPLE}) * ({z}.n - {out}) / {z}.n + 5 * sqrt(greatest(0,
        least({z}.n, {SAMPLE}) * ({z}.n - {out}) / {z}.n * {out} / {z}.n * ({z}.n - least({z}.n, {SAMPLE})) / greatest({z}.n - 1, 1)))"""  # noqa: E731
    exact = f"{NUM + DEN} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {NUM} * ({x}.n + {y}.n)"
    return F.expr(
        f"""{DEN} * least({x}.n, {y}.n) >= {NUM} * greatest({x}.n, {y}.n) AND CASE WHEN {whole} OR greatest({x}.n, {y}.n) <= {SAMPLE} THEN {exact}
        WHEN {x}.top <= {y}.top THEN {side(x)} ELSE {side(y)} END"""
    )


def candidates(members: DataFrame, hubs: int, whole: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """One round over buckets (key, row, x, comp): pairs (a, b) to verify, and the texts (key, row, x) still to compare.

    hubs 0: every bucket is compared with one text, that with the fewest rarer shingles, which the
    texts of a group of near copies are most like. Else small buckets give their pairs, and about
    that many texts of the others' minority are compared with the rest.
    """
    per = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct("x.pos", "row")).alias("first"))
    stats = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("most"), F.min("first").alias("first")).where("comps > 1")
    stats, stats_path = materialize(stats.select("key", "size", F.col("most.comp").alias("most"), F.col("first.row").alias("first")), "buckets")
    live, live_path = materialize(members.join(stats, "key"), "live")
    minority = F.col("comp") != F.col("most")
    if hubs:
        few = live.where(F.col("size") <= FEW).groupBy("key").agg(F.collect_list(F.struct("row", "x", "comp")).alias("xs"))
        pairs = few.select("xs", F.explode("xs").alias("p")).select("p", F.explode("xs").alias("q")).where("p.row < q.row AND p.comp != q.comp")
        pairs = pairs.where(_fits("p.x", "q.x", whole)).select(F.col("p.row").alias("a"), F.col("q.row").alias("b"))
        many = live.where(F.col("size") > FEW)
        central = many.where(minority).groupBy("key").agg(F.min(F.struct("x.pos", "row")).alias("next"))
        drawn = F.pmod(F.xxhash64("row", F.lit(hubs)), F.col("size")) < hubs
        chosen = many.join(central, "key").where(minority & (drawn | (F.col("row") == F.col("next.row"))))
    else:
        many, pairs = live, None
        chosen = live.where(F.col("row") == F.col("first"))
    chosen, chosen_path = materialize(chosen.select("key", F.col("row").alias("hub"), F.col("x").alias("hub_x"), F.col("comp").alias("hub_comp")), "hubs")
    starred = many.join(chosen, "key").where((F.col("comp") != F.col("hub_comp")) & _fits("x", "hub_x", whole))
    starred = starred.select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b"))
    pairs, pairs_path = materialize((starred if pairs is None else pairs.union(starred)).distinct(), "pairs")
    gone = chosen.select("key", F.col("hub").alias("row"))
    rest, rest_path = materialize(many.select("key", "row", "x").join(gone, ["key", "row"], "left_anti"), "open")
    discard(members.sparkSession, stats_path, live_path, chosen_path)
    return pairs, rest, [pairs_path, rest_path]


def verified(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose texts are alike; each text that is needed is read and hashed once. Also the table that holds them."""
    spark = texts.sparkSession
    need, need_path = materialize(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "need")
    few = small_enough(need, BROADCAST_NUMBERS)

    def digest():
        def step(batch: pa.RecordBatch):
            sets = [shingles(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "hashes"])

        return step

    wanted = texts.select("row", "text").join(F.broadcast(need) if few else need, "row")
    sets, sets_path = materialize(map_rows(wanted, "row long, hashes binary", digest), "sets")

    def make():
        of = lru_cache(16)(lambda x: np.frombuffer(x, np.uint64))

        def step(batch: pa.RecordBatch):
            good = [(a, b) for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))) if alike(of(x), of(y))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

        return step

    one, two = (sets.select(F.col("row").alias(r), F.col("hashes").alias(h)) for r, h in (("a", "x"), ("b", "y")))
    good, path = materialize(map_rows(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), "a long, b long", make), "alike")
    discard(spark, need_path, sets_path)
    return good, path


def _whole_sets(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, str]:
    """(row, n, sample) of the texts of rows, with whole sets as samples; and their table."""

    def make():
        def step(batch: pa.RecordBatch):
            sets = [shingles(x).view(np.int64) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "sample"])

        return step

    wanted = texts.select("row", "text").join(F.broadcast(rows) if small_enough(rows, BROADCAST_NUMBERS) else rows, "row")
    return materialize(map_rows(wanted, "row long, n int, sample array<long>", make), "whole")


def near_groups(texts: DataFrame) -> tuple[DataFrame, str]:
    """(row, id, root) of each of texts (row, id, text), a written table with distinct rows; root is common to a group. Also their table."""
    spark = texts.sparkSession
    known, known_path = materialize(summaries(texts.select("row", "id", "text")), "summaries")
    first = F.min(F.struct("row", "n", "fp", "sample")).alias("x")
    sets, sets_path = materialize(known.groupBy("sig").agg(first).select("sig", "x.*"), "sets")
    of_row, of_row_path = materialize(known.select("row", "id", "sig"), "signatures")
    discard(spark, known_path)
    prints, prints_path = materialize(sets.where("n > 0").groupBy("fp").agg(F.min("row").alias("rep")), "prints")
    same = sets.where("n > 0").join(prints, "fp").where("row != rep").select(F.col("row").alias("a"), F.col("rep").alias("b"))
    links, links_path = near_links(prints)
    pairs, pairs_path = materialize(links.union(same).distinct(), "pairs")
    edges, edge_path = verified(pairs, texts)
    roots, paths = connected_components(edges)
    discard(spark, prints_path, links_path, pairs_path)
    kept = [edge_path]
    release(spark)
    opened, opened_path = postings(sets, False)
    of_set, of_set_path = materialize(sets.select("sig", "row"), "sets")
    discard(spark, sets_path)
    hubs, whole, trash = 0, False, [opened_path]
    while not opened.isEmpty():
        if hubs > 4 and not whole:  # what large buckets have left
            rows, rows_path = materialize(opened.select("row").distinct(), "rows")
            wholes, wholes_path = _whole_sets(rows, texts)
            opened, opened_path = postings(wholes, True)
            discard(spark, rows_path, wholes_path, *trash)
            hubs, whole, trash = 0, True, [opened_path]
        members, members_path = materialize(
            opened.join(roots, opened["row"] == roots["node"], "left").select("key", "row", "x", F.coalesce("root", "row").alias("comp")), "members"
        )
        pairs, opened, more = candidates(members, hubs, whole)
        discard(spark, members_path, *trash)
        trash = more
        if not pairs.isEmpty():
            found, path = verified(pairs, texts)
            kept.append(path)
            if not found.isEmpty():
                edges = edges.union(found)
                discard(spark, *paths)
                roots, paths = connected_components(edges)
        release(spark)
        hubs = 4 * hubs or 4
    rooted, rooted_path = materialize(of_set.join(roots, of_set["row"] == roots["node"], "left").select("sig", F.coalesce("root", "row").alias("root")), "roots")
    groups, path = materialize(of_row.join(rooted, "sig").select("row", "id", "root"), "groups")
    discard(spark, of_row_path, of_set_path, rooted_path, *paths, *trash, *kept)
    release(spark)
    return groups, path


def keep_one_alike(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies."""
    spark, number = docs.sparkSession, "__number"
    while number in docs.columns:
        number += "_"
    numbered, _ = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("row"), column(doc_id).cast("long").alias("id"), column(text).alias("text"))
    groups, path = near_groups(texts)
    first = groups.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("kept"))
    first, first_path = materialize(first.select("root", F.col("kept.row").alias("kept")), "kept")  # written: a root of very many rows can be split
    gone, _ = materialize(groups.join(first, "root").where("row != kept").select(F.col("row").alias("__gone")), "gone")
    discard(spark, path, first_path)
    release(spark)
    # few rows go, so their numbers are sent rather than all texts moved
    return numbered.join(F.broadcast(gone) if small_enough(gone, BROADCAST_NUMBERS) else gone.hint("merge"), numbered[number] == gone["__gone"], "left_anti").drop(number)
