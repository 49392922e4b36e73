"""SimHash near-duplicates by multi-index hashing (operator 6).

Fingerprints: 64 bits over the XXH64 hashes of word shingles. The fingerprint is cut into two
32-bit segments, and a table holds every fingerprint under the value of each. Two fingerprints
within distance 2 differ by at most one bit in one of the segments, so each fingerprint
enumerates the Hamming ball of radius 1 of each of its segments, fetches the table's matches and
verifies the complete distance. Of two values that differ in one bit one has the bit set, so
only set bits are cleared: about 17 probes a segment.

A segment value that more than BUCKET fingerprints share (a large group of near copies) gives no
matches that way, which would be all pairs of the group. Its fingerprints, and those that probe
it, are searched by a finer key, the whole fingerprint with one bit of either segment flipped:
two fingerprints within distance 2 both reach some point so, and a point is reached by 65
fingerprints at most. Both ways are exact, so no link is lost whatever the bucket.

Exact copies share a fingerprint and count once, as their smallest doc_id. Components come from
star rounds over written tables.

Defined cases: null or blank text has fingerprint zero and links like any other; null doc_id
rows get a fingerprint and no component; repeated rows are returned as often as they came; very
long texts are hashed in pieces; columns other than id and text are ignored whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import connected_components, discard, map_rows, materialize

SEED = 42
SHINGLE = 3
SEGMENT = 32
RADIUS = 2
#: Fingerprints of one segment value that are matched directly.
BUCKET = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of big-endian hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch):
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

        return step

    return map_rows(docs.select(doc_id, text), "doc_id long, fp long", make)


def _flips() -> list[int]:
    """The 64 single bits as signed longs, the low segment's first."""
    return [x - (1 << 64) if x >> 63 else x for x in (1 << i for i in range(64))]


def _ball_links(reps: DataFrame) -> DataFrame:
    """Links by the finer key: whole fingerprints with one bit flipped or none."""
    masks = F.array(*(F.lit(x).cast("long") for x in [0, *_flips()]))
    probes = reps.select("fp", "rep", F.explode(masks).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), F.struct("rep", "fp").alias("x"))
    hub = probes.groupBy("key").agg(F.min("x").alias("m"), F.collect_list("x").alias("xs")).where(F.size("xs") > 1)  # 65 at most
    return hub.select("m", F.explode("xs").alias("x")).select(F.col("x.rep").alias("a"), F.col("x.fp").alias("fa"), F.col("m.rep").alias("b"), F.col("m.fp").alias("fb"))


def near_links(reps: DataFrame) -> tuple[DataFrame, str]:
    """Links (a, b) that connect all fingerprints within RADIUS, from (fp, rep) with distinct fp; and their table."""
    spark, low = reps.sparkSession, (1 << SEGMENT) - 1
    segment = lambda fp, i: F.shiftrightunsigned(fp, SEGMENT) if i else fp.bitwiseAND(F.lit(low))
    key = lambda fp, i: (segment(fp, i) * 2 + i).alias("key")
    reps = reps.repartition("fp")  # each row becomes many
    entries = F.array(*(key(F.col("fp"), i) for i in (0, 1)))
    table, table_path = materialize(reps.select(F.explode(entries).alias("key"), "fp", "rep"), "segments")
    hot, hot_path = materialize(table.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "hot-segments")
    flips = _flips()
    masks = F.array(*(F.lit(x).cast("long") for x in [0, *flips[:SEGMENT], 0, *flips[SEGMENT:]]))
    balls = reps.select("fp", "rep", F.posexplode(masks).alias("i", "flip")).where(F.col("fp").bitwiseAND(F.col("flip")) == F.col("flip"))
    value = F.col("fp").bitwiseXOR(F.col("flip"))
    probes = balls.select("fp", "rep", F.when(F.col("i") <= SEGMENT, key(value, 0)).otherwise(key(value, 1)).alias("key"))
    any_hot = not hot.isEmpty()
    plain = table.join(hot, "key", "left_anti") if any_hot else table
    # the hint: Spark takes the probes, 34 a row, for one a row, and would broadcast them
    found = probes.select("key", F.col("rep").alias("a"), F.col("fp").alias("fa")).join(plain.select("key", F.col("rep").alias("b"), F.col("fp").alias("fb")).hint("merge"), "key").drop("key")
    if any_hot:
        crowd, crowd_path = materialize(probes.join(hot, "key", "left_semi").select("fp", "rep").distinct(), "crowd")
        found = found.union(_ball_links(crowd))
    near = found.where("a != b").where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS)
    links, path = materialize(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    discard(spark, table_path, hot_path, *([crowd_path] if any_hot else []))
    return links, path


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    spark = docs.sparkSession
    fps, _ = materialize(fingerprints(docs, text, doc_id), "fingerprints")
    reps, reps_path = materialize(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    links, links_path = near_links(reps)
    roots, roots_paths = connected_components(links)
    classes, _ = materialize(
        reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("class")), "classes"
    )
    discard(spark, reps_path, links_path, *roots_paths)
    known = fps.join(classes.hint("merge"), "fp", "left")  # planned by the caller, whose session may broadcast large tables
    return known.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("component_id"))


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_dedup": op6_simhash_dedup}
ORACLES: dict[str, str] = {}
