"""Vector code compression by an exponion search (operator 12).

Vectors become integers, are cut into equal parts, and every part is coded by the nearest entry of
its position's codebook. Codebooks are refined by rounds of assignment and floored means. A part's
search starts at the entry of the round before (the first round: entry 0), at exact squared
distance u. An entry as near or nearer lies within twice the distance from that start entry
(triangle inequality), so only the entries of the start's distance-sorted neighbour list with
squared distance of at most 4u are scanned; all distances are exact integers and ties go to the
lower index. Every round writes the codes for the next one to start from, then sums entries inside
the tasks; the driver sees entries alone, never vectors.

Defined cases: a row whose vector is null, or holds a null or non-finite component, is dropped.
Vectors of another length than that of the smallest kept id (a null id comes last, equal ids go by
vector), or of a length that the parts do not divide, keep null code and errors and shape no entry.
Fewer vectors than entries: as many entries as vectors. Repeated rows count and are returned each;
an empty table gives an empty result; entries without parts stay. Nulls in carried columns are kept,
whatever their names. Components too large for exact 64-bit distances end the query with an error,
never in a wrong code. Texts play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import column, discard, materialize, small_enough

#: Rows that a task searches together.
CHUNK = 8192


@dataclass(frozen=True)
class CodeParams:
    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4


class Codebook:
    """Entries of one part position, with every entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = entries[:, None, :] - entries[None, :, :]
        apart = np.einsum("ijk,ijk->ij", gaps, gaps)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances of all x to all entries: doubles hold integers below 2^53, 64-bit integers the rest."""
        top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
        if top * top * x.shape[1] < 1 << 51:
            a, b = x.astype(np.float64), entries.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
        gaps = x[:, None, :] - entries[None, :, :]
        return np.einsum("ijk,ijk->ij", gaps, gaps)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each x, from its start entry."""
        best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        by_start = np.argsort(start, kind="stable")
        for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1) if len(x) else ():
            a = start[rows[0]]
            first = self.distances(x[rows], self.entries[a : a + 1])[:, 0]
            reach = np.searchsorted(self.apart[a], 4 * first, side="right")  # entries beyond are farther than the start
            by_reach = np.argsort(reach, kind="stable")
            level = np.frexp(reach[by_reach].astype(np.float64))[1]  # rows of like reach are scanned together
            for at in np.split(by_reach, np.flatnonzero(np.diff(level)) + 1):
                near = self.order[a, : reach[at].max()]
                found = self.distances(x[rows[at]], self.entries[near])
                low = found.min(axis=1)
                best[rows[at]] = np.where(found == low[:, None], near[None, :], len(self.entries)).min(axis=1)
                least[rows[at]] = low
        return best, least


def _check_range(q: np.ndarray, width: int) -> None:
    top = 4 * max(abs(int(q.min(initial=0))), abs(int(q.max(initial=0)))) ** 2 * max(width, 1)
    if 4 * top >= 1 << 63:
        raise ValueError("vector components are too large for exact 64-bit distances")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches joined to chunks of about CHUNK rows."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, rows = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _matrix(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have dim components, and these as a matrix."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    rows = np.flatnonzero(np.diff(ends) == dim)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    q = flat[ends[rows][:, None] + np.arange(dim)[None, :]] if len(rows) else np.zeros((0, dim), np.int64)
    return rows, q


def _assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (..., __q, __code) with new codes, and `__error`."""
    books = [b.copy() for b in books]
    parts, width = len(books), books[0].shape[1] if books else 0
    names = [c for c in rows.columns if c not in ("__code", "__error")]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("__code", T.BinaryType()), T.StructField("__error", T.LongType())])
    step = 1 if not books or len(books[0]) <= 256 else 2

    def run(batches):
        searched = [Codebook(b) for b in books]
        for batch in _chunks(batches):
            at, q = _matrix(batch.column("__q"), parts * width) if width else (np.zeros(0, np.int64), None)
            codes, errors = np.zeros((len(at), parts), f"<u{step}"), np.zeros(len(at), np.int64)
            if len(at):
                _check_range(q, parts * width)
                before = b"".join(x if x is not None else bytes(parts * step) for x in batch.column("__code").take(pa.array(at)).to_pylist())
                start = np.frombuffer(before, f"<u{step}").reshape(len(at), parts).astype(np.int64)
                for p, book in enumerate(searched):
                    index, low = book.search(q[:, p * width : (p + 1) * width], start[:, p])
                    codes[:, p] = index
                    errors += low
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            code[at] = [x.tobytes() for x in codes]
            error[at] = errors
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(code, pa.binary()), pa.array(error, pa.int64())], names=[*names, "__code", "__error"])

    return rows.mapInArrow(run, schema)


def _sums(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, pos, s, n): sums of the parts of each entry, first inside each task."""
    parts, size, width = len(books), len(books[0]), books[0].shape[1]
    step = 1 if size <= 256 else 2

    def run(batches):
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in _chunks(batches):
            at, q = _matrix(batch.column("__q"), parts * width)
            if not len(at):
                continue
            codes = np.frombuffer(b"".join(batch.column("__code").take(pa.array(at)).to_pylist()), f"<u{step}").reshape(len(at), parts)
            for p in range(parts):
                by_code = np.argsort(codes[:, p], kind="stable")
                sorted_codes = codes[by_code, p]
                first = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
                used = sorted_codes[first].astype(np.int64)
                total[p, used] += np.add.reduceat(q[by_code, p * width : (p + 1) * width], first, axis=0)
                count[p, used] += np.diff(np.r_[first, len(at)])
        part, entry = np.nonzero(count)
        values = total[part, entry]
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        sums = pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    partial = coded.select("__q", "__code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))


def compress(vectors: DataFrame, vector: str, order: str, carry: list[str], params: CodeParams = CodeParams()) -> tuple[DataFrame, list[np.ndarray], str]:
    """Codes of all vectors: carry columns as c0, c1, ..., `code` (binary) and `error`; the final codebooks; the scratch table behind.

    `order` names the id whose smallest values give the first entries.
    """
    v, p = F.col("__v"), params
    named = vectors.select(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)], column(order).alias("__id"), column(vector).alias("__v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * p.scale).cast("long"))
    kept = named.where(v.isNotNull() & F.forall(v, finite))
    first = [r[0] for r in kept.select(scaled.alias("__q"), "__id").orderBy(F.asc_nulls_last("__id"), "__q").limit(p.entries).collect()]
    dim = len(first[0]) if first else 0
    usable = dim if dim % p.parts == 0 else 0
    start = np.array([x for x in first if len(x) == dim], np.int64) if usable else np.zeros((0, 0), np.int64)
    _check_range(start, dim)
    books = [start[:, i * dim // p.parts : (i + 1) * dim // p.parts] for i in range(p.parts)] if usable else []
    rows = kept.select(*[f"c{i}" for i in range(len(carry))], scaled.alias("__q"), F.lit(None).cast("binary").alias("__code"))
    spark, before = vectors.sparkSession, []
    for last in [False] * p.rounds + [True] if usable else [True]:
        rows, path = materialize(_assigned(rows, books), "codes")
        discard(spark, *before)
        before = [path]
        if not last:
            s, n = F.col("s"), F.col("n")
            means = _sums(rows, books).select("part", "entry", "pos", F.expr("(s - pmod(s, n)) div n").alias("x"))
            books = [b.copy() for b in books]
            for r in means.toLocalIterator():  # entries times dimensions, however many vectors there are
                books[r.part][r.entry, r.pos] = r.x
    return rows.select(*[f"c{i}" for i in range(len(carry))], F.col("__code").alias("code"), F.col("__error").alias("error")), books, before[0]


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str) -> DataFrame:
    """coded with `label_error`: errors summed over equal labels, nulls together; sums are formed before the shuffle."""
    sums, _ = materialize(coded.groupBy(F.col(label).alias("__l")).agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if small_enough(sums) else sums
    return coded.join(side, F.col(label).eqNullSafe(F.col("__l"))).drop("__l")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id", ["vec_id", "label"])
    return with_label_error(coded, "c1").select(
        F.col("c0").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )


def oracle(p: CodeParams = CodeParams()) -> str:
    def assigned(i: int) -> str:
        return f"""
    a{i} AS MATERIALIZED (
      SELECT v.r, v.part, any_value(v.x) AS x, min(d.entry) FILTER (d.dist = v.low) AS entry, any_value(v.low) AS dist FROM (
        SELECT r, part, x, min(dist) AS low FROM d{i} GROUP BY r, part, x) v JOIN d{i} d ON d.r = v.r AND d.part = v.part GROUP BY v.r, v.part),"""

    def distances(i: int) -> str:
        return f"""
    d{i} AS MATERIALIZED (
      SELECT r, p.part, p.x, entry, list_sum(list_transform(list_zip(p.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
      FROM p JOIN b{i} ON b{i}.part = p.part),"""

    def renewed(i: int) -> str:
        return f"""
    s{i} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (
      SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY ALL),
    b{i + 1} AS MATERIALIZED (
      SELECT b{i}.part, b{i}.entry, coalesce(m.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
        SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{i} GROUP BY part, entry) m ON m.part = b{i}.part AND m.entry = b{i}.entry),"""

    steps = "".join(distances(i) + assigned(i) + (renewed(i) if i < p.rounds else "") for i in range(p.rounds + 1))
    k = p.rounds
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS r, q FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    p AS MATERIALIZED (
      SELECT r, part, q[part * len(q) // {p.parts} + 1 : (part + 1) * len(q) // {p.parts}] AS x FROM kept, range({p.parts}) AS g(part)),
    b0 AS MATERIALIZED (SELECT part, r AS entry, x AS c FROM p WHERE r < {p.entries}),{steps}
    out AS (
      SELECT vec_id, label, code, error FROM kept JOIN (
        SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{k} GROUP BY r) e ON e.r = kept.r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{k}) AS codebooks_sha256 FROM out"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": oracle()}
