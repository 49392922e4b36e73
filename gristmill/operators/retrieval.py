"""Dense and lexical retrieval, ranking, merging and packing, as lazy plans over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from gristmill.functions import text as fn
from gristmill.scratch import discard, materialize

#: Query vectors that are broadcast at a time; more of them are searched in blocks.
QUERY_BLOCK = 4096


def payload_filter(filters: dict, arrays: Sequence[str] = ()) -> Column:
    """Filter of the vector side: AND over fields; a number means at least, a list any of, null a missing value."""
    out = F.lit(True)
    for key, value in filters.items():
        c = F.col(key)
        if isinstance(value, list):
            if not value:
                continue
            test = F.arrays_overlap(c, F.array(*map(F.lit, value))) if key in arrays else c.isin(value)
        elif value is None:
            test = c.isNull()
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            test = c >= value
        else:
            test = F.array_contains(c, value) if key in arrays else c == value
        out = out & test
    return out


MIRROR_FIELDS = ("file_path", "name", "parent_name", "chunk_type", "language")


def mirror_filter(filters: dict) -> Column:
    """Filter of the relational side: five fields only, numbers mean equality, nulls are dropped."""
    out = F.lit(True)
    for key, value in filters.items():
        if key not in MIRROR_FIELDS or value is None:
            continue
        values = [v for v in value if v is not None] if isinstance(value, list) else [value]
        if values:
            out = out & F.col(key).isin(values)
    return out


def normalized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """`vector` as unit doubles, so that cosine is a dot product."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(vector, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _packed(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Blocks (n, dim, ids, vectors, whole) of at most `rows` unit vectors of one length each; a vector with a null in it, or none, is not whole and counts as null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        out = lambda dim, xs: pa.RecordBatch.from_pylist([{"n": len(xs), "dim": dim, "ids": np.array([x[0] for x in xs], np.int64).tobytes(), "vectors": np.array([x[1] for x in xs], np.float64).tobytes(), "whole": np.array([x[2] for x in xs], bool).tobytes()}], _BLOCK_SCHEMA)
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = v is not None and None not in v
                dim = len(v) if whole else -1
                held.setdefault(dim, []).append((_NO_ID if i is None else i, v if whole else [], whole))
                if len(held[dim]) == rows:
                    yield out(dim, held.pop(dim))
        yield from (out(dim, xs) for dim, xs in held.items())

    return normalized(df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "v").mapInArrow(pack, "n int, dim int, ids binary, vectors binary, whole binary")


_BLOCK_SCHEMA = pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("whole", pa.binary())])
_NO_ID = -(1 << 63)
#: Points of a block, and places of a rounded score within which two sums of one product may differ.
POINT_BLOCK, _DOUBT = 1024, 1e-5
#: Pairs of blocks that go to Python at a time.
PAIRS = 8


class _Best:
    """The best k points of each query of a block so far, with those that rounding leaves in doubt.

    A product of matrices finds the points that may be among the best; their scores are then summed
    term by term in the order of `dot`, so that they are the same to the last bit.
    """

    def __init__(self, qids: np.ndarray, k: int) -> None:
        self.k, self.qids = k, qids
        self.low, self.last = np.full(len(qids), -np.inf), np.full(len(qids), np.iinfo(np.int64).max)
        self.full = np.zeros(len(qids), bool)
        self.q, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.null = np.empty(0, bool)

    def _sides(self, score: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounded scores, as low and as high as they may be; nulls come last and NaN first."""
        out = []
        for doubt in (-_DOUBT, _DOUBT):
            x = np.floor(score * 1e6 + 0.5 + doubt)
            x[np.isnan(x)] = np.inf
            x[null] = -1e300
            out.append(x)
        return out[0], out[1]

    def add(self, ids: np.ndarray, p: np.ndarray | None, q: np.ndarray | None, p_whole: np.ndarray, q_whole: np.ndarray) -> None:
        if p is None or q is None:  # lengths that differ, or no vectors: all null
            may = np.repeat(~self.full[None, :] | (self.low[None, :] <= -1e300), len(p_whole), 0)
            i, j = np.nonzero(may)
            score, null = np.zeros(len(i)), np.ones(len(i), bool)
        else:
            near = p @ q.T
            limit = np.where(self.full, (self.low - 1.0) / 1e6, -np.inf)
            if not self.full.all() and len(ids) > self.k:  # the block's own k best bound what may come
                limit = np.maximum(limit, np.where(np.isnan(near).any(0), -np.inf, np.partition(near, len(ids) - self.k, 0)[len(ids) - self.k] - 2e-6))
            i, j = np.nonzero(~(near < limit[None, :]))
            few = ~self.full[j] | (np.floor(near[i, j] * 1e6 + 0.5 + _DOUBT) > self.low[j]) | (ids[i] <= self.last[j]) | np.isnan(near[i, j])
            i, j = i[few], j[few]
            score, null = np.empty(len(i)), np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                score[part] = (p[i[part]] * q[j[part]]).cumsum(1)[:, -1] if p.shape[1] else 0.0
        if len(i):
            self._merge(np.concatenate([self.q, j]), np.concatenate([self.ids, ids[i]]), np.concatenate([self.score, score]), np.concatenate([self.null, null]))

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        low, high = self._sides(score, null)
        order = np.lexsort((ids, -low, q))
        q, ids, score, null, low, high = (x[order] for x in (q, ids, score, null, low, high))
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.full[q[last]], self.low[q[last]], self.last[q[last]] = True, low[last], ids[last]
        keep = ~self.full[q] | (high > self.low[q]) | ((high == self.low[q]) & (ids <= self.last[q]))
        self.q, self.ids, self.score, self.null = q[keep], ids[keep], score[keep], null[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.q), 1 << 16):
            q, ids, score, null = (x[at : at + (1 << 16)] for x in (self.qids[self.q], self.ids, self.score, self.null))
            yield pa.RecordBatch.from_arrays([pa.array(q, mask=q == _NO_ID), pa.array(ids, mask=ids == _NO_ID), pa.array(score, mask=null, from_pandas=False)], names=["q", "p", "dot"])


def dense_topk(points: DataFrame, queries: DataFrame, k: int, point_id: str, vector: str = "embedding", match: Column | None = None) -> DataFrame:
    """(qid, point id, score, rank): the k nearest points of every query, ties by id.

    Every point is scored for every query. The stated queries (qid, qvec) are packed and go to every
    task in blocks; a task multiplies its blocks of points with them and keeps its own k best of a query. With
    more queries than QUERY_BLOCK, each part's hits are written before the next is sent. Searches with
    `match`, and ids that are not whole numbers, are scored pair by pair.
    """
    spark, whole = points.sparkSession, (LongType, IntegerType, ShortType, ByteType)
    types = points.schema[point_id].dataType, queries.schema["qid"].dataType
    packed = match is None and all(isinstance(t, whole) for t in types)
    blocks = max(-(-queries.count() // QUERY_BLOCK), 1)
    if not packed and blocks == 1:
        return _search_block(points, queries, k, point_id, vector, match)
    if packed:
        dealt = points.select(point_id, vector).repartition(spark.sparkContext.defaultParallelism)
        held, held_path = materialize(_packed(dealt, point_id, vector, POINT_BLOCK), "points")
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        if packed:
            hits = _search_packed(held, block, k).toDF("qid", point_id, "dot").select(F.col("qid").cast(types[1]), F.col(point_id).cast(types[0]), F.round("dot", 6).alias("score"))
        else:
            hits, _ = materialize(_search_block(points, block, k, point_id, vector, match), "hits")
        found = hits if found is None else found.union(hits)
    if not packed:
        return found
    discard(spark, held_path)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), point_id)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _search_packed(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, p, dot) of the best k points of each query in each task, and those in doubt; points are packed, queries (qid, qvec) make one or two blocks."""
    spark, key = points.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked, asked_path = materialize(_packed(queries.repartition(1), "qid", "qvec", 2048), "asked")  # at most about QUERY_BLOCK rows
    pairs = points.crossJoin(F.broadcast(asked.toDF("q_n", "q_dim", "q_ids", "q_vectors", "q_whole")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, _Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                if x["q_ids"] not in held:
                    held[x["q_ids"]] = _Best(np.frombuffer(x["q_ids"], np.int64), k)
                alike = x["dim"] == x["q_dim"] >= 0
                p, q = (np.frombuffer(x[v], np.float64).reshape(x[n], x["dim"]) if alike else None for v, n in (("vectors", "n"), ("q_vectors", "q_n")))
                held[x["q_ids"]].add(np.frombuffer(x["ids"], np.int64), p, q, np.frombuffer(x["whole"], bool), np.frombuffer(x["q_whole"], bool))
        for b in held.values():
            yield from b.rows()

    before = spark.conf.get(key)
    spark.conf.set(key, str(PAIRS))  # a row holds a megabyte or two
    try:
        found, _ = materialize(pairs.mapInArrow(best, "q long, p long, dot double"), "hits")
    finally:
        spark.conf.set(key, before)
    discard(spark, asked_path)
    return found


def _search_block(points: DataFrame, queries: DataFrame, k: int, point_id: str, vector: str, match: Column | None) -> DataFrame:
    pairs = normalized(points, vector).join(F.broadcast(normalized(queries, "qvec")), match if match is not None else F.lit(True))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), point_id)
    return (
        pairs.select("qid", point_id, F.round(dot(F.col(vector), F.col("qvec")), 6).alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    )


def merge_hits(hits: DataFrame, point_id: str) -> DataFrame:
    """One row a point: the queries that found it; the first query's hit gives the score, not the best."""
    place = F.struct("qid", "rank")
    return hits.groupBy(point_id).agg(
        F.min_by("score", place).alias("score"), F.min(place).alias("_p"), F.sort_array(F.collect_list("qid")).alias("matched")
    ).select(point_id, "score", "matched", F.col("_p.qid").alias("first_query"), F.col("_p.rank").alias("first_rank"))


def mean_vectors(points: DataFrame, by: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Mean vector of each group, summed position by position before the shuffle."""
    flat = points.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.round(F.avg(F.col("x").cast("double")), 8).alias("x"))
    return flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))


def lod_drill(points: DataFrame, queries: DataFrame, module: str, file: str, point_id: str, k: int, modules: int = 3, files: int = 5) -> DataFrame:
    """Nearest modules of each query vector, then their nearest files, then the nearest points of those."""
    top_modules = dense_topk(mean_vectors(points, [module]), queries, modules, module)
    in_modules = queries.join(top_modules.groupBy("qid").agg(F.collect_list(module).alias("_modules")), "qid")
    means = mean_vectors(points, [module, file]).withColumn("_f", F.struct(module, file))
    top_files = dense_topk(means, in_modules, files, "_f", match=F.array_contains("_modules", F.col(module)))
    in_files = queries.join(top_files.groupBy("qid").agg(F.collect_list("_f").alias("_files")), "qid")
    return dense_topk(points, in_files, k, point_id, match=F.array_contains("_files", F.struct(module, file)))


def lexical_topk(chunks: DataFrame, score: Column, k: int, ties: Sequence[str]) -> DataFrame:
    return chunks.withColumn("raw", F.round(score, 6)).where("raw IS NOT NULL").orderBy(F.desc("raw"), *ties).limit(k)


def candidates(terms: Sequence[str], path: Column, name: Column, parent: Column, code: Column) -> Column:
    """Chunks that any term touches: equal name or parent, or inside path or code, without regard to case."""
    test = F.lit(False)
    for t in map(str.lower, terms):
        test = test | (F.lower(name) == t) | (F.lower(parent) == t) | F.contains(F.lower(path), F.lit(t)) | F.contains(F.lower(code), F.lit(t))
    return test


KEY = ("file_path", "start_line", "end_line", "chunk_type", "name")


def promote_lexical(dense: DataFrame, lexical: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """Dense hits and those lexical ones that are no dense hit, squashed into the dense band and marked `lex:`."""
    extra = lexical.join(dense.select(*KEY), list(KEY), "left_anti").withColumn("score", fn.squash_lexical(F.col("raw"))).drop("raw")
    if payload is not None:
        more = [c for c in payload.columns if c != "point_id"]
        joined = extra.join(payload.select("point_id", *[F.col(c).alias(f"_{c}") for c in more]), "point_id", "left")
        extra = joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in more else F.col(c) for c in extra.columns], *[F.col(f"_{c}").alias(c) for c in more if c not in extra.columns])
    extra = extra.withColumn("point_id", F.concat(F.lit("lex:"), "point_id"))
    return dense.unionByName(extra, allowMissingColumns=True)


def _literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def sanity_filter(hits: DataFrame, symbols: Sequence[str], content: str = "content", fields: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Hits that mention a symbol; all of them if none does."""
    if not symbols:
        return hits
    ok = F.lit(False)
    for s in symbols:
        ok = ok | F.col(content).rlike(rf"\b{_literal(s)}\b")
        for f in fields:
            ok = ok | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(s.lower()))
    flagged = hits.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    if by:
        return flagged.withColumn("_any", F.max("_ok").over(Window.partitionBy(*by))).where("_ok OR NOT _any").drop("_ok", "_any")
    found = flagged.agg(F.coalesce(F.max("_ok"), F.lit(False)).alias("_any"))  # one row
    return flagged.join(F.broadcast(found), F.col("_ok") | ~F.col("_any")).drop("_ok", "_any")


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def first_by_path(pool: DataFrame, path: str = "file_path", priority: str = "priority", place: str = "pos") -> DataFrame:
    """The row of the best source for each path."""
    order = Window.partitionBy(path).orderBy(priority, place)
    return pool.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def line_budget(docs: DataFrame, doc_id: str, text: str, tokens: int) -> DataFrame:
    """Whole lines of each text within a token budget; a first line beyond it is cut to the budget's bytes.

    A text within the budget is kept as it is, otherwise trailing white space goes.
    """
    most = 4 * tokens
    t = F.col(text)
    lines = F.split(F.regexp_replace(t, "\n$", ""), "\n")
    ends = F.aggregate(
        lines, F.struct(F.lit("").alias("out"), F.lit(False).alias("stop")),
        lambda a, x: F.when(a["stop"], a).when(
            (a["out"] != "") & (F.octet_length(a["out"]) + 1 + F.octet_length(x) > most), F.struct(a["out"].alias("out"), F.lit(True).alias("stop"))
        ).when((a["out"] == "") & (F.octet_length(x) > most), F.struct(F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, most).cast("string")).alias("out"), F.lit(True).alias("stop")))
        .otherwise(F.struct(F.when(a["out"] == "", x).otherwise(F.concat(a["out"], F.lit("\n"), x)).alias("out"), F.lit(False).alias("stop"))),
    )
    kept = F.when(F.lit(tokens == 0), "").when(F.octet_length(t) <= most, t).otherwise(F.regexp_replace(ends["out"], r"\s+$", ""))
    return docs.select(doc_id, kept.alias("kept")).withColumn("tokens", F.when(F.lit(tokens == 0), 0).otherwise(fn.estimate_tokens(F.col("kept"))).cast("long"))


def usage_trim(usages: DataFrame, directories: DataFrame, symbols: Sequence[str], first: int = 10, most: int = 15) -> DataFrame:
    """Usages (pos, file_path) in a definition's directory, in a file named like a symbol, or early; the first of those."""
    stem = F.lower(fn.file_stem(F.col("file_path")))
    named = F.lit(False)
    for s in symbols:
        named = named | F.contains(stem, F.lit(s.lower()))
    near = usages.withColumn("_d", fn.parent_dir(F.col("file_path"))).join(directories.select(F.col("dir").alias("_d"), F.lit(True).alias("_near")).distinct(), "_d", "left")
    return near.where(F.coalesce("_near", F.lit(False)) | named | (F.col("pos") <= first)).orderBy("pos").limit(most).drop("_d", "_near")


def sliding_chunks(docs: DataFrame, path: Column, text: Column, window: int = 60, step: int = 50) -> DataFrame:
    """Windows of lines: columns of docs, start_line, end_line, content; blank windows are skipped and the last one reaches the end."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    n = F.size("_lines")
    last = F.greatest(F.lit(0), F.ceil((n - window) / F.lit(step))).cast("int")
    at = F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    return (
        docs.withColumn("_lines", lines).withColumn("file_path", path).withColumn("_at", at)
        .withColumn("content", F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(window)), "\n"))
        .where(F.trim(F.regexp_replace("content", r"\s", "")) != "")
        .withColumn("start_line", (F.col("_at") + 1).cast("long")).withColumn("end_line", F.least(F.col("_at") + window, n).cast("long")).drop("_lines", "_at")
    )
