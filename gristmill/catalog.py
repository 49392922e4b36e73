"""Queries over the driver's tables, one or more for each operator, with SQL that must agree.

The tables hold no source code, so each operator runs on the closest table: documents stand for
chunks (source as path, language as language, first word as name), suppliers for files, line
items for references and edges, events for the query log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as fn
from gristmill.operators import extract, index, jvm, retrieval, stats, symbols
from gristmill.plans import planner
from gristmill.sources import files as sources
from gristmill.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- dense retrieval -------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_TOP = f"""SELECT q.vec_id AS qid, p.vec_id, {_COS.format(a="p.embedding", b="q.embedding")} AS score FROM embeddings p, embeddings q WHERE q.vec_id < {{n}} AND {{where}}"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({top}) QUALIFY rank <= {k}"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _questions(points, n):
    return points.where(F.col("vec_id") < n).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@query(_RANKED.format(top=_TOP.format(n=20, where="true"), k=10))
def dense_topk(spark, sf_dir):
    points = _points(spark, sf_dir)
    return retrieval.dense_topk(points, _questions(points, 20), 10, "vec_id")


@query(_RANKED.format(top=_TOP.format(n=20, where="p.label >= 3"), k=10))
def filtered_topk(spark, sf_dir):
    points = _points(spark, sf_dir)
    return retrieval.dense_topk(points.where(retrieval.payload_filter({"label": 3})), _questions(points, 20), 10, "vec_id")


@query(_RANKED.format(top=_TOP.format(n=5, where="p.vec_id % 7 = 0"), k=5))
def diff_restricted_topk(spark, sf_dir):
    points = _points(spark, sf_dir)
    changed = points.where("vec_id % 7 = 0").select("vec_id")
    return retrieval.dense_topk(points.join(changed, "vec_id", "left_semi"), _questions(points, 5), 5, "vec_id")


@query(f"""WITH h AS ({_RANKED.format(top=_TOP.format(n=12, where="true"), k=15)})
SELECT vec_id, arg_min(score, qid) AS score, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS matched, min(qid) AS first_query, arg_min(rank, qid) AS first_rank
FROM h GROUP BY vec_id""")
def multi_query_merge(spark, sf_dir):
    points = _points(spark, sf_dir)
    hits = retrieval.dense_topk(points, _questions(points, 12), 15, "vec_id")
    return retrieval.merge_hits(hits, "vec_id").withColumn("matched", F.concat_ws(",", F.transform("matched", lambda x: x.cast("string"))))


@query(f"""WITH p AS (SELECT vec_id, embedding, label, vec_id % 10 AS file FROM embeddings), q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
flat AS (SELECT label, file, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM p),
m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 8) AS x FROM flat GROUP BY label, i) GROUP BY label),
tm AS (SELECT label FROM m, q ORDER BY {_COS.format(a="m.v", b="q.v")} DESC, label LIMIT 3),
f AS (SELECT label, file, list(x ORDER BY i) AS v FROM (SELECT label, file, i, round(avg(CAST(x AS DOUBLE)), 8) AS x FROM flat WHERE label IN (FROM tm) GROUP BY label, file, i) GROUP BY label, file),
tf AS (SELECT label, file FROM f, q ORDER BY {_COS.format(a="f.v", b="q.v")} DESC, label, file LIMIT 5)
SELECT CAST(0 AS BIGINT) AS qid, vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT vec_id, {_COS.format(a="p.embedding", b="q.v")} AS score FROM p JOIN tf USING (label, file), q) QUALIFY rank <= 10""")
def lod_drill(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("file", F.col("vec_id") % 10)
    return retrieval.lod_drill(points, _questions(points, 1), "label", "file", "vec_id", 10)


# The same searches with every row as a query whose id is divisible by 50. Those above keep a few queries.

_TOP_50 = f"""SELECT q.vec_id AS qid, p.vec_id, {_COS.format(a="p.embedding", b="q.embedding")} AS score FROM embeddings p, embeddings q WHERE q.vec_id % 50 = 0 AND {{where}}"""


def _all_questions(points):
    return points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@query(_RANKED.format(top=_TOP_50.format(where="true"), k=10))
def dense_topk_all(spark, sf_dir):
    points = _points(spark, sf_dir)
    return retrieval.dense_topk(points, _all_questions(points), 10, "vec_id")


@query(_RANKED.format(top=_TOP_50.format(where="p.label >= 3"), k=10))
def filtered_topk_all(spark, sf_dir):
    points = _points(spark, sf_dir)
    return retrieval.dense_topk(points.where(retrieval.payload_filter({"label": 3})), _all_questions(points), 10, "vec_id")


@query(_RANKED.format(top=_TOP_50.format(where="p.vec_id % 7 = 0"), k=5))
def diff_restricted_topk_all(spark, sf_dir):
    points = _points(spark, sf_dir)
    changed = points.where("vec_id % 7 = 0").select("vec_id")
    return retrieval.dense_topk(points.join(changed, "vec_id", "left_semi"), _all_questions(points), 5, "vec_id")


@query(f"""WITH h AS ({_RANKED.format(top=_TOP_50.format(where="true"), k=15)})
SELECT vec_id, arg_min(score, qid) AS score, string_agg(CAST(qid AS VARCHAR), ',' ORDER BY qid) AS matched, min(qid) AS first_query, arg_min(rank, qid) AS first_rank
FROM h GROUP BY vec_id""")
def multi_query_merge_all(spark, sf_dir):
    points = _points(spark, sf_dir)
    hits = retrieval.dense_topk(points, _all_questions(points), 15, "vec_id")
    return retrieval.merge_hits(hits, "vec_id").withColumn("matched", F.concat_ws(",", F.transform("matched", lambda x: x.cast("string"))))


@query(f"""WITH p AS (SELECT vec_id, embedding, label, vec_id % 10 AS file FROM embeddings), q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
flat AS (SELECT label, file, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM p),
m AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 8) AS x FROM flat GROUP BY label, i) GROUP BY label),
tm AS (SELECT qid, label FROM m, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_COS.format(a="m.v", b="q.v")} DESC, label) <= 3),
f AS (SELECT label, file, list(x ORDER BY i) AS v FROM (SELECT label, file, i, round(avg(CAST(x AS DOUBLE)), 8) AS x FROM flat GROUP BY label, file, i) GROUP BY label, file),
tf AS (SELECT qid, label, file FROM f JOIN tm USING (label) JOIN q USING (qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_COS.format(a="f.v", b="q.v")} DESC, label, file) <= 5)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT qid, vec_id, {_COS.format(a="p.embedding", b="q.v")} AS score FROM p JOIN tf USING (label, file) JOIN q USING (qid)) QUALIFY rank <= 10""")
def lod_drill_all(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("file", F.col("vec_id") % 10)
    return retrieval.lod_drill(points, _all_questions(points), "label", "file", "vec_id", 10)


# ---- chunks, ids, scalar functions -----------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, 5 * greatest(0, CAST(ceil((len(ls) - 6) / 5.0) AS INT)) + 1, 5)) AS a FROM l)
SELECT doc_id, CAST(a + 1 AS BIGINT) AS start_line, CAST(least(a + 6, len(ls)) AS BIGINT) AS end_line, sha256(array_to_string(ls[a+1:a+6], chr(10)))[1:16] AS content_hash,
sha256('doc/' || doc_id || ':document:' || (a + 1) || ':' || least(a + 6, len(ls)))[1:16] AS chunk_id, greatest(1, CAST(ceil(strlen(array_to_string(ls[a+1:a+6], chr(10))) / 4.0) AS BIGINT)) AS tokens
FROM w WHERE regexp_matches(array_to_string(ls[a+1:a+6], chr(10)), '\\S')""")
def sliding_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = retrieval.sliding_chunks(docs, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.col("text"), 6, 5)
    return chunks.select(
        "doc_id", "start_line", "end_line", fn.content_hash(F.col("content")).alias("content_hash"),
        fn.chunk_id(F.col("file_path"), F.lit("document"), F.col("start_line"), F.col("end_line")).alias("chunk_id"), fn.estimate_tokens(F.col("content")).alias("tokens"),
    )


@query("""SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id
FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents)""")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.point_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("point_id"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bBearer\s+[A-Za-z0-9._\-+/=]+\b', 'Bearer <redacted>', 'g'),
'(?i)\b(api[_-]?key|token|secret|password)\b\s*[:=]\s*([^\s,;]+)', '\1=<redacted>', 'g'), '\bsk-[A-Za-z0-9]{16,}\b', '<redacted>', 'g'), '\bAIza[0-9A-Za-z_-]{20,}\b', '<redacted>', 'g') AS text FROM documents""")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.redact(F.col("text")).alias("text"))


@query(r"""SELECT page_id, array_to_string(list_filter(list_distinct(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)), lambda x: x NOT IN ('if', 'for', 'while')), ',') AS called FROM pages""")
def call_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", fn.call_names(F.col("html"), ("if", "for", "while"))).alias("called"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


@query("""SELECT p_partkey, 'src/' || p_name || ':' || p_size || '-? (' || p_brand || '.' || p_name || ')' AS citation, regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') AS safe FROM part""")
def citations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.citation(F.concat(F.lit("src/"), "p_name"), F.col("p_size"), F.lit(None).cast("int"), F.col("p_name"), F.col("p_brand")).alias("citation"), fn.sanitize_name(F.col("p_brand")).alias("safe"))


# ---- lexical ---------------------------------------------------------------------------------

_TERMS = planner.query_terms("'the onnt' thereon and shand tionre")
_CHUNKS = """SELECT doc_id, source AS file_path, coalesce(nullif(regexp_extract(text, '^\\w+', 0), ''), '') AS name, lang AS parent_name,
CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'document' END AS chunk_type, lang AS language, text AS code FROM documents"""


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("file_path"), F.regexp_extract("text", "^[0-9A-Za-z_]+", 0).alias("name"), F.col("lang").alias("parent_name"),
        F.when(F.col("doc_id") % 3 == 0, "function").otherwise("document").alias("chunk_type"), F.col("lang").alias("language"), F.col("text").alias("code"),
    )


def _ranked_sql(kind: bool) -> str:
    text = "lower(file_path || ' ' || name || ' ' || parent_name || ' ' || code)"
    score = "1.0"
    for t in map(str.lower, _TERMS):
        score += f" + CASE WHEN lower(name) = '{t}' THEN 4.0 WHEN lower(parent_name) = '{t}' THEN 2.5 WHEN contains(lower(file_path), '{t}') THEN 1.5 ELSE 0 END"
        score += f" + least(8, (length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}) * 0.25"
    return f"CAST({score} AS DOUBLE)" + (" + CASE WHEN chunk_type IN ('function', 'method') THEN 0.6 ELSE 0.0 END" if kind else "")


_FRACTION = f"""(SELECT CASE WHEN m > 0 THEN m / {float(len(_TERMS))} + CASE WHEN lower(name) IN ({', '.join(repr(t.lower()) for t in _TERMS)}) THEN 1.0 ELSE 0.0 END END FROM (SELECT {
    ' + '.join(f"CASE WHEN contains(lower(name || ' ' || code), '{t.lower()}') THEN 1 ELSE 0 END" for t in _TERMS)} AS m))"""


@query(f"SELECT doc_id, round({_ranked_sql(True)}, 6) AS a, round({_ranked_sql(False)}, 6) AS b, round({_FRACTION}, 6) AS c FROM ({_CHUNKS})")
def lexical_scores(spark, sf_dir):
    cols = [F.col(c) for c in ("file_path", "name", "parent_name", "code")]
    return _chunks(spark, sf_dir).select(
        "doc_id", F.round(fn.score_ranked(*cols, F.col("chunk_type"), _TERMS), 6).alias("a"), F.round(fn.score_ranked(*cols, None, _TERMS), 6).alias("b"),
        F.round(fn.score_fraction(F.col("name"), F.col("code"), [t.lower() for t in _TERMS]), 6).alias("c"),
    )


_TOUCHED = " OR ".join(f"lower(name) = '{t}' OR lower(parent_name) = '{t}' OR contains(lower(file_path), '{t}') OR contains(lower(code), '{t}')" for t in map(str.lower, _TERMS))


@query(f"SELECT doc_id, round({_ranked_sql(True)}, 6) AS raw FROM ({_CHUNKS}) WHERE {_TOUCHED} ORDER BY raw DESC, doc_id LIMIT 25")
def lexical_topk(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    cols = [F.col(x) for x in ("file_path", "name", "parent_name", "code")]
    return retrieval.lexical_topk(c.where(retrieval.candidates(_TERMS, *cols)), fn.score_ranked(*cols, F.col("chunk_type"), _TERMS), 25, ["doc_id"]).select("doc_id", "raw")


_HIT = "'d' || doc_id AS point_id, file_path, doc_id AS start_line, doc_id + 9 AS end_line, chunk_type, name"


@query(f"""WITH c AS ({_CHUNKS}), d AS (SELECT {_HIT}, round(0.5 + (doc_id % 10) / 100.0, 6) AS score FROM c WHERE doc_id % 4 = 0),
l AS (SELECT {_HIT}, round({_ranked_sql(True)}, 6) AS raw FROM c ORDER BY raw DESC, doc_id LIMIT 40)
SELECT point_id, file_path, start_line, end_line, chunk_type, name, CAST(score AS DOUBLE) AS score FROM d
UNION ALL SELECT 'lex:' || point_id, file_path, start_line, end_line, chunk_type, name, round(0.75 * raw / (raw + 3.0), 6) FROM l WHERE start_line % 4 <> 0""")
def lexical_promote(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    hit = c.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("point_id"), "file_path", F.col("doc_id").alias("start_line"), (F.col("doc_id") + 9).alias("end_line"), "chunk_type", "name", "parent_name", "code", "doc_id")
    dense = hit.where("doc_id % 4 = 0").withColumn("score", F.expr("0.5D + (doc_id % 10) / 100.0D"))
    cols = [F.col(x) for x in ("file_path", "name", "parent_name", "code")]
    lexical = retrieval.lexical_topk(hit, fn.score_ranked(*cols, F.col("chunk_type"), _TERMS), 40, ["doc_id"])
    drop = ("parent_name", "code", "doc_id")
    return retrieval.promote_lexical(dense.drop(*drop), lexical.drop(*drop)).withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM documents)
SELECT doc_id, count(*) AS n_terms FROM t WHERE term IN ('the', 'onnt', 'thereon') GROUP BY doc_id""")
def term_match(spark, sf_dir):
    terms = F.array(*map(F.lit, ("the", "onnt", "thereon")))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(tokens, terms)).cast("long").alias("n_terms")).where("n_terms > 0")


# ---- ranking ---------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey, CAST(floor(epoch(TIMESTAMP '1998-12-31 12:00:00' - o_orderdate) / 86400) AS BIGINT) AS days FROM orders)
SELECT o_orderkey, round(0.5 + 0.15 * CASE WHEN days <= 0 THEN 1.0 WHEN days >= 90 THEN 0.0 ELSE exp(-days / 30.0) END
 + 0.10 * CASE WHEN o_custkey % 4 = 0 THEN 0.0 WHEN o_custkey % 4 = 1 THEN 1.0 WHEN o_custkey % 4 = 2 THEN 0.5 ELSE 0.2 END
 + 0.05 * greatest(-1.0, least(1.0, CASE WHEN o_orderstatus = 'F' THEN -0.5 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN o_custkey % 30 > 20 THEN -0.2 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0.3 ELSE 0 END)), 6) AS score FROM o""")
def quality_recency_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    m = F.col("o_custkey") % 4
    patterns = F.when(m == 1, F.array(F.lit("cache"))).when(m == 2, F.array(F.lit("service"))).when(m == 3, F.array(F.lit("other")))
    score = (
        F.lit(0.5) + fn.RECENCY_WEIGHT * fn.recency_score(stamp, F.lit("1998-12-31 12:00:00").cast("timestamp")) + fn.PATTERN_WEIGHT * fn.pattern_score(patterns, F.lit("The Cache"))
        + fn.QUALITY_WEIGHT * fn.quality_score(F.when(F.col("o_orderstatus") == "F", "true"), (F.col("o_custkey") % 2 == 0).cast("string"), F.lit(None).cast("string"), F.col("o_custkey") % 30, F.when(F.col("o_orderpriority").startswith("1"), "yes"))
    )
    return o.select("o_orderkey", F.round(score, 6).alias("score"))


_SANE = """WITH h AS (SELECT doc_id, lang, regexp_matches(text, '\\b{s}\\b') OR contains(lower(source), '{l}') AS ok FROM documents)
SELECT doc_id, lang FROM h WHERE ok OR NOT (SELECT bool_or(ok) FROM h)"""


@query(_SANE.format(s="The", l="src19"))
def sanity_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kept = retrieval.sanity_filter(d.withColumn("name", F.when(F.contains(F.lower("source"), F.lit("src19")), "The")), ["The"], "text", ["name"])
    return kept.select("doc_id", "lang")


@query(_SANE.format(s="PaymentService", l="paymentservice"))
def sanity_filter_empty(spark, sf_dir):
    return retrieval.sanity_filter(table(spark, sf_dir, "documents"), planner.sanity_symbols("Find PaymentService"), "text", ["source"]).select("doc_id", "lang")


@query("""SELECT p_partkey, round(p_retailprice / 1000 + least((p_size + 1) / 20.0, 2.0) + CASE WHEN trim(p_name) LIKE 'override %' THEN 1.5 ELSE 0 END - CASE WHEN p_size <= 0 THEN 1 ELSE 0 END, 6) AS score FROM part""")
def structural_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(symbols.structural_rank(F.col("p_retailprice") / 1000, F.lit(1), F.col("p_size") + 1, F.col("p_name"), F.lit("")), 6).alias("score"))


# ---- aggregates ------------------------------------------------------------------------------


@query("""SELECT source AS file_path, max(lang) AS language, count(*) AS n_chunks, count(nullif(regexp_extract(text, '^[0-9A-Za-z_]+', 0), '')) AS n_named, max(n_chars) AS updated_at,
array_to_string(list_sort(list_distinct(list(nullif(regexp_extract(text, '^[0-9A-Za-z_]+', 0), '')) FILTER (nullif(regexp_extract(text, '^[0-9A-Za-z_]+', 0), '') IS NOT NULL)))[1:20], ',') AS names FROM documents GROUP BY source""")
def code_files(spark, sf_dir):
    return stats.code_files(_chunks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("updated_at")), "doc_id"))


@query("SELECT lang AS language, count(*) AS n, round(avg(n_chars), 1) AS avg_complexity, max(n_chars) AS max_complexity, count(*) FILTER (n_chars > 10) AS n_complex FROM documents GROUP BY lang")
def overview(spark, sf_dir):
    return stats.overview(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"), "n_chars")


@query("""SELECT array_to_string(p[1:greatest(1, least(3, len(p) - 1))], '/') AS module, count(*) AS n_files FROM (SELECT string_split(split_part(url, '://', 2), '/') AS p FROM pages) GROUP BY ALL""")
def modules(spark, sf_dir):
    return symbols.modules_for(table(spark, sf_dir, "pages").select(F.element_at(F.split("url", "://"), 2).alias("path")))


@query("""WITH l AS (SELECT event_id AS id, ts, value AS latency_ms, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS results FROM events ORDER BY event_id DESC LIMIT 100),
r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM l WHERE latency_ms IS NOT NULL)
SELECT (SELECT count(*) FROM l) AS n, (SELECT round(sum(results) / count(*), 2) FROM l) AS avg_results, (SELECT count(*) FROM l WHERE ts > (SELECT max(ts) FROM l) - INTERVAL 60 SECOND) AS last_minute,
round(min(latency_ms) FILTER (i = floor(0.50 * (n - 1) + 0.5)), 1) AS p50, round(min(latency_ms) FILTER (i = floor(0.95 * (n - 1) + 0.5)), 1) AS p95 FROM r""")
def query_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("value").alias("latency_ms"), F.expr("CASE WHEN event_id % 5 > 0 THEN event_id % 5 END").alias("results"))
    return stats.query_stats(log)


@query("""SELECT event_type, min(value) FILTER (i = floor(0.5 * (n - 1) + 0.5)) AS p50, min(value) FILTER (i = floor(0.95 * (n - 1) + 0.5)) AS p95 FROM (
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return stats.nearest_rank(table(spark, sf_dir, "events"), "value", [50, 95], ["event_type"])


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def queries_per_minute(spark, sf_dir):
    return streams.per_minute(table(spark, sf_dir, "events"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def event_ring(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "ts")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 10""")
def enumerate_page(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where(retrieval.payload_filter({"c_mktsegment": "BUILDING"}))
    return retrieval.page(kept, ["c_custkey"], 10, 20).select("c_custkey", "c_name")


_POOL = """SELECT n_name AS file_path, 0 AS priority, CAST(n_nationkey AS BIGINT) AS pos, 'nation' AS origin FROM nation
UNION ALL SELECT n_name, 1, s_suppkey, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_name, 2, c_custkey, 'customer' FROM customer"""


@query(f"SELECT file_path, origin, pos FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY priority, pos) AS n FROM ({_POOL})) WHERE n = 1")
def pool_dedupe(spark, sf_dir):
    for name in ("nation", "supplier", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"gm_{name}")
    pool = _POOL
    for name in ("nation", "supplier", "customer"):
        pool = pool.replace(f"FROM {name}", f"FROM gm_{name}").replace(f"JOIN {name}", f"JOIN gm_{name}")
    return retrieval.first_by_path(spark.sql(pool)).select("file_path", "origin", "pos")


@query("""SELECT p_name AS name, count(*) AS n_defs, count(DISTINCT p_brand) AS n_paths, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS paths FROM part GROUP BY p_name HAVING count(*) > 1 AND count(DISTINCT p_brand) > 1""")
def disambiguate(spark, sf_dir):
    return symbols.disambiguate(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), "name", "p_brand")


@query("""SELECT n_name, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def repo_dashboard(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("b"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("a", F.lit(0)).alias("n_customers"), F.coalesce("b", F.lit(0)).alias("n_suppliers"))


@query("""SELECT label, count(*) AS n, round(avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM embeddings GROUP BY label""")
def coverage_summary(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0)), 4).alias("coverage"))


# ---- index lifecycle -------------------------------------------------------------------------

_STATE = """cur AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang, sha256(text)[1:16] AS hash FROM documents WHERE doc_id % 13 <> 0),
old AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(text)[1:16] END AS hash FROM documents WHERE doc_id % 11 <> 0)"""
_STATUS = "CASE WHEN o.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'deleted' WHEN o.hash = c.hash THEN 'unchanged' ELSE 'changed' END"


def _states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "lang", fn.content_hash(F.col("text")).alias("hash"))
    return d.where("doc_id % 13 != 0").drop("doc_id"), d.where("doc_id % 11 != 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("hash"))).drop("doc_id")


@query(f"WITH {_STATE} SELECT coalesce(c.path, o.path) AS path, {_STATUS} AS status FROM cur c FULL JOIN old o ON c.path = o.path")
def state_diff(spark, sf_dir):
    return index.state_diff(*_states(spark, sf_dir))


@query(f"WITH {_STATE} SELECT coalesce(c.path, o.path) AS path, {_STATUS} AS status FROM (FROM cur WHERE lang = 'en') c FULL JOIN (FROM old WHERE lang = 'en') o ON c.path = o.path")
def scoped_diff(spark, sf_dir):
    cur, old = _states(spark, sf_dir)
    return index.state_diff(cur.where("lang = 'en'"), old.where("lang = 'en'"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return index.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], [F.desc("event_id")])


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND user_id % 5 <> 0")
def delete_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return index.delete_where(index.delete_where(e, F.col("event_type") == "view"), F.col("user_id") % 5 == 0).select("event_id")


@query("""WITH d AS (SELECT DISTINCT sha256(text)[1:16] AS hash FROM documents)
SELECT hash, substr(hash, 1, 1) IN ('0', '1', '2', '3') AS cached, CASE WHEN substr(hash, 1, 1) IN ('0', '1', '2', '3') THEN 'c' || hash ELSE 'e' || hash END AS embedding FROM d""")
def embed_cache_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(fn.content_hash(F.col("text")).alias("hash")).distinct()
    now = F.lit("2024-06-01").cast("timestamp")
    first = F.substring("hash", 1, 1)
    cache = d.where(first.isin(*"01234567")).select("hash", F.concat(F.lit("c"), "hash").alias("embedding"), F.when(first.isin(*"0123"), now).otherwise(F.lit("2024-01-01").cast("timestamp")).alias("created_at"))
    return index.cached_embeddings(d, cache, now, lambda h: F.concat(F.lit("e"), h)).select("hash", "cached", "embedding")


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("text")).alias("asked"))
    return index.forward_fill(c, "asked", ["conv_id"], ["turn"])


@query("SELECT CAST(conv_id AS VARCHAR) AS file, arg_max(text, turn) AS summary FROM conversations WHERE trim(text) <> '' AND text NOT LIKE 'ERROR%' GROUP BY conv_id")
def vocab_last_wins(spark, sf_dir):
    return sources.last_summary(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("text").alias("summary"), F.col("turn").alias("at")))


@query("SELECT DISTINCT source AS path FROM documents WHERE source NOT IN ('src1', 'src2')")
def orphan_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("path"))
    return index.orphans(d, d.where(F.col("path").isin("src1", "src2")).distinct())


# ---- symbols and graphs ----------------------------------------------------------------------

_SYMBOLS = """files AS (SELECT s_suppkey AS file_id, 'c' || (s_nationkey % 2) AS collection, 'src/n' || s_nationkey || '/' || s_name || '.py' AS file_path FROM supplier),
refs AS (SELECT file_path, 'sym' || (l_partkey % 97) AS name, CASE l_linenumber WHEN 1 THEN 'call' WHEN 2 THEN 'member' WHEN 3 THEN 'type' WHEN 4 THEN 'import' ELSE 'ident' END AS kind,
  'fn' || (l_orderkey % 53) AS container_name, l_orderkey AS line FROM lineitem JOIN files ON l_suppkey = file_id WHERE collection = 'c0'),
edges AS (SELECT file_path, 'fn' || (l_orderkey % 53) AS from_name, 'sym' || (l_partkey % 97) AS to_name, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'inherits' ELSE 'implements' END AS relation,
  l_orderkey AS line FROM lineitem JOIN files ON l_suppkey = file_id WHERE collection = 'c0')"""


def _symbols(spark, sf_dir):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    files = s.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("c"), (F.col("s_nationkey") % 2).cast("string")).alias("collection"), F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".py")).alias("file_path"))
    kind = F.expr("CASE l_linenumber WHEN 1 THEN 'call' WHEN 2 THEN 'member' WHEN 3 THEN 'type' WHEN 4 THEN 'import' ELSE 'ident' END")
    relation = F.expr("CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'inherits' ELSE 'implements' END")
    sym, at = F.concat(F.lit("sym"), (F.col("l_partkey") % 97).cast("string")), F.concat(F.lit("fn"), (F.col("l_orderkey") % 53).cast("string"))
    rows = li.select(F.col("l_suppkey").alias("file_id"), sym.alias("s"), at.alias("c"), F.col("l_orderkey").alias("line"), kind.alias("kind"), relation.alias("relation"))
    found = symbols.with_files(rows, files, "c0")
    refs = found.select("file_path", F.col("s").alias("name"), "kind", F.col("c").alias("container_name"), "line")
    return refs, found.select("file_path", F.col("c").alias("from_name"), F.col("s").alias("to_name"), "relation", "line")


_USAGE = "CASE kind WHEN 'call' THEN 0 WHEN 'member' THEN 1 WHEN 'type' THEN 2 WHEN 'import' THEN 3 ELSE 4 END"


@query(f"WITH {_SYMBOLS} SELECT file_path, kind, container_name, line FROM refs WHERE name = 'sym7' ORDER BY {_USAGE}, file_path, line, container_name LIMIT 200")
def usages_ranked(spark, sf_dir):
    return symbols.usages(_symbols(spark, sf_dir)[0], "sym7", 200).drop("name")


@query(f"WITH {_SYMBOLS} SELECT file_path, container_name, line FROM refs WHERE name = 'sym7' AND kind = 'call' ORDER BY file_path, line, container_name LIMIT 100")
def callers(spark, sf_dir):
    return symbols.usages(_symbols(spark, sf_dir)[0], "sym7", 100, ["call"]).select("file_path", "container_name", "line")


@query(f"WITH {_SYMBOLS} SELECT DISTINCT to_name FROM edges WHERE relation = 'calls' AND from_name = 'fn3' ORDER BY to_name LIMIT 1000")
def callees(spark, sf_dir):
    return symbols.callees(_symbols(spark, sf_dir)[1], "fn3")


@query(f"WITH {_SYMBOLS} SELECT * FROM edges WHERE relation IN ('inherits', 'implements') AND to_name = 'sym7'")
def implementations(spark, sf_dir):
    return symbols.implementations(_symbols(spark, sf_dir)[1], "sym7")


@query(f"WITH {_SYMBOLS} SELECT * FROM edges WHERE relation IN ('inherits', 'implements') AND from_name = 'fn3'")
def supertypes(spark, sf_dir):
    return symbols.supertypes(_symbols(spark, sf_dir)[1], "fn3")


_RELATED = f"""{_SYMBOLS}, u AS (
SELECT file_path, CASE WHEN relation = 'calls' THEN 'reference' ELSE 'implementor' END AS relation, from_name AS label, line, CASE WHEN relation = 'calls' THEN 2 ELSE 0 END AS rank FROM edges WHERE to_name = 'sym7'
UNION ALL SELECT file_path, CASE WHEN kind IN ('call', 'member') THEN 'usage' ELSE 'reference' END, container_name, line, CASE WHEN kind IN ('call', 'member') THEN 1 ELSE 2 END FROM refs WHERE name = 'sym7'),
rel AS (SELECT file_path, relation, label, line, rank FROM u QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY rank, line, relation, label) = 1)"""


@query(f"WITH {_RELATED} SELECT * FROM rel")
def related_files(spark, sf_dir):
    refs, edges = _symbols(spark, sf_dir)
    return symbols.related_files(edges, refs, "sym7")


@query(f"WITH {_RELATED} SELECT *, row_number() OVER (PARTITION BY relation ORDER BY rank, file_path) AS place FROM rel QUALIFY place <= 12")
def related_capped(spark, sf_dir):
    refs, edges = _symbols(spark, sf_dir)
    return symbols.cap_per_relation(symbols.related_files(edges, refs, "sym7"))


@query("""SELECT 'sym' || (p_partkey % 97) AS name, p_partkey AS start_line, p_brand AS file_path, CASE WHEN p_size % 3 = 0 THEN 'impl' WHEN p_size % 3 = 1 THEN 'property' ELSE 'class' END AS kind FROM part
WHERE p_partkey % 97 IN (5, 6) ORDER BY CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END, p_brand, p_partkey LIMIT 30""")
def resolve_symbol(spark, sf_dir):
    defs = table(spark, sf_dir, "part").select(F.concat(F.lit("sym"), (F.col("p_partkey") % 97).cast("string")).alias("name"), F.col("p_partkey").alias("start_line"), F.col("p_brand").alias("file_path"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'impl' WHEN p_size % 3 = 1 THEN 'property' ELSE 'class' END").alias("kind"))
    return symbols.resolve(defs, ["sym5", "sym6"], 30)


_EDGES = """e AS (SELECT 'n' || s_nationkey AS a, 's' || s_suppkey AS b FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


def _graph(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = s.select(tag("n", "s_nationkey").alias("from_node"), tag("s", "s_suppkey").alias("to_node"), F.when(F.col("s_suppkey") % 3 == 0, "imports").otherwise("calls").alias("relation"))
    return a.unionByName(n.select(tag("r", "n_regionkey").alias("from_node"), tag("n", "n_nationkey").alias("to_node"), F.lit("inherits").alias("relation")))


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT 'n1' AS node, 0 AS hop UNION SELECT b.b, hop + 1 FROM t JOIN b ON t.node = b.a WHERE hop < 3)
SELECT node, min(hop) AS hop FROM t WHERE node <> 'n1' GROUP BY node""")
def graph_traverse(spark, sf_dir):
    return symbols.traverse(_graph(spark, sf_dir), spark.range(1).select(F.lit("n1").alias("node")), 3)


@query("""WITH a(anchor, module) AS (VALUES ('brass', 'PROMO'), ('steel', 'ECONOMY')), t AS (SELECT DISTINCT p_type || '/' || p_name AS f FROM part)
SELECT f AS file_path, CAST(sum(CASE WHEN contains(lower(regexp_extract(f, '[^/]*$')), anchor) THEN 5 WHEN contains(lower(f), anchor) THEN 2 ELSE 0 END + CASE WHEN starts_with(f, module) THEN 1 ELSE 0 END) AS BIGINT) AS score
FROM t, a GROUP BY f HAVING score > 0""")
def related_tests(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), "p_name").alias("file_path")).distinct()
    return symbols.related_tests(tests, spark.createDataFrame([("brass", "PROMO"), ("steel", "ECONOMY")], "anchor string, module string"))


@query(f"WITH {_RELATED} SELECT DISTINCT file_path FROM (SELECT file_path FROM rel UNION ALL SELECT file_path FROM refs WHERE name = 'sym8' AND kind = 'call')")
def impact_files(spark, sf_dir):
    refs, edges = _symbols(spark, sf_dir)
    return symbols.affected_files(symbols.related_files(edges, refs, "sym7"), refs.where("name = 'sym8' AND kind = 'call'"))


@query(f"""WITH {_SYMBOLS}, changed AS (SELECT DISTINCT file_path FROM files WHERE file_id % 9 = 0)
SELECT regexp_extract(file_path, '^(src/[^/]*)', 1) AS module, count(*) AS n_files FROM (SELECT DISTINCT file_path FROM refs) WHERE file_path IN (FROM changed) GROUP BY 1""")
def affected(spark, sf_dir):
    refs, _ = _symbols(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".py")).alias("file_path"))
    return symbols.modules_for(refs.select("file_path").distinct().join(s, "file_path", "left_semi"), "file_path")


@query(f"""WITH {_SYMBOLS}, u AS (SELECT row_number() OVER (ORDER BY line, file_path, kind, container_name) AS pos, file_path FROM refs WHERE name = 'sym7')
SELECT pos, file_path FROM u WHERE regexp_extract(file_path, '^(.*)/[^/]*$', 1) IN ('src/n2', 'src/n4') OR pos <= 10 OR contains(lower(regexp_extract(file_path, '([^/]*)[.]py$', 1)), '00003') ORDER BY pos LIMIT 15""")
def usage_trim(spark, sf_dir):
    refs, _ = _symbols(spark, sf_dir)
    order = Window.orderBy("line", "file_path", "kind", "container_name")  # the usages of one symbol
    u = refs.where("name = 'sym7'").select(F.row_number().over(order).cast("long").alias("pos"), "file_path")
    return retrieval.usage_trim(u, spark.createDataFrame([("src/n2",), ("src/n4",)], "dir string"), ["00003"])


# ---- packing ---------------------------------------------------------------------------------


_PACKED = """WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, text, ls, list_position(list_transform(ls, lambda x: x <> ''), true) AS a FROM l),
x AS (SELECT doc_id, i, ls[i] AS line, sum(strlen(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM f, unnest(range(a, len(ls) + 1)) AS r(i)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM x WHERE upto <= 400 GROUP BY doc_id),
c AS (SELECT doc_id, ls[a] AS line, list_max(list_filter(range(1, 401), lambda n: strlen(ls[a][1:n]) <= 400)) AS n FROM f WHERE strlen(ls[a]) > 400)
SELECT doc_id, kept, greatest(1, CAST(ceil(strlen(kept) / 4.0) AS BIGINT)) AS tokens FROM (
  SELECT f.doc_id, CASE WHEN strlen(text) <= 400 THEN text
    WHEN c.doc_id IS NOT NULL THEN regexp_replace(c.line[1:c.n] || CASE WHEN strlen(c.line[1:c.n]) < 400 THEN chr(65533) ELSE '' END, '\\s+$', '') ELSE regexp_replace(coalesce(kept, ''), '\\s+$', '') END AS kept
  FROM f LEFT JOIN k ON k.doc_id = f.doc_id LEFT JOIN c ON c.doc_id = f.doc_id)"""


@query(_PACKED)
def token_budget(spark, sf_dir):
    return retrieval.line_budget(table(spark, sf_dir, "documents"), "doc_id", "text", 100)


@query(_PACKED)
def token_budget_all(spark, sf_dir):
    """The same: the name of the query that had no SQL when the one above left out some first lines."""
    return token_budget(spark, sf_dir)


@query("""WITH s AS (SELECT doc_id, round(0.1 + (doc_id * 37 % 100) / 200.0, 4) AS score, greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS tokens, source FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s ORDER BY place LIMIT 50), b AS (SELECT *, sum(tokens) OVER (ORDER BY place) AS spent FROM r)
SELECT doc_id, score, tokens, place, CAST(spent AS BIGINT) AS spent FROM b WHERE spent <= 20000""")
def context_pack(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.round(0.1 + (F.col("doc_id") * 37 % 100) / 200.0, 4).alias("score"), fn.estimate_tokens(F.col("text")).alias("tokens"))
    top = s.orderBy(F.desc("score"), "doc_id").limit(50)
    order = Window.orderBy(F.desc("score"), "doc_id")  # fifty rows
    return top.withColumn("place", F.row_number().over(order).cast("long")).withColumn("spent", F.sum("tokens").over(order)).where("spent <= 20000")


@query("""SELECT lang, max(doc_id % 30) / 100.0 >= 0.22 AS grounded, round(max(doc_id % 30) / 100.0, 4) AS best FROM documents GROUP BY lang""")
def ask_gate(spark, sf_dir):
    best = F.max(F.col("doc_id") % 30) / 100.0
    return table(spark, sf_dir, "documents").groupBy("lang").agg((best >= 0.22).alias("grounded"), F.round(best, 4).alias("best"))


@query("""WITH a AS (SELECT doc_id, n_chars AS x, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT min(x) FILTER (i = ceil(0.95 * n) - 1) AS p95_a, count(*) AS n FROM a""")
def shadow_compare(spark, sf_dir):
    return stats.at_ranks(table(spark, sf_dir, "documents"), "n_chars", {"p95_a": lambda n: F.ceil(0.95 * n) - 1}).select("p95_a", "n")


@query("""WITH RECURSIVE st AS (
  SELECT user_id, min(ts) AS s FROM events WHERE user_id IS NOT NULL GROUP BY user_id
  UNION ALL
  SELECT st.user_id, min(e.ts) FROM st JOIN events e ON e.user_id = st.user_id AND e.ts >= st.s + INTERVAL 60 SECOND GROUP BY st.user_id),
w AS (SELECT e.user_id, e.ts, e.event_id, max(s) AS s FROM events e JOIN st ON st.user_id = e.user_id AND st.s <= e.ts GROUP BY ALL)
SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS accepted FROM w""")
def rate_limit_windows(spark, sf_dir):
    return streams.rate_limit(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", limit=3)


# ---- code ------------------------------------------------------------------------------------

_PY = """import os
from abc import ABC

class Base(ABC):
    \"\"\"Base.\"\"\"
    def hello(self, name: str) -> str:
        if name and os.path:
            return greet(name)
        return ""

class OrderRepository(Base):
    async def load(self, key):
        for x in range(3):
            if x or key:
                await self.fetch(x)

def greet(name):
    return name
"""
_KT = """@Module
data class PaymentService @Inject constructor(val repo: OrderRepository) : BaseService(repo), Closeable {
    suspend fun pay(): Flow<Int> { TODO() }
}
"""


def _sources(spark):
    return spark.createDataFrame([("a.py", "python", _PY), ("bad.py", "python", "def ("), ("P.kt", "kotlin", _KT)], "file_path string, language string, content string")


@query()
def python_symbols(spark, sf_dir):
    return extract.extract_python(_sources(spark).where("language = 'python'"))


@query()
def python_enrich(spark, sf_dir):
    return extract.enrich_python(_sources(spark).where("language = 'python'"))


# sources made of parts' names: a template by the part's number, the name's first two words as type names
_JVM_SOURCE = """CASE p_partkey % 10
WHEN 0 THEN '/* interface of ' || p_name || ' */' || nl || 'suspend fun run(): Flow<' || a || '> = flow { emit(1) } // @Inject'
WHEN 1 THEN '@Module' || nl || 'class M { @Provides' || nl || 'fun make(x: Int): ' || a || ' = TODO() }'
WHEN 2 THEN 'data class ' || a || ' @Inject constructor(val p: ' || b || ', val q: List) : Base<' || b || '>(1), ' || b || ' {'
WHEN 3 THEN 'object ' || a || ' { @Inject lateinit var z: ' || b || ' }'
WHEN 4 THEN '@Singleton public class ' || a || ' extends Base<' || b || '> implements ' || b || ', Closeable { private static X getInstance() { return submit(1); } }'
WHEN 5 THEN '/* ' || p_name || nl || ' */ public enum ' || a || ' { X } // @Test'
WHEN 6 THEN 'public interface ' || a || ' { @Provides public ' || b || ' make(); }'
WHEN 7 THEN 'sealed interface ' || a || ' : ' || b || ' {' || nl || '@Composable fun f() {}'
WHEN 8 THEN 'abstract class ' || a || ' { @Test void t() { f.thenApply(g); } }'
ELSE '/* open ' || p_name || ' @Provides' END"""
_JVM_LANGUAGE = "CASE WHEN p_partkey % 10 IN (4, 5, 6, 8) THEN 'java' WHEN p_partkey % 30 = 9 THEN 'go' ELSE 'kotlin' END"


@query(f"""WITH n AS (SELECT p_partkey, p_name, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS b, chr(10) AS nl FROM part),
s AS (SELECT p_partkey, {_JVM_LANGUAGE} AS language, {_JVM_SOURCE} AS content, p_partkey % 10 AS k, a, b FROM n),
c AS (SELECT *, language = 'kotlin' AS kt, language = 'java' AS ja, regexp_replace(regexp_replace(regexp_replace(content, '/\\*[^\\n*]*\\*/', '', 'g'), '/\\*[^*]*(\\*/|$)', chr(10), 'g'), '//[^\\n]*', '', 'g') AS t FROM s)
SELECT CAST(p_partkey AS VARCHAR) AS file_path, language, (kt OR ja) AND contains(t, '@Provides') AS is_di_provider, (kt OR ja) AND contains(t, '@Inject') AS is_di_consumer,
kt AND (contains(t, 'suspend fun ') OR starts_with(ltrim(t, ' ' || chr(10)), 'suspend ')) AS is_suspend, kt AND (contains(t, 'flow {{') OR contains(t, 'launch')) AS uses_coroutines, kt AND contains(t, 'Flow<') AS uses_flow,
ja AND (contains(t, 'submit(') OR contains(t, 'thenApply')) AS uses_async_java, kt AND k = 3 OR (kt OR ja) AND contains(t, '@Singleton') AS is_singleton, kt AND contains(t, 'sealed interface ') AS is_sealed,
kt AND contains(t, 'data class ') AS is_data_class, contains(t, 'abstract class ') AS is_abstract, ja AND contains(t, 'public interface ') AS is_interface,
ja AND starts_with(ltrim(t, ' ' || chr(10)), 'public enum ') AS is_enum, kt AND contains(t, '@Composable') AS is_composable, kt AND contains(t, '@Module') AS is_di_component, ja AND contains(t, '@Test') AS has_unit_test,
kt AND k = 3 AS is_kotlin_object, ja AND contains(t, 'getInstance(') AND contains(t, 'private ') AND contains(t, 'static ') AS is_singleton_pattern,
CASE k WHEN 1 THEN a WHEN 6 THEN b ELSE '' END AS provides, CASE k WHEN 2 THEN array_to_string(list_sort(list_distinct([b, 'List'])), ',') WHEN 3 THEN b ELSE '' END AS injects,
CASE k WHEN 4 THEN 'Base,' || b || ',Closeable' WHEN 7 THEN b ELSE '' END AS inherits_from FROM c""")
def jvm_flags(spark, sf_dir):
    word = lambda i: F.expr(f"concat(upper(left(split(p_name, ' ')[{i}], 1)), substr(split(p_name, ' ')[{i}], 2))")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", word(0).alias("a"), word(1).alias("b"), F.lit("\n").alias("nl"))
    files = parts.selectExpr("CAST(p_partkey AS STRING) AS file_path", f"{_JVM_LANGUAGE} AS language", f"{_JVM_SOURCE} AS content")
    return jvm.jvm_flags(files).withColumns({c: F.array_join(c, ",") for c in ("provides", "injects", "inherits_from")})


@query()
def plan_batch(spark, sf_dir):
    asked = ("find python factory classes", "what calls login", "architecture overview", "auth and payment", "exact db error")
    plans = [(q, p.strategy, p.queries, {k: str(v) for k, v in p.filters.items()}, p.top_k) for q in asked for p in [planner.fallback_plan(q)]]
    return spark.createDataFrame(plans, "question string, strategy string, queries array<string>, filters map<string, string>, top_k int")


@query()
def full_search(spark, sf_dir):
    """Plan, lexical ranking, sanity filter, scoring and slim projection in one plan."""
    question = "Find The onnt"
    plan = planner.fallback_plan(question)
    terms = planner.query_terms(plan.queries[0])
    c = _chunks(spark, sf_dir)
    cols = [F.col(x) for x in ("file_path", "name", "parent_name", "code")]
    hits = retrieval.lexical_topk(c.where(retrieval.candidates(terms, *cols)), fn.score_ranked(*cols, F.col("chunk_type"), terms), 200, ["doc_id"])
    hits = retrieval.sanity_filter(hits.withColumn("score", fn.squash_lexical(F.col("raw"))), planner.sanity_symbols(question), "code", ["name", "file_path"])
    return hits.orderBy(F.desc("score"), "doc_id").limit(plan.top_k).select("doc_id", fn.citation(F.col("file_path"), F.lit(1), F.lit(1), F.col("name"), F.col("parent_name")).alias("citation"), F.round("score", 4).alias("score"))
