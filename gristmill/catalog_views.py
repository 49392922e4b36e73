"""More queries over the driver's tables, with SQL: service state, evidence, composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.catalog import _SYMBOLS, _symbols, query, table
from gristmill.functions import text as fn
from gristmill.operators import evidence, retrieval, service

_NAME = "regexp_extract(text, '^[0-9A-Za-z_]+', 0)"


def _documents(spark, sf_dir):
    """Documents as chunks: source as path, first word as name."""
    name = F.regexp_extract("text", "^[0-9A-Za-z_]+", 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("lang").alias("language"), name.alias("name"), "text", "n_chars")


# ---- service state ---------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 50 = 0 OR vec_id = 7")
def points_by_ids(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ids = points.where("vec_id % 50 = 0").select("vec_id").union(spark.sql("SELECT 7L UNION ALL SELECT -5L"))
    return service.by_ids(points, ids, "vec_id")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 100")
def filtered_count(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(retrieval.payload_filter({"c_mktsegment": "BUILDING", "c_acctbal": 100})).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(c_custkey) AS n FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT 'none', -1) LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def collection_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return service.counts_of(nation.select("n_name").union(spark.sql("SELECT 'none'")), rows, "n_name")


@query("SELECT event_id, ts FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 256")
def scroll_page(spark, sf_dir):
    return service.next_page(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", 500)


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY source, n_chars, doc_id LIMIT 100")
def ordered_scan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")
    return d.orderBy("source", "n_chars", "doc_id").limit(100)


_FILES = "f AS (SELECT s_suppkey AS file_id, 'c' || (s_nationkey % 2) AS collection FROM supplier), r AS (SELECT l_suppkey AS file_id, l_linenumber, l_returnflag, l_orderkey FROM lineitem)"


def _star(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS file_id", "concat('c', CAST(s_nationkey % 2 AS STRING)) AS collection")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS file_id", "l_linenumber", "l_returnflag", "l_orderkey")
    return files, rows


@query(f"""WITH {_FILES}, j AS (SELECT * FROM r JOIN f USING (file_id)) SELECT collection, (SELECT count(*) FROM f WHERE f.collection = j.collection) AS files,
count(*) FILTER (l_linenumber = 1) AS defs, count(*) AS refs, count(*) FILTER (l_returnflag = 'A') AS edges FROM j GROUP BY collection""")
def symbol_stats(spark, sf_dir):
    files, rows = _star(spark, sf_dir)
    found = rows.join(files, "file_id")
    return service.symbol_stats({"files": files, "defs": found.where("l_linenumber = 1"), "refs": found, "edges": found.where("l_returnflag = 'A'")}).select(
        "collection", *(F.col(c).cast("long").alias(c) for c in ("files", "defs", "refs", "edges"))
    )


@query(f"WITH {_FILES} SELECT r.* FROM r JOIN f USING (file_id) WHERE collection = 'c1'")
def delete_of_files(spark, sf_dir):
    files, rows = _star(spark, sf_dir)
    return service.delete_of_files(rows, files, F.col("collection") == "c0")


@query("""SELECT CAST(i.user_id AS VARCHAR) AS path FROM (SELECT user_id, min(epoch(ts)) AS t FROM events GROUP BY 1) i JOIN (SELECT user_id, max(epoch(ts)) AS t FROM events WHERE event_type = 'click' GROUP BY 1) d
ON i.user_id = d.user_id WHERE d.t > i.t + 2""")
def stale_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "event_type")
    seconds = F.col("t") / 1e6
    indexed = e.groupBy("path").agg(F.min(seconds).alias("indexed_at"))
    return service.stale(indexed, e.where("event_type = 'click'").groupBy("path").agg(F.max(seconds).alias("mtime")))


@query(f"SELECT w.name, w.name IN (SELECT {_NAME} FROM documents) AS found FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT 'The' UNION SELECT 'Is') w")
def names_exist(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).union(spark.sql("SELECT 'The' UNION ALL SELECT 'Is'")).distinct()
    return service.named(_documents(spark, sf_dir), wanted)


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '[\\s.]+'), lambda w: w IN ('day', 'days', 'week', 'weeks', 'month', 'months', 'year', 'years', 'hour', 'hours', 'ago', 'yesterday'))) > 0 AS since FROM conversations WHERE text IS NOT NULL")
def date_references(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", service.is_since(F.col("text")).alias("since"))


@query("""WITH d AS (SELECT CASE doc_id % 4 WHEN 0 THEN source || '/test/a.py' WHEN 1 THEN source || '/AccountTest.kt' ELSE source || '/latest.py' END AS file_path, lang FROM documents)
SELECT file_path, max(lang) AS language, count(*) AS n_chunks FROM d WHERE file_path ILIKE '%/test/%' OR file_path ILIKE '%/tests/%' OR file_path ILIKE '%Test.%' GROUP BY 1""")
def test_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.expr("CASE doc_id % 4 WHEN 0 THEN '/test/a.py' WHEN 1 THEN '/AccountTest.kt' ELSE '/latest.py' END"))
    return d.select(path.alias("file_path"), "lang").where(service.test_path(F.col("file_path"))).groupBy("file_path").agg(F.max("lang").alias("language"), F.count("*").alias("n_chunks"))


_GRAPH_FILES = f"""WITH d AS (SELECT source AS file_path, doc_id, {_NAME} AS name FROM documents),
k AS (SELECT * FROM d WHERE contains(lower(file_path), 'src1') OR contains(lower(coalesce(name, '')), 'src1')),
o AS (SELECT file_path, name, min(doc_id) AS pos FROM k WHERE name <> '' GROUP BY 1, 2)
SELECT k.file_path, count(*) AS n_chunks, coalesce((SELECT string_agg(name, ',' ORDER BY pos) FROM o WHERE o.file_path = k.file_path), '') AS names FROM k GROUP BY k.file_path"""


@query(_GRAPH_FILES)
def graph_files(spark, sf_dir):
    found = service.graph_files(_documents(spark, sf_dir), "src1", ("doc_id",))
    return found.withColumn("names", F.array_join("names", ","))


@query("""WITH l AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS error FROM events ORDER BY event_id DESC LIMIT 200),
e AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS n FROM l WHERE event_type = 'error')
SELECT coalesce((SELECT arg_min(error, n) FROM e WHERE error <> '' AND n <= 6), (SELECT arg_min(event_type, n) FROM e)) AS error""")
def last_error(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS level", "event_type AS message", "CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS error")
    return service.last_error(e)


@query("""SELECT s_name AS service, CASE WHEN s_suppkey % 17 = 3 THEN 'down' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'model name holds a slash' END AS hint,
CASE WHEN (SELECT count(*) FROM supplier WHERE s_suppkey % 17 = 3) > 0 THEN 'degraded' ELSE 'ok' END AS overall FROM supplier WHERE s_suppkey < 20""")
def diagnose(spark, sf_dir):
    cards = table(spark, sf_dir, "supplier").where("s_suppkey < 20")
    return service.diagnose(cards.selectExpr("s_name AS service", "CASE WHEN s_suppkey % 17 = 3 THEN 'down' ELSE 'ok' END AS status", "CASE WHEN s_suppkey % 2 = 0 THEN 'a/b' ELSE 'ab' END AS detail"))


# ---- evidence --------------------------------------------------------------------------------


@query("""SELECT 'ast:' || p_type || '/' || p_brand || '.kt:' || l || ':' || label AS chunk_id, p_type || '/' || p_brand || '.kt' AS file_path, name, '' AS parent_name, 'class' AS chunk_type, 'kt' AS language, l AS start_line,
CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_size END AS end_line, l || '-' || CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_size END AS lines, p_retailprice AS score,
p_type || '/' || p_brand || '.kt:' || l || '-' || CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE p_size END || ' (' || label || ')' AS citation, 'ast_index_symbol' AS why_included
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_size END AS l, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS name,
  CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN 'fun x' WHEN p_partkey % 4 = 2 THEN 'in y' ELSE p_brand || '.kt' END AS label FROM part WHERE p_size > 0)""")
def context_candidates(spark, sf_dir):
    hits = table(spark, sf_dir, "part").where("p_size > 0").selectExpr(
        "concat(p_type, '/', p_brand, '.kt') AS file_path", "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS name", "CASE WHEN p_partkey % 4 = 1 THEN 'fun x' ELSE '' END AS signature",
        "CASE WHEN p_partkey % 4 = 2 THEN 'in y' ELSE '' END AS context", "'class' AS kind", "p_partkey AS line", "CASE WHEN p_size % 2 = 0 THEN 0L ELSE CAST(p_size AS BIGINT) END AS start_line",
        "CASE WHEN p_size % 3 = 0 THEN 0L ELSE CAST(p_size AS BIGINT) END AS end_line", "p_retailprice AS score", "'symbol' AS source",
    )
    return evidence.candidates(hits)


@query("SELECT p_name AS name, p_type AS file_path, CAST(p_size AS BIGINT) AS token_estimate, '' AS chunk_type, p_retailprice AS score FROM part")
def compact_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_name AS name", "p_type AS file_path", "CAST(p_size AS BIGINT) AS token_estimate", "p_retailprice AS score", "p_brand AS other")
    return evidence.compact_slices(rows)


@query("SELECT event_id, event_type FROM events")
def stable_fields(spark, sf_dir):
    return evidence.without_volatile(table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "ts", "value AS latency_ms"))


_NO_SYMBOLS = ", ".join(f"'{w}'" for w in evidence.NO_SYMBOLS)
_CODE_WORDS = f"list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: regexp_matches(w, '[A-Z_]') AND lower(w) NOT IN ({_NO_SYMBOLS}))"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({_CODE_WORDS}) AS w, generate_subscripts({_CODE_WORDS}, 1) AS i FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, w, min(i) AS i FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM f)
SELECT c.conv_id, c.turn, coalesce(string_agg(w, ',' ORDER BY n) FILTER (n <= 12), '') AS symbols FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn WHERE text IS NOT NULL GROUP BY ALL""")
def symbol_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", F.array_join(evidence.symbol_candidates(F.col("text")), ",").alias("symbols"))


_ARCHITECTURE = ", ".join(f"'{w}'" for w in (*evidence.ARCHITECTURE_WORDS, "the"))


@query(f"SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_]+'), [{_ARCHITECTURE}])) > 0 AS is_task FROM documents WHERE text IS NOT NULL")
def task_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", evidence.has_word(F.col("text"), (*evidence.ARCHITECTURE_WORDS, "the")).alias("is_task"))


@query("""SELECT source, count(*) < 40 OR NOT bool_or(doc_id % 90 = 0) AS semantic FROM documents GROUP BY source""")
def semantic_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 90 == 0, "ast_index_symbol").otherwise("semantic_match").alias("why_included"))
    return evidence.needs_semantic(d, ["source"], 40)


@query("""WITH s AS (SELECT doc_id, source || '/tests/case' || (doc_id % 5) || '.py' AS file_path, '1-' || (n_chars % 3) AS lines, lang AS name FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path, lines, name ORDER BY doc_id) AS n FROM s) SELECT doc_id, file_path, lines, name FROM o WHERE n = 1 ORDER BY doc_id LIMIT 25""")
def collect_tests(spark, sf_dir):
    s = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(source, '/tests/case', CAST(doc_id % 5 AS STRING), '.py') AS file_path", "concat('1-', CAST(n_chars % 3 AS STRING)) AS lines", "lang AS name")
    return evidence.collect_tests(s, fn.is_test_path(F.col("file_path")), ["doc_id"], 25)


@query("""SELECT conv_id, turn, concat_ws(' | ', CASE WHEN turn % 2 = 0 THEN 'Semantic fallback was used; verify embedding-only hits before editing.' END,
CASE WHEN turn % 3 = 1 THEN 'Same-name symbols need caller/path disambiguation: a, b, c.' END,
CASE WHEN (contains(lower(text), 'analytics') OR contains(lower(text), 'event')) AND conv_id % 2 = 0 THEN 'No test slice was retrieved; locate analytics tests before editing.' END,
CASE WHEN contains(lower(text), 'module') OR contains(lower(text), 'dependency') OR contains(lower(text), 'extract') OR contains(lower(text), 'move') THEN 'Module-boundary task; verify Gradle dependencies and DI providers before editing.' END) AS risks
FROM (SELECT conv_id, turn, text || CASE WHEN conv_id % 4 = 0 THEN ' Event' WHEN conv_id % 4 = 1 THEN ' extract' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL)""")
def task_risks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").selectExpr("conv_id", "turn", "concat(text, CASE WHEN conv_id % 4 = 0 THEN ' Event' WHEN conv_id % 4 = 1 THEN ' extract' ELSE '' END) AS text")
    ambiguous = F.when(F.col("turn") % 3 == 1, F.array(*map(F.lit, "abcd"))).otherwise(F.array().cast("array<string>"))
    found = evidence.risks(F.col("text"), F.col("turn") % 2 == 0, ambiguous, F.col("conv_id") % 2)
    return c.select("conv_id", "turn", F.array_join(found, " | ").alias("risks"))


@query("""WITH s AS (SELECT lang, source AS file_path, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id % 7 = 0 AS sem, n_chars FROM documents)
SELECT lang, coalesce(min(rank) FILTER (file_path = CASE lang WHEN 'en' THEN 'src5' WHEN 'fr' THEN 'none' ELSE 'src9' END), 1) AS first_relevant_rank, bool_or(sem) AS embeddings_used, CAST(sum(n_chars) AS BIGINT) AS source_tokens FROM s GROUP BY lang""")
def eval_metrics(spark, sf_dir):
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    s = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("file_path"), F.row_number().over(order).cast("long").alias("rank"), F.when(F.col("doc_id") % 7 == 0, "semantic_match").otherwise("x").alias("why_included"), F.col("n_chars").alias("token_estimate"))
    first = s.select("lang").distinct().withColumn("file_path", F.expr("CASE lang WHEN 'en' THEN 'src5' WHEN 'fr' THEN 'none' ELSE 'src9' END"))
    return evidence.eval_metrics(s, first, "lang")


@query("SELECT CAST(sum(greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT))) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def source_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").agg(F.sum(fn.estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"""WITH d AS (SELECT lang, source, doc_id, {_NAME} AS name, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL QUALIFY n <= 8)
SELECT lang, string_agg('[' || n || '] ' || source || ':1-9 (' || coalesce(nullif(name, ''), 'p') || ')' || chr(10) || '```' || chr(10) || substr(text, 1, 1200) || chr(10) || '```', chr(10) || chr(10) ORDER BY n) AS context FROM d GROUP BY lang""")
def ask_context(spark, sf_dir):
    d = _documents(spark, sf_dir).where("text IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n_chars"), "doc_id"))).where("n <= 8")
    hits = d.select(F.col("language").alias("lang"), "n_chars", "doc_id", "file_path", F.lit("1").alias("start_line"), F.lit("9").alias("end_line"), "name", F.lit("p").alias("parent_name"), F.col("text").alias("code"))
    return evidence.ask_context(hits, ["lang"], [F.desc("n_chars"), "doc_id"])


@query("""SELECT event_id, 'n' || user_id AS name, 'src/' || event_type || '.kt' AS file_path, event_id AS at, event_id % 15 AS depth, CAST(greatest(0, 10 - event_id % 15) AS DOUBLE) AS score FROM events WHERE event_id % 6 <> 5""")
def call_tree_text(spark, sf_dir):
    line = "concat(repeat('  ', CAST(event_id % 15 AS INT)), 'n', CAST(user_id AS STRING), CASE WHEN event_id % 6 = 5 THEN ' - ' ELSE ' (' END, 'src/', event_type, '.kt:', CAST(event_id AS STRING), ')') AS line"
    return evidence.parse_call_tree(table(spark, sf_dir, "events").selectExpr("event_id", line)).drop("line")


@query("""SELECT event_id, 'f' || user_id AS file_path, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 1 END AS line, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS name, CASE WHEN event_id % 2 = 0 THEN 'class' ELSE 'search' END AS kind,
'' AS signature, '' AS context, '' AS code, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 1 END AS start_line, CASE WHEN event_id % 2 = 0 THEN event_id + 2 ELSE 1 END AS end_line, 0.0::DOUBLE AS score, 'search' AS source FROM events""")
def json_hits(spark, sf_dir):
    even = """concat('[{"file_path":"f', CAST(user_id AS STRING), '","start_line":', CAST(event_id AS STRING), ',"type":"class","end_line":', CAST(event_id + 2 AS STRING), '},{"name":"lost"}]')"""
    odd = """concat('[{"path":"f', CAST(user_id AS STRING), '","name":"', event_type, '"}]')"""
    return evidence.parse_json_hits(table(spark, sf_dir, "events").selectExpr("event_id", f"CASE WHEN event_id % 2 = 0 THEN {even} ELSE {odd} END AS body"), "body", "search")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN '#' ELSE '//' END || ' File: ' || source || chr(10) || CASE WHEN doc_id % 2 = 0 THEN CASE WHEN lang = 'en' THEN '#' ELSE '//' END || ' Class: K' || chr(10) ELSE '' END
|| CASE WHEN lang = 'en' THEN '#' ELSE '//' END || ' Language: ' || CASE WHEN lang = 'en' THEN 'python' ELSE lang END AS header FROM documents WHERE lang IS NOT NULL""")
def context_headers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.select("doc_id", evidence.context_header(F.col("source"), F.when(F.col("lang") == "en", "python").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, "K").otherwise("")).alias("header"))


@query("""WITH stems AS (SELECT lower(n) AS s FROM (SELECT 'unit_test_' || split_part(p_name, ' ', 2) || '_case' AS n FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT split_part(p_name, ' ', 1) || '_test' FROM part WHERE p_partkey % 7 = 0))
SELECT p_partkey, w AS name, w <> '' AND EXISTS (SELECT 1 FROM stems WHERE contains(s, 'test_' || lower(w)) OR contains(s, lower(w) || '_test')) AS has_unit_test FROM (SELECT p_partkey, split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT)) AS w FROM part)""")
def unit_tests_of(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    stems = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("unit_test_"), word(2), F.lit("_case")).alias("stem")).union(p.where("p_partkey % 7 = 0").select(F.concat(word(1), F.lit("_test"))))
    names = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, word(1)).otherwise(word(2)).alias("name"))
    return evidence.has_unit_test(names, stems)


@query(f"WITH {_SYMBOLS} SELECT DISTINCT from_name AS from_node, to_name AS to_node, CASE relation WHEN 'implements' THEN 'inherits' ELSE relation END AS relation FROM edges")
def ast_graph(spark, sf_dir):
    _, edges = _symbols(spark, sf_dir)
    defs = spark.createDataFrame([], "qualified string, file_path string, name string, parent_name string, kind string, start_line long")
    return evidence.ast_graph(defs, edges)[1]


@query("""SELECT 'r:vocab:' || f AS id, f AS file_path, regexp_extract(f, '([^/]*)[.]kt$', 1) AS name, 'kt' AS language, text AS summary, sha256(f || ':' || text) AS content_hash
FROM (SELECT 'a/c' || conv_id || '.' || turn || '.kt' AS f, text FROM conversations WHERE text IS NOT NULL)""")
def vocab_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return evidence.vocab_records(c.select(F.concat(F.lit("a/c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(".kt")).alias("file"), F.col("text").alias("summary")), "r")


@query(f"""WITH {_SYMBOLS}, u AS (SELECT DISTINCT file_path FROM refs WHERE name = 'sym7'), d AS (SELECT DISTINCT file_path FROM edges WHERE from_name = 'fn3') SELECT file_path FROM u WHERE file_path NOT IN (FROM d)""")
def related_without_prime(spark, sf_dir):
    refs, edges = _symbols(spark, sf_dir)
    return refs.where("name = 'sym7'").select("file_path").distinct().join(edges.where("from_name = 'fn3'").select("file_path").distinct(), "file_path", "left_anti")


@query("""WITH h AS (SELECT source AS qid, lang || '/' || source || '/f' || (doc_id % 9) || '.py' AS file_path, doc_id AS rank FROM documents WHERE lang IS NOT NULL), g AS (SELECT DISTINCT source AS qid, source || '/f3.py' AS golden FROM documents UNION ALL SELECT DISTINCT source, 'repo/en/' || source || '/f4.py' FROM documents)
SELECT g.qid, golden, min(rank) AS rank FROM g JOIN h ON g.qid = h.qid AND (file_path = golden OR ends_with(file_path, '/' || golden) OR ends_with(golden, '/' || file_path)) GROUP BY ALL""")
def golden_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.where("lang IS NOT NULL").selectExpr("source AS qid", "concat(lang, '/', source, '/f', CAST(doc_id % 9 AS STRING), '.py') AS file_path", "doc_id AS rank")
    names = d.select("source").distinct()
    golden = names.selectExpr("source AS qid", "concat(source, '/f3.py') AS golden").union(names.selectExpr("source", "concat('repo/en/', source, '/f4.py')"))
    return service.golden_hits(hits, golden)


# ---- composites ------------------------------------------------------------------------------

_IMPACT = f"""{_SYMBOLS}, defs AS (SELECT DISTINCT file_path FROM edges WHERE from_name = 'fn3' ORDER BY file_path LIMIT 20), us AS (SELECT DISTINCT file_path FROM refs WHERE name = 'sym7'),
cs AS (SELECT DISTINCT file_path FROM refs WHERE name = 'sym7' AND kind = 'call'), aff AS (SELECT file_path FROM defs UNION SELECT file_path FROM us UNION SELECT file_path FROM cs)"""


@query(f"""WITH {_IMPACT} SELECT file_path, file_path IN (FROM defs) AS defines, file_path IN (FROM us) AS uses, file_path IN (FROM cs) AS calls, (SELECT count(*) FROM aff) AS n_affected,
(SELECT count(*) FROM us) AS n_using, regexp_extract(file_path, '^(src/[^/]*)', 1) AS module FROM aff""")
def impact(spark, sf_dir):
    """What a symbol's change touches, with the counts of the report."""
    refs, edges = _symbols(spark, sf_dir)
    defs = edges.where("from_name = 'fn3'").select("file_path").distinct().orderBy("file_path").limit(20).withColumn("defines", F.lit(True))
    used = refs.where("name = 'sym7'").groupBy("file_path").agg(F.lit(True).alias("uses"), F.bool_or(F.col("kind") == "call").alias("calls"))
    every = defs.join(used, "file_path", "full").select("file_path", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("defines", "uses", "calls")))
    totals = every.agg(F.count("*").alias("n_affected"), F.count_if("uses").alias("n_using"))
    return every.join(F.broadcast(totals)).withColumn("module", F.regexp_extract("file_path", "^(src/[^/]*)", 1))  # one row of totals


@query(f"""WITH terms AS (SELECT unnest(['the', 'onnt']) AS t), s AS (SELECT doc_id, source, count(*) FILTER (contains(lower(text), t)) / 2.0 + CASE WHEN max(CASE WHEN lower({_NAME}) = t THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS score,
count(*) FILTER (contains(lower(text), t)) AS n FROM documents, terms GROUP BY doc_id, source, text) SELECT doc_id, source, CAST(score AS DOUBLE) AS score FROM s WHERE n > 0 ORDER BY score DESC, source, doc_id LIMIT 5""")
def docs_search(spark, sf_dir):
    """The share of terms that a chunk holds, one more for an exact name, the best five."""
    terms = ("the", "onnt")
    d = _documents(spark, sf_dir).withColumn("low", F.lower("text"))
    found = sum((F.contains("low", F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = found / float(len(terms)) + F.lower("name").isin(*terms).cast("int")
    return d.where(found > 0).select("doc_id", F.col("file_path").alias("source"), score.cast("double").alias("score")).orderBy(F.desc("score"), "source", "doc_id").limit(5)


_SMART = f"""{_SYMBOLS},
q AS (SELECT 'q' || g AS qid, 'sym' || s AS name, s AS pos FROM (SELECT unnest(range(1, 6)) AS g), (SELECT unnest(range(0, 120, 7)) AS s) WHERE s % 5 = g - 1),
ix AS (SELECT DISTINCT name FROM refs), fnd AS (SELECT qid, name, 0 AS origin, pos FROM q WHERE name IN (FROM ix)),
gr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY origin, pos, name) AS place FROM fnd QUALIFY place <= 8),
us AS (SELECT qid, file_path, r.line, container_name, r.kind FROM gr JOIN refs r ON r.name = gr.name WHERE kind IN ('call', 'member')),
df AS (SELECT DISTINCT qid, file_path FROM gr JOIN edges e ON e.to_name = gr.name WHERE relation = 'inherits'),
pool AS (SELECT qid, file_path, 0 AS priority, 0 AS pos FROM df UNION ALL SELECT qid, file_path, 1, line FROM us),
dd AS (SELECT qid, file_path, priority, pos FROM pool QUALIFY row_number() OVER (PARTITION BY qid, file_path ORDER BY priority, pos) = 1)"""


@query(f"WITH {_SMART} SELECT qid, file_path, priority, row_number() OVER (PARTITION BY qid ORDER BY priority, pos, file_path) AS place, count(*) OVER (PARTITION BY qid) AS total FROM dd QUALIFY place <= 15")
def smart_search(spark, sf_dir):
    """Questions' symbols grounded in the index, resolved to definitions and usages, pooled by path and paged, for all questions in one plan."""
    refs, edges = _symbols(spark, sf_dir)
    q = spark.sql("SELECT concat('q', CAST(g AS STRING)) AS qid, concat('sym', CAST(s AS STRING)) AS name, s AS pos FROM (SELECT explode(sequence(1, 5)) AS g) JOIN (SELECT explode(sequence(0, 119, 7)) AS s) ON s % 5 = g - 1")
    none = q.where("false")
    ground = service.grounded(q, refs.select("name"), none, none, "qid")
    used = ground.join(refs.where(F.col("kind").isin("call", "member")), "name").select("qid", "file_path", F.lit(1).alias("priority"), F.col("line").alias("pos"))
    heirs = ground.join(edges.where("relation = 'inherits'").withColumnRenamed("to_name", "name"), "name").select("qid", "file_path", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("pos")).distinct()
    one = Window.partitionBy("qid", "file_path").orderBy("priority", "pos")
    pool = heirs.unionByName(used).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    order = Window.partitionBy("qid").orderBy("priority", "pos", "file_path")
    paged = pool.withColumn("place", F.row_number().over(order).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("qid")))
    return paged.where("place <= 15").select("qid", "file_path", "priority", "place", "total")


@query(f"""WITH {_SYMBOLS}, rel AS (SELECT regexp_extract(file_path, '^(src/[^/]*)', 1) AS module, count(*) AS n_chunks, count(DISTINCT name) AS n_names FROM refs GROUP BY 1)
SELECT module, n_chunks, n_names FROM rel ORDER BY n_chunks DESC, module LIMIT 10""")
def project_modules(spark, sf_dir):
    refs, _ = _symbols(spark, sf_dir)
    module = F.regexp_extract("file_path", "^(src/[^/]*)", 1).alias("module")
    return refs.groupBy(module).agg(F.count("*").alias("n_chunks"), F.countDistinct("name").alias("n_names")).orderBy(F.desc("n_chunks"), "module").limit(10)


@query(f"""WITH RECURSIVE {_SYMBOLS}, c AS (SELECT DISTINCT from_name, to_name FROM edges WHERE relation = 'calls' AND from_name <> to_name),
t AS (SELECT 'sym7' AS name, 0 AS depth UNION SELECT c.from_name, depth + 1 FROM t JOIN c ON c.to_name = t.name WHERE depth < 2) SELECT name, min(depth) AS depth FROM t GROUP BY name""")
def call_tree(spark, sf_dir):
    """Callers of a symbol by levels."""
    _, edges = _symbols(spark, sf_dir)
    calls = edges.where("relation = 'calls' AND from_name != to_name").select("from_name", "to_name").distinct()
    level = spark.sql("SELECT 'sym7' AS name, 0 AS depth")
    every = level
    for depth in (1, 2):
        level = level.join(calls, level["name"] == calls["to_name"]).select(F.col("from_name").alias("name"), F.lit(depth).alias("depth")).distinct()
        every = every.union(level)
    return every.groupBy("name").agg(F.min("depth").alias("depth"))


@query("SELECT p_brand AS file_path, min(p_partkey) AS first_line, max(p_partkey) AS last_line FROM part GROUP BY 1")
def file_definitions(spark, sf_dir):
    defs = table(spark, sf_dir, "part").selectExpr("p_brand AS file_path", "p_partkey AS start_line")
    return defs.groupBy("file_path").agg(F.min("start_line").alias("first_line"), F.max("start_line").alias("last_line"))


