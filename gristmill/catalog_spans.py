"""Queries of code spans and overlaps, with SQL that must agree.

Documents stand for sources: sentences become lines, and common words become what code holds (braces,
headers, notes, strings), so that every rule of the spans has lines that it applies to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.catalog import query, table
from gristmill.operators import spans

_WHITE = spans._WHITE
_STRING = r"""(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)|'(?:[^'\\]|\\.)*(?:'|\\?$)"""
#: Replacements that turn prose into lines of code, in order.
_PLAIN = ((". ", "\n"), (", ", " { "), (" is ", " \"is{\" "), (" le ", " it's { \\' } "))
_STARTS = (("The|Der|Le|El", "fun "), ("And|Und|Et|Y", "@"), ("Of|Von|De|La", "} "), ("In|Or", "  class "), ("To|A|It", ""))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _code_sql() -> str:
    out = "text"
    for a, b in _PLAIN:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    for words, mark in _STARTS:
        out = f"regexp_replace({out}, '(?m)^(?:{words}) ', '{mark}', 'g')"
    return out


def _sources(spark, sf_dir):
    text = F.col("text")
    for a, b in _PLAIN:
        text = F.replace(text, F.lit(a), F.lit(b))
    for words, mark in _STARTS:
        text = F.regexp_replace(text, f"(?m)^(?:{words}) ", mark)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), text.alias("text"))


_HITS = """hits AS (
  SELECT doc_id % 20 AS qid, 'd' || (doc_id + CASE WHEN doc_id % 50 = 7 THEN 10000000 ELSE 0 END) AS file_path, CAST(1 + (doc_id * 31 + k * 5) % 45 AS INT) AS line, CASE k % 2 WHEN 0 THEN 'symbol' ELSE 'usages' END AS source,
         CASE k WHEN 2 THEN 'property' ELSE 'function' END AS kind, CASE k % 2 WHEN 0 THEN 'definitions' ELSE 'usages' END AS role, 'n' || k AS name,
         CASE doc_id % 3 WHEN 0 THEN 'override fun x' ELSE '' END AS signature, CAST(doc_id % 7 AS DOUBLE) / 2 AS score
  FROM documents, (VALUES (0), (1), (2), (3), (4), (5)) v(k))"""


def _hits(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_hits")
    return spark.sql(f"WITH {_HITS.replace('FROM documents', 'FROM documents_of_hits')} SELECT * FROM hits")


_SPANS = f"""src AS (SELECT 'd' || doc_id AS path, {_code_sql()} AS text FROM documents WHERE text IS NOT NULL), {_HITS},
l AS (SELECT path, len(ls) AS n, i - 1 AS pos, ls[i] AS raw FROM (SELECT path, string_split(text, chr(10)) AS ls FROM src), unnest(range(1, len(ls) + 1)) AS r(i)),
ln AS (SELECT *, regexp_replace(raw, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t, regexp_replace(raw, '^{_WHITE}+', '') AS lt, regexp_replace(raw, {_quoted(_STRING)}, '', 'g') AS bare FROM l),
m AS MATERIALIZED (
  SELECT path, n, pos, raw, length(replace(bare, '}}', '')) - length(replace(bare, '{{', '')) AS delta, contains(raw, '{{') AS op, t = '' AS blank,
         regexp_matches(t, {_quoted(spans._SYMBOL)}) AS sym, {" OR ".join(f"starts_with(t, '{x}')" for x in spans.NOTE_MARKS)} AS note, {" OR ".join(f"starts_with(lt, '{x}')" for x in spans.HEADS)} AS head FROM ln),
x AS (SELECT h.*, n, least(greatest(line - 1, 0), n - 1) AS idx FROM (
  SELECT DISTINCT file_path AS path, line, source = 'symbol' AND kind <> 'property' AS as_symbol FROM hits) h JOIN (SELECT DISTINCT path, n FROM m) USING (path)),
y AS (SELECT x.path, x.line, as_symbol, x.n, CASE WHEN as_symbol THEN idx ELSE max(m.pos) END AS spot, CASE WHEN as_symbol THEN {spans.SYMBOL_LINES} ELSE {spans.USAGE_LINES} END AS most
  FROM x LEFT JOIN m ON m.path = x.path AND m.head AND m.pos BETWEEN idx - {spans.USAGE_ABOVE} AND idx GROUP BY x.path, x.line, as_symbol, x.n, idx),
z AS (SELECT y.path, y.line, as_symbol, y.n, spot, most, coalesce(max(m.pos) + 1, greatest(spot - {spans.NOTES}, 0)) AS head
  FROM y LEFT JOIN m ON m.path = y.path AND m.pos BETWEEN spot - {spans.NOTES} AND spot - 1 AND NOT m.note GROUP BY y.path, y.line, as_symbol, y.n, spot, most),
c AS (SELECT z.path, z.line, as_symbol, m.pos, spot, blank OR sym AS ends, sum(delta) OVER w AS bal, bool_or(op) OVER w AS o
  FROM z JOIN m ON m.path = z.path AND m.pos BETWEEN spot AND spot + most - 1 WINDOW w AS (PARTITION BY z.path, z.line, as_symbol ORDER BY m.pos)),
e AS (SELECT path, line, as_symbol, min(CASE WHEN pos > spot AND o AND bal <= 0 THEN pos + 1 WHEN pos > spot AND NOT o AND ends THEN pos END) AS last FROM c GROUP BY ALL),
b AS (SELECT z.path, z.line, z.as_symbol, CASE WHEN spot IS NULL THEN greatest(z.line - {spans.AROUND}, 1) ELSE z.head + 1 END AS start_line,
             CASE WHEN spot IS NULL THEN least(z.line + {spans.AROUND}, n) ELSE coalesce(last, least(n, spot + most)) END AS end_line
  FROM z LEFT JOIN e ON e.path = z.path AND e.line = z.line AND e.as_symbol = z.as_symbol),
k AS (SELECT b.path, b.line, as_symbol, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, coalesce(string_agg(raw, chr(10) ORDER BY pos), '') AS code
  FROM b LEFT JOIN m ON m.path = b.path AND m.pos BETWEEN start_line - 1 AND end_line - 1 GROUP BY ALL),
coded AS MATERIALIZED (SELECT hits.*, start_line, end_line, code FROM hits LEFT JOIN k ON k.path = file_path AND k.line = hits.line AND k.as_symbol = (source = 'symbol' AND kind <> 'property'))"""


@query(f"WITH {_SPANS} SELECT file_path, line, source, kind, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, coalesce(code, '') AS code FROM coded")
def code_spans(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("file_path", "line", "source", "kind")
    return spans.attach_code(hits, _sources(spark, sf_dir)).fillna({"start_line": 0, "end_line": 0, "code": ""})


def _greedy_sql(rows: str, by: str, order: str) -> str:
    """CTEs that end in `kept`: rows (by, start_line, end_line) of `rows` kept in turn."""
    keys = by.split(", ")
    return f"""sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}, start_line, end_line) AS i FROM {rows}),
g AS (
  SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS i, false AS keep, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS held FROM sp
  UNION ALL
  SELECT {", ".join(f"g.{x}" for x in keys)}, sp.i, NOT clash, CASE WHEN clash THEN held ELSE list_append(held, {{'a': sp.start_line, 'b': sp.end_line}}) END
  FROM g JOIN sp ON sp.i = g.i + 1 AND {" AND ".join(f"sp.{x} = g.{x}" for x in keys)},
  LATERAL (SELECT len(list_filter(held, lambda h: least(h.b, sp.end_line) - greatest(h.a, sp.start_line) + 1 >= 0.5 * greatest(least(h.b - h.a, sp.end_line - sp.start_line) + 1, 1))) > 0 AS clash)),
kept AS (SELECT sp.* FROM sp JOIN g ON g.keep AND g.i = sp.i AND {" AND ".join(f"sp.{x} = g.{x}" for x in keys)})"""


_INTERVALS = "spans AS (SELECT source AS file_path, doc_id % 400 AS start_line, doc_id % 400 + n_chars % 60 AS end_line, doc_id AS rank FROM documents)"


@query(f"WITH RECURSIVE {_INTERVALS}, {_greedy_sql('spans', 'file_path', 'rank')} SELECT file_path, start_line, end_line, rank FROM kept")
def overlap_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    start = F.col("doc_id") % 400
    return spans.overlap_dedupe(d.select(F.col("source").alias("file_path"), start.alias("start_line"), (start + F.col("n_chars") % 60).alias("end_line"), F.col("doc_id").alias("rank")))


_TRIMMED = f"regexp_replace(coalesce(code, ''), '^{_WHITE}+|{_WHITE}+$', '', 'g')"


@query(f"""WITH RECURSIVE {_SPANS},
ranked AS (
  SELECT *, -(score + least(CAST(end_line - start_line + 1 AS DOUBLE) / 20, 2.0) + CASE WHEN starts_with(trim(signature), 'override ') OR starts_with(t, 'override ') THEN 1.5 ELSE 0 END
    - CASE WHEN end_line - start_line + 1 <= 1 AND NOT contains(t, '{{') AND NOT contains(t, '=') THEN 1.0 ELSE 0 END - CASE WHEN contains(t, '@Deprecated') THEN 0.75 ELSE 0 END) AS worse FROM (
    SELECT * REPLACE (coalesce(nullif(start_line, 0), line) AS start_line, coalesce(nullif(end_line, 0), line) AS end_line, coalesce(code, '') AS code), {_TRIMMED} AS t FROM coded)
  WHERE role <> 'definitions' OR t <> ''),
{_greedy_sql("ranked", "qid, role, file_path", "worse, line, name")}
SELECT qid, role, file_path, line, source, kind, name, signature, score, start_line, end_line, code, -worse AS rank,
  row_number() OVER (PARTITION BY qid, role ORDER BY worse, file_path, line, name) AS place FROM kept QUALIFY place <= 5""")
def resolve_with_code(spark, sf_dir):
    return spans.resolve_with_code(_hits(spark, sf_dir), _sources(spark, sf_dir), 5)
