"""Quality rules with adaptive thresholds (operator 1).

Every document gets a few ratios. For each language and source a quantile sketch of every ratio
is built: an HDR-style histogram whose integer bins merge by adding counts, so partial sketches
of tasks, sources and languages combine exactly and in any order. Learnt fences replace fixed cutoffs:
for the length of words, Tukey fences around the sketch's quartiles; for ratios that most texts have
at zero (symbols, repeated lines, repeated words), whose quartiles say nothing, the `upper` percentile
of the values above zero times the share of texts that have any, which is the rate that the group's
own documents bear out. A source's quartiles, shares and percentiles are averaged with its language's,
and those with the corpus's, by the number of documents that they rest on against `borrow`, so small
groups borrow smoothly. The fences are joined back. Ratios are counts over lengths, and short texts scatter: a document is
rejected where its count lies beyond what its length and the fence lead to expect by more than
`deviations` standard deviations of such counts (Poisson's, in units of the events that make them).

Defined cases: null text counts as empty (no words, so the base rule rejects it); null language or
source count as the empty string; an empty table gives an empty result; ties share a bin; repeated
rows are judged alike, one result row each; very long texts are read whole; extra columns are
carried untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import column, map_rows, materialize, small_enough

#: Ratios: count, length, scale of the ratio, and units that one event adds (a repeated window of five words occurs twice).
METRICS = {
    "word_len": ("word_chars", "n_words", 1000, 1),
    "symbols": ("n_symbols", "n_words", 10000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 10000, 1),
    "repeats": ("n_repeat_words", "n_words", 10000, 10),
}
#: Ratios that most texts have at zero.
RARE = ("symbols", "dup_lines", "repeats")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 10
    max_repeat_percent: int = 20
    fence: int = 4
    upper: int = 95
    borrow: int = 200
    deviations: int = 6
    lang: str = "lang"
    source: str = "source"
    text: str = "text"


def text_features(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at ASCII white space alone
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


def with_features(docs: DataFrame, carry: list[str], params: QualityParams) -> DataFrame:
    """carry columns plus a struct column `__q` of features; texts pass through Python once."""
    kinds = T._parse_datatype_string(FEATURES)
    text = params.text
    # positions, not names: extra columns may repeat a name
    need = carry if text in carry else [*carry, text]
    at, n_out = need.index(text), len(carry)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("__q", kinds)])
    names = kinds.fieldNames()

    def make():
        def step(batch: pa.RecordBatch):
            rows = [text_features(x) for x in batch.column(at).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))]
            struct = pa.StructArray.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_out], struct], names=[*carry, "__q"])

        return step

    return map_rows(docs.select(*need), schema, make)


def _metric_columns(q: str = "__q.") -> dict[str, str]:
    return {k: f"({q}{count} * {scale}) div greatest({q}{length}, 1L)" for k, (count, length, scale, _) in METRICS.items()}


def _inside(p: QualityParams, q: str = "__q.") -> str:
    """Whether all counts lie within the fences and their scatter; both engines compute it in the same doubles."""
    tests = []
    for k, (count, length, scale, unit) in METRICS.items():
        for fence, sign in ((f"hi_{k}", 1), (f"lo_{k}", -1)):
            expected = f"({fence} * CAST(greatest({q}{length}, 1) AS DOUBLE))"
            beyond = f"({sign} * (CAST({q}{count} AS DOUBLE) * CAST({scale} AS DOUBLE) - {expected}))"
            spread = f"CAST({p.deviations**2 * unit * scale} AS DOUBLE) * ({expected} + CAST({unit * scale} AS DOUBLE))"
            tests.append(f"coalesce({beyond} <= 0 OR {beyond} * {beyond} <= {spread}, true)")
    return " AND ".join(tests)


def _learned(sketch: str, p: QualityParams, value: str) -> list[tuple[str, str]]:
    """From the sketch to (g_lang, g_source, lo_<metric>, hi_<metric>), as named steps; `value` is the lowest value of a bin."""
    out = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {e} END) AS {e}_{k}" for k in METRICS for e in ("lo", "hi"))
    mix = lambda n, own, above: f"(CAST({n} AS DOUBLE) * {own} + CAST({p.borrow} AS DOUBLE) * {above}) / CAST({n} + {p.borrow} AS DOUBLE)"
    at = lambda test: f"min(CASE WHEN {test} THEN {value} END)"
    rare = f"metric IN ({', '.join(repr(k) for k in RARE)})"
    parts = (("lo", "total"), ("hi", "total"), ("share", "total"), ("top", "nz"))
    mixed = lambda: ", ".join(f"{mix(f'a.{n}', f'a.{e}', f'b.{e}')} AS {e}" for e, n in parts)
    return [
        ("level", f"""
          SELECT 2 AS lv, g_lang AS kl, g_source AS ks, metric, bin, n FROM {sketch}
          UNION ALL SELECT 1, g_lang, '', metric, bin, sum(n) FROM {sketch} GROUP BY g_lang, metric, bin
          UNION ALL SELECT 0, '', '', metric, bin, sum(n) FROM {sketch} GROUP BY metric, bin"""),
        ("run", """
          SELECT *, sum(n) OVER (PARTITION BY lv, kl, ks, metric ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY lv, kl, ks, metric) AS total,
                 sum(CASE WHEN bin = 0 THEN n ELSE 0 END) OVER (PARTITION BY lv, kl, ks, metric) AS zeros FROM level"""),
        ("quart", f"""
          SELECT lv, kl, ks, metric, max(total) AS total, max(total - zeros) AS nz, {at("cum * 4 >= 1 * total")} AS q1, {at("cum * 4 >= 3 * total")} AS q3,
                 coalesce({at(f"bin > 0 AND (cum - zeros) * 100 >= {p.upper} * (total - zeros)")}, 0) AS top
          FROM run GROUP BY lv, kl, ks, metric"""),
        ("fence", f"""
          SELECT lv, kl, ks, metric, total, nz, CAST(greatest(q1 - {p.fence} * (q3 - q1), 0) AS DOUBLE) AS lo, CAST(q3 + {p.fence} * (q3 - q1) AS DOUBLE) AS hi,
                 CAST(nz AS DOUBLE) / CAST(total AS DOUBLE) AS share, CAST(top AS DOUBLE) AS top FROM quart"""),
        ("language", f"""
          SELECT a.kl, a.metric, {mixed()} FROM fence a JOIN fence b ON b.lv = 0 AND b.metric = a.metric WHERE a.lv = 1"""),
        ("source", f"""
          SELECT a.kl AS g_lang, a.ks AS g_source, a.metric, {mixed()} FROM fence a JOIN language b ON b.kl = a.kl AND b.metric = a.metric WHERE a.lv = 2"""),
        ("bounds", f"""
          SELECT g_lang, g_source, metric, CASE WHEN {rare} THEN CAST(0 AS DOUBLE) ELSE lo END AS lo, CASE WHEN {rare} THEN share * top ELSE hi END AS hi FROM source"""),
        ("learned", f"SELECT g_lang, g_source, {out} FROM bounds GROUP BY g_lang, g_source"),
    ]


def _failed(p: QualityParams, q: str = "__q") -> str:
    return f"({q}.n_words < {p.min_words} OR 100 * {q}.n_repeat_words > {p.max_repeat_percent} * {q}.n_words)"


def sketches(features: DataFrame, params: QualityParams) -> DataFrame:
    """(lang, source, metric, bin, n): the mergeable sketch of each group, from documents that pass the base rules."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in _metric_columns().items())
    values = features.where(f"NOT {_failed(params)}").selectExpr(
        f"coalesce(`{params.lang}`, '') AS g_lang", f"coalesce(`{params.source}`, '') AS g_source", f"stack({len(METRICS)}, {pairs}) AS (metric, v)"
    )
    # values under 64 are their own bin; above, the bin holds the bit length and the five bits after the first
    shift = "greatest(length(bin(v)) - 6, 0)"
    return values.selectExpr("g_lang", "g_source", "metric", f"64L * {shift} + shiftright(v, {shift}) AS bin").groupBy(
        "g_lang", "g_source", "metric", "bin"
    ).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, params: QualityParams) -> DataFrame:
    """One row a group: lo_<metric> and hi_<metric>, those of the source, its language and the corpus averaged."""
    value = "shiftleft(bin % 64, CAST(bin div 64 AS INT))"
    steps = ", ".join(f"{name} AS ({sql})" for name, sql in _learned("{sketch}", params, value))
    return sketch.sparkSession.sql(f"WITH {steps} SELECT * FROM learned", sketch=sketch)


def _judged(docs: DataFrame, carry: list[str], params: QualityParams) -> DataFrame:
    """carry columns as c0, c1, ..., and `__q`, `__failed`, `__kept`: no name of docs can clash.

    Texts pass through Python once if they are not carried, else once to learn and once to judge.
    """
    need = list(dict.fromkeys([*carry, params.lang, params.source, params.text]))
    name = {c: f"c{i}" for i, c in enumerate(need)}
    docs = docs.select(*[column(c).alias(name[c]) for c in need])
    carries_text = params.text in carry
    params = replace(params, lang=name[params.lang], source=name[params.source], text=name[params.text])
    group, out = [params.lang, params.source], [name[c] for c in carry]
    rows = with_features(docs, list(dict.fromkeys([*out, *group])), params)
    if not carries_text:
        rows, _ = materialize(rows, "features")
    sketch, _ = materialize(sketches(with_features(docs, group, params) if carries_text else rows, params), "sketch")
    learned, _ = materialize(fences(sketch, params), "fences")
    side = F.broadcast(learned) if small_enough(learned) else learned  # else AQE splits hot sources
    joined = rows.join(
        side, (F.coalesce(rows[params.lang], F.lit("")) == F.col("g_lang")) & (F.coalesce(rows[params.source], F.lit("")) == F.col("g_source")), "left"
    )
    return joined.select(*out, "__q", F.expr(_failed(params)).alias("__failed"), F.expr(f"NOT {_failed(params)} AND {_inside(params)}").alias("__kept"))


def judge(docs: DataFrame, carry: list[str], params: QualityParams = QualityParams()) -> DataFrame:
    """carry columns, the struct `__q` of features, `__failed` (base rules) and `__kept` (all rules)."""
    return _judged(docs, carry, params).toDF(*carry, "__q", "__failed", "__kept")


def quality_filter(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return _judged(docs, docs.columns, params).where("__kept").drop("__q", "__failed", "__kept").toDF(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, ["doc_id"]).selectExpr(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words", "__failed AS base_failed", "__kept AS kept"
    )


def oracle() -> str:
    metric = {k: v.replace(" div ", " // ").replace("1L", "1") for k, v in _metric_columns("").items()}
    p = QualityParams()
    stack = " UNION ALL ".join(f"SELECT g_lang, g_source, '{k}' AS metric, {v} AS v FROM feat WHERE NOT base_failed" for k, v in metric.items())
    value = "(bin % 64) * CAST(pow(2, bin // 64) AS BIGINT)"
    learned = ",\n    ".join(f"{name} AS ({sql})" for name, sql in _learned("sk", p, value))
    return f"""
    WITH w AS (
      SELECT doc_id, coalesce(lang, '') AS g_lang, coalesce(source, '') AS g_source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    pos AS (SELECT doc_id, i, ws[i:i+4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
    rep AS (SELECT doc_id, win FROM pos GROUP BY doc_id, win HAVING count(*) > 1),
    cov AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT pos.doc_id, i + k AS p FROM pos JOIN rep ON pos.doc_id = rep.doc_id AND pos.win = rep.win, unnest(range(0, 5)) AS q(k)) GROUP BY doc_id),
    lin AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
        SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    base AS (
      SELECT w.doc_id, g_lang, g_source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN lin ON w.doc_id = lin.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
    feat AS (SELECT *, (n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words) AS base_failed FROM base),
    vals AS ({stack}),
    sk AS (
      SELECT g_lang, g_source, metric, 64 * greatest(length(bin(v)) - 6, 0) + (v >> greatest(length(bin(v)) - 6, 0)) AS bin, count(*) AS n
      FROM vals GROUP BY ALL),
    {learned}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_inside(p, "")} AS kept
    FROM feat LEFT JOIN learned ON learned.g_lang = feat.g_lang AND learned.g_source = feat.g_source"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": oracle()}
