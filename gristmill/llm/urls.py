"""URL filter by a path-template tree (operator 4), in DataFrame and SQL functions alone.

Explicit rules come first, the longest that fits. For the other pages a tree of path templates
is grown per host: segments with digits or of great length become typed wildcards, and rare
literals under a busy parent become `{w}`. Every node counts its pages and those that the rules
label as blocked. Walking down from the host, a branch's blocked share is tested against that of
its sibling branches (two proportions, pooled): branches that do not differ significantly are
merged and share their parent's purity; one that differs has its own, smoothed towards the
parent's. A branch without a label resembles nothing: it has the prior. Templates whose smoothed
purity of blocked pages reaches the limit are rejected.

Only the aggregated templates are joined back, never one host's pages with each other; a hot
host is summed before the shuffle and its pages are split by AQE's skew join.

Defined cases: null url or one without `://` has empty host and path and is judged by its
template like any other; the last level's segment is all that remains of the path, so no depth is lost; no labels at all
leave the prior, which allows; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gristmill.llm.common import materialize

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


@dataclass(frozen=True)
class UrlParams:
    #: Levels of the tree; the last holds the rest of the path.
    max_depth: int = 4
    rare_share: float = 0.01
    busy_children: int = 20
    z: float = 1.96
    smoothing: float = 4.0
    prior: float = 0.25
    limit: float = 0.6


def _steps(pages: str, rules, p: UrlParams, spark: bool) -> list[tuple[str, str]]:
    """The filter as named SQL steps over the view `pages` (page_id, url); the last is the result.

    The dialects differ in a few names.
    """
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = {"rule": "", "verdict": ""}
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = {quoted(host)} OR {'endswith' if spark else 'ends_with'}(host, {quoted('.' + host)})) AND {'startswith' if spark else 'starts_with'}(path, {quoted(path)})"
        cases["rule"] += f" WHEN {fits} THEN {quoted(host + path)}"
        cases["verdict"] += f" WHEN {fits} THEN {quoted(verdict)}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shape = (
        "CASE WHEN regexp_like(s, '^[0-9]+$') THEN '{n}' WHEN regexp_like(s, '^[0-9]+[.][A-Za-z]+$') THEN '{n}.{e}'"
        " WHEN regexp_like(s, '^[0-9A-Fa-f-]{8,}$') THEN '{x}' WHEN regexp_like(s, '[0-9]') OR length(s) > 32 THEN '{v}' ELSE s END"
    )
    if not spark:
        shape = shape.replace("regexp_like", "regexp_matches")
        segs = f"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shape})"
        seg = lambda i: f"CASE WHEN len(segs) >= {i} THEN segs[{i}] END"
        rest = f"CASE WHEN len(segs) >= {p.max_depth} THEN array_to_string(segs[{p.max_depth}:], '/') END"
    else:
        segs = f"transform(filter(split(path, '/'), s -> s <> ''), s -> {shape})"
        seg = lambda i: f"CASE WHEN size(segs) >= {i} THEN segs[{i - 1}] END"
        rest = f"CASE WHEN size(segs) >= {p.max_depth} THEN array_join(slice(segs, {p.max_depth}, size(segs)), '/') END"
    d = p.max_depth
    s0 = ", ".join(f"{seg(i) if i < d else rest} AS s{i}" for i in range(1, d + 1))
    every = ", ".join(f"s{i}" for i in range(1, d + 1))
    find = "instr" if spark else "strpos"
    steps = [
        ("cut", f"SELECT page_id, CASE WHEN {find}(url, '://') > 0 THEN substr(url, {find}(url, '://') + 3) ELSE '' END AS rest FROM {pages}"),
        ("parsed", f"""SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
                       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut"""),
        ("ruled", f"SELECT *, CASE{cases['rule']} END AS rule, CASE{cases['verdict']} END AS ruled, {segs} AS segs FROM parsed"),
        ("shaped", f"SELECT page_id, host, path, rule, ruled, {s0} FROM ruled"),
        ("t0", f"SELECT host, {every}, count(*) AS pages, count(ruled) AS n, count(CASE WHEN ruled = 'block' THEN 1 END) AS k FROM shaped GROUP BY host, {every}"),
    ]
    # rare literals of a busy parent, level by level: parents are already generalised
    for i in range(1, d + 1):
        both = ", ".join(["host", *(f"g{j}" for j in range(1, i))])
        on = " AND ".join(["a.host = b.host", *(f"a.g{j} IS NOT DISTINCT FROM b.g{j}" for j in range(1, i))])
        rare = f"a.s{i} IS NOT NULL AND substr(a.s{i}, 1, 1) <> '{{' AND b.kids >= {p.busy_children} AND a.pages < {p.rare_share} * b.pages"
        steps += [
            (f"c{i}", f"SELECT {both}, s{i}, sum(pages) AS pages FROM t{i - 1} GROUP BY {both}, s{i}"),
            (f"u{i}", f"SELECT {both}, sum(pages) AS pages, count(*) AS kids FROM c{i} GROUP BY {both}"),
            (f"r{i}", f"SELECT a.{both.replace(', ', ', a.')}, a.s{i}, CASE WHEN {rare} THEN '{{w}}' ELSE a.s{i} END AS g{i} FROM c{i} a JOIN u{i} b ON {on}"),
            (f"t{i}", f"SELECT a.*, b.g{i} FROM t{i - 1} a JOIN r{i} b ON {on} AND a.s{i} IS NOT DISTINCT FROM b.s{i}"),
        ]
    # purity from the host down; a branch that is like its siblings takes the parent's
    steps.append(("q0", f"SELECT host, sum(n) AS n, sum(k) AS k, (sum(k) + {p.smoothing} * {p.prior}) / (sum(n) + {p.smoothing}) AS purity FROM t{d} GROUP BY host"))
    for i in range(1, d + 1):
        keys = ["host", *(f"g{j}" for j in range(1, i + 1))]
        on = " AND ".join(["a.host = b.host", *(f"a.g{j} IS NOT DISTINCT FROM b.g{j}" for j in range(1, i))])
        rate, others = "(CAST(a.k AS DOUBLE) / a.n)", "(CAST(b.k - a.k AS DOUBLE) / nullif(b.n - a.n, 0))"
        pooled = "(CAST(b.k AS DOUBLE) / b.n)"
        se = f"sqrt({pooled} * (1.0 - {pooled}) * (1.0 / a.n + 1.0 / nullif(b.n - a.n, 0)))"
        purity = f"""CASE WHEN a.n = 0 THEN CAST({p.prior} AS DOUBLE) WHEN b.n = a.n OR abs({rate} - {others}) <= {p.z} * {se} THEN b.purity
                     ELSE (a.k + {p.smoothing} * b.purity) / (a.n + {p.smoothing}) END AS purity"""
        steps += [
            (f"m{i}", f"SELECT {', '.join(keys)}, sum(n) AS n, sum(k) AS k FROM t{d} GROUP BY {', '.join(keys)}"),
            (f"q{i}", f"SELECT a.{', a.'.join(keys)}, a.n, a.k, {purity} FROM m{i} a JOIN q{i - 1} b ON {on}"),
        ]
    same = " AND ".join(f"a.s{i} IS NOT DISTINCT FROM b.s{i}" for i in range(1, d + 1))
    deep = " AND ".join(["a.host = b.host", *(f"a.g{i} IS NOT DISTINCT FROM b.g{i}" for i in range(1, d + 1))])
    joined = "".join(f" || CASE WHEN a.g{i} IS NULL THEN '' ELSE '/' || a.g{i} END" for i in range(1, d + 1))
    return [
        *steps,
        ("judged", f"SELECT a.host, {every.replace('s', 'a.s')}, '' {joined} AS template, b.purity FROM t{d} a JOIN q{d} b ON {deep}"),
        ("result", f"""SELECT a.page_id, a.host, a.path, a.rule, coalesce(a.ruled, CASE WHEN b.purity >= {p.limit} THEN 'block' ELSE 'allow' END) AS verdict,
                       b.template FROM shaped a LEFT JOIN judged b ON a.host = b.host AND {same}"""),
    ]


def url_filter(pages: DataFrame, rules=RULES, params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    spark, tag = pages.sparkSession, "gristmill_url_"
    pages.select("page_id", "url").createOrReplaceTempView(f"{tag}pages")
    steps = _steps("pages", rules, params, True)
    names = sorted([name for name, _ in steps] + ["pages"], key=len, reverse=True)
    frame = pages
    for name, sql in steps:
        frame = spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", rf"\1 {tag}\2", sql))
        if re.fullmatch(r"t\d+|judged", name):  # templates: few rows, read several times
            frame, _ = materialize(frame, f"url-{name}")
        frame.createOrReplaceTempView(tag + name)
    return frame


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle() -> str:
    *steps, (_, last) = _steps("pages", RULES, UrlParams(), False)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps) + f"\n{last}"


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": oracle()}
