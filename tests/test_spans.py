import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import spans

KOTLIN = """package a

// A note.
/* Another. */
@Inject
class Account(
    val id: Long,
) {
    val label = "brace { in a string"

    /** Doc.
     * more */
    @Deprecated
    fun close(x: Int): Int {
        if (x > 0) {
            return 'c' + "\\" { "
        }
        return 0
    }

    fun one() = 1
    fun two() = 2
}

def python(a):
    x = 1
    return x

y = 2
z = 3"""


def spans_of(spark, text, hits):
    rows = [("f", line, source, kind) for line, source, kind in hits]
    got = spans.attach_code(spark.createDataFrame(rows, "file_path string, line int, source string, kind string"), spark.createDataFrame([("f", text)], "path string, text string"))
    return {(r.line, r.source): (r.start_line, r.end_line, r.code) for r in got.collect()}


def test_symbols_and_usages(spark):
    hits = [(6, "symbol", "class"), (14, "symbol", "function"), (21, "symbol", "function"), (25, "search_symbol", "function"), (16, "usages", "call"), (29, "usages", "call"), (9, "symbol", "property"), (2, "usages", "call")]
    got = spans_of(spark, KOTLIN, hits)
    lines = KOTLIN.split("\n")
    assert got[14, "symbol"][:2] == (11, 19)  # three lines of notes above, braces in strings left out
    assert got[14, "symbol"][2] == "\n".join(lines[10:19])
    assert got[6, "symbol"][:2] == (3, 6)  # the next line opens no brace and begins another symbol
    assert got[21, "symbol"][:2] == (21, 21)
    assert got[25, "search_symbol"][:2] == (25, 27)
    assert got[16, "usages"][:2] == (11, 19)
    assert got[29, "usages"][:2] == (25, 27)
    assert got[9, "symbol"][:2] == (3, 6)  # a property is placed like a usage
    assert got[2, "usages"][:2] == (1, 10)


def test_strings_hide_braces(spark):
    cases = {'a { b': 1, '"{"': 0, "'{' {": 1, '"\\"{" }': -1, '"open { ': 0, "it's { '}": -1, '\\"{"}': -1, '"a\\': 0, "": 0, "{}{": 1, '"' + "\\a" * 20_000 + '" {': 1}
    rows = spark.createDataFrame(list(cases.items()), "s string, want int").select("s", "want", spans.brace_delta(F.col("s")).alias("got")).collect()
    assert [(r.s, r.got) for r in rows if r.got != r.want] == []


def by_loops(lines, line, as_symbol):
    """The contract in plain loops."""
    import re

    symbol = re.compile(r"\b(?:class|interface|object|enum|fun|def|function|val|var)\b|=>|\{")

    def delta(s):
        quote, n, i = "", 0, 0
        while i < len(s):
            if quote:
                if s[i] == "\\":
                    i += 1
                elif s[i] == quote:
                    quote = ""
            elif s[i] in "'\"":
                quote = s[i]
            else:
                n += (s[i] == "{") - (s[i] == "}")
            i += 1
        return n

    def of_symbol(at, most):
        first = at
        while first and at - first < 6 and lines[first - 1].strip().startswith(("@", "//", "/*", "*")):
            first -= 1
        balance, opened = 0, False
        for pos in range(at, min(at + most, len(lines))):
            balance, opened = balance + delta(lines[pos]), opened or "{" in lines[pos]
            if pos > at and opened and balance <= 0:
                return first + 1, pos + 1
            if pos > at and not opened and (not lines[pos].strip() or symbol.search(lines[pos].strip())):
                return first + 1, pos
        return first + 1, min(at + most, len(lines))

    at = min(max(line - 1, 0), len(lines) - 1)
    if as_symbol:
        return of_symbol(at, 90)
    for pos in range(at, max(at - 40, 0) - 1, -1):
        if lines[pos].lstrip().startswith(("fun ", "def ", "function ", "class ", "interface ", "object ")):
            return of_symbol(pos, 80)
    return max(line - 8, 1), min(line + 8, len(lines))


def test_against_loops_over_block_borders(spark):
    rng = random.Random(4)
    kinds = ["fun a() {", "}", "  x = 1", "", "@note", "// note", "val q = '{'", " } {", "call(\"}\")", "class B", "y", "y", "y", "y => z", "{"]
    lines = [rng.choice(kinds) for _ in range(900)] + ["y"] * 300 + ["class Long {"] + ["y"] * 200
    hits = [(n, s, "function") for n in range(0, len(lines) + 3, 7) for s in ("symbol", "usages")]
    got = spans_of(spark, "\n".join(lines), hits)
    for n, source, _ in hits:
        first, last = by_loops(lines, n, source == "symbol")
        assert got[n, source][:2] == (first, last), (n, source)
        assert got[n, source][2] == "\n".join(lines[first - 1 : last])


def test_hits_without_a_source_and_repeats(spark):
    hits = spark.createDataFrame([("f", 1, "symbol", "class", "x"), ("f", 1, "symbol", "class", "x"), ("gone", 1, "symbol", "class", "y"), ("null", 2, "usages", None, "z")], "file_path string, line int, source string, kind string, extra string")
    got = spans.attach_code(hits, spark.createDataFrame([("f", "class A"), ("null", None), ("other", "x")], "path string, text string")).collect()
    assert sorted((r.file_path, r.code) for r in got if r.code) == [("f", "class A")] * 2
    assert sum(r.start_line is None for r in got) == 2 and all(r.extra for r in got)


def plain_greedy(rows, share):
    kept = []
    for i, (a, b) in enumerate(rows):
        if all(max(min(b, d) - max(a, c) + 1, 0) / max(min(b - a, d - c) + 1, 1) < share for _, c, d in kept):
            kept.append((i, a, b))
    return [i for i, _, _ in kept]


@pytest.mark.parametrize("share", [0.3, 0.5, 0.9, 1.0])
def test_greedy_is_the_plain_one(share):
    rng = random.Random(7)
    for _ in range(60):
        rows = [(a := rng.randint(0, 60), a + rng.choice([0, 1, 3, 10, 40])) for _ in range(rng.randint(1, 60))]
        assert spans.greedy(rows, share) == plain_greedy(rows, share)


def test_one_file_with_very_many_spans(spark):
    many = spark.range(300_000).selectExpr("'f' AS file_path", "id % 100000 AS start_line", "id % 100000 + 5 + id % 20 AS end_line", "(id * 7919) % 300007 AS rank")
    kept = spans.overlap_dedupe(many).orderBy("start_line").collect()
    assert len(kept) > 5_000
    for x, y in zip(kept, kept[1:]):
        overlap = min(x.end_line, y.end_line) - y.start_line + 1
        assert overlap < 0.5 * (min(x.end_line - x.start_line, y.end_line - y.start_line) + 1)


def test_many_small_runs_need_no_call_each(spark, capsys):
    many = spark.range(60_000).selectExpr("concat('f', id div 3) AS file_path", "10 + id % 3 AS start_line", "20 + id % 3 AS end_line", "id % 3 AS rank", "concat('code ', id) AS code")
    kept = spans.overlap_dedupe(many)
    kept.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert [tuple(r) for r in kept.groupBy("rank").count().collect()] == [(0, 20_000)]


def test_spans_without_an_end_are_kept(spark):
    rows = spark.createDataFrame([("f", 1, 9, 0), ("f", 2, None, 1), ("f", 3, 9, 2)], "file_path string, start_line long, end_line long, rank int")
    assert sorted(r.rank for r in spans.overlap_dedupe(rows).collect()) == [0, 1]


def test_code_is_not_shuffled(spark, capsys):
    hits = spark.createDataFrame([("f", 1, "symbol", "class")] * 3, "file_path string, line int, source string, kind string").union(spark.createDataFrame([("f", None, "usages", "call")], "file_path string, line int, source string, kind string"))
    got = spans.attach_code(hits.hint("merge"), spark.createDataFrame([("f", "class A")], "path string, text string"))
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2  # of hits and of blocks
    assert sorted(r.code or "" for r in got.collect()) == ["", "class A", "class A", "class A"]


@pytest.mark.parametrize("n", [1, 127, 128, 129, 256, 257])
def test_hits_near_and_beyond_the_last_block(spark, n):
    lines = [f"fun a{i}() {{" if i % 9 == 0 else "}" if i % 9 == 5 else f"x{i}" for i in range(n)]
    hits = [(x, s, "function") for x in (-3, 0, 1, n - 1, n, n + 1, n + 5, n + 130, n + 300) for s in ("symbol", "usages")]
    got = spans_of(spark, "\n".join(lines), hits)
    assert len(got) == len(set(hits))
    for x, source, _ in hits:
        first, last = by_loops(lines, x, source == "symbol")
        assert got[x, source] == (first, last, "\n".join(lines[first - 1 : max(last, first - 1)])), (x, source)
