import datetime
import uuid

from pyspark.sql import functions as F

from gristmill.functions import text as fn
from gristmill.operators import extract, index, retrieval, spans, stats, symbols
from gristmill.sources import files as sources
from gristmill.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_recency(spark):
    now = F.lit("2024-07-24 12:00:00").cast("timestamp")
    stamps = [None, "yesterday", "2024-07-24 12:00:00", "2024-07-24T12:00:00Z", "2030-01-01T00:00:00Z", "2024-07-24T15:00:00+03:00", "2024-04-25T12:00:00Z", "2024-06-24T12:00:00Z"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(stamps)), "i int, s string").select("i", fn.recency_score(F.col("s"), now)).orderBy("i").collect()]
    assert got[:7] == [0, 0, 0, 1, 1, 1, 0] and abs(got[7] - 2.718281828459045**-1) < 1e-9


def test_scalar_functions(spark):
    r = spark.range(1).select(
        fn.uuid5(F.lit("abc")).alias("u"), fn.estimate_tokens(F.lit("12345")).alias("t"), fn.squash_lexical(F.lit(5.0)).alias("s"),
        fn.redact(F.lit("api_key = abc, Bearer x.y")).alias("r"), fn.file_stem(F.lit("a/b.c.py")).alias("f"), fn.parent_dir(F.lit("a/b/c.py")).alias("d"),
        fn.humanize_seconds(F.lit(3700)).alias("h"), fn.truthy(F.lit("YES")).alias("y"), fn.truthy(F.lit(None).cast("string"), True).alias("n"),
        fn.quality_score(F.lit("false"), F.lit("true"), F.lit("true"), F.lit(None).cast("int"), F.lit("true")).alias("q"), fn.lossy_text(F.lit(b"a\xff")).alias("l"),
    ).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc")) and r.t == 2 and r.s == 0.46875
    assert r.r == "api_key=<redacted>, Bearer <redacted>" and r.f == "b.c" and r.d == "a/b" and r.h == "1h 1m" and r.y and r.n
    assert abs(r.q - 0.6) < 1e-9 and r.l == "a�"


def test_filters_differ(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (5, "b", ["y"]), (None, "c", None)], "start_line int, language string, tags array<string>")
    assert rows(df.where(retrieval.payload_filter({"start_line": 2})).select("language")) == [("b",)]
    assert rows(df.where(retrieval.payload_filter({"tags": ["x", "z"], "language": []}, ["tags"])).select("language")) == [("a",)]
    assert rows(df.where(retrieval.payload_filter({"start_line": None})).select("language")) == [("c",)]
    assert rows(df.where(retrieval.mirror_filter({"language": ["a", None], "start_line": 7})).select("language")) == [("a",)]


def test_merge_keeps_first_score(spark):
    hits = spark.createDataFrame([(0, "a", 0.1, 1), (0, "b", 0.2, 2), (1, "b", 0.9, 1)], "qid int, id string, score double, rank long")
    assert {r.id: (r.score, r.matched) for r in retrieval.merge_hits(hits, "id").collect()} == {"a": (0.1, [0]), "b": (0.2, [0, 1])}


def test_token_budget(spark):
    df = spark.createDataFrame([(1, "abcd\nefgh\nijkl"), (2, "short"), (3, "abcdefghijk"), (4, "")], "id int, t string")
    got = {r.id: (r.kept, r.tokens) for r in retrieval.line_budget(df, "id", "t", 2).collect()}
    assert got == {1: ("abcd", 1), 2: ("short", 2), 3: ("abcdefgh", 2), 4: ("", 1)}
    assert {r.kept for r in retrieval.line_budget(df, "id", "t", 0).collect()} == {""}


def test_overlap_dedupe(spark):
    df = spark.createDataFrame([("f", 1, 10, 1), ("f", 5, 12, 2), ("f", 10, 20, 3), ("g", 1, 10, 4), ("f", 2, 3, 5)], "file_path string, start_line long, end_line long, rank long")
    assert sorted(r.rank for r in spans.overlap_dedupe(df).collect()) == [1, 3, 4]


def test_diff_covers_all_paths(spark):
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "path string, hash string")
    assert rows(index.state_diff(cur, old)) == [("a", "added"), ("b", "unchanged"), ("c", "changed"), ("d", "deleted")]
    flushed = spark.createDataFrame([("a",)], "path string")
    assert rows(index.next_state(cur, old, F.col("path") != "d", flushed)) == [("a", "1"), ("b", "2"), ("d", "4")]


def test_traverse_with_cycle(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "inherits"), ("c", "a", "calls"), ("c", "c", "calls"), ("c", "d", "imports"), ("c", "e", "calls")], "from_node string, to_node string, relation string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(symbols.traverse(e, start, 2)) == [("b", 1), ("c", 1), ("e", 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "file_path string, language string, name string, updated_at double")
    assert stats.code_files(empty).count() == 0
    edges = spark.createDataFrame([], "from_node string, to_node string, relation string")
    assert symbols.traverse(edges, spark.createDataFrame([], "node string"), 3).count() == 0
    log = spark.createDataFrame([], "id long, ts timestamp, latency_ms double, results long")
    assert stats.query_stats(log).first().n == 0


def test_rate_limit_is_anchored(spark):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, at + datetime.timedelta(seconds=s), i) for i, s in enumerate((50, 55, 58, 61, 109, 110, 111, 112))]
    df = spark.createDataFrame(events, "user long, ts timestamp, id long")
    got = {r.id: r.accepted for r in streams.rate_limit(df, "user", "ts", "id", 3, 60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_follow_stream(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "timestamp_seconds(id) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # once each
        streams.follow(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.PY").write_text("x = 1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text("y")
    assert [r.language for r in sources.discover(spark, str(tmp_path), ["py"], ["node_modules"]).collect()] == ["python"]
    (tmp_path / "v.jsonl").write_text('{"file": "a", "summary": "one"}\nbad\n{"file": "a", "summary": "two"}\n{"file": "b", "summary": "ERROR x"}\n')
    assert rows(sources.read_vocab(spark, str(tmp_path / "v.jsonl"))) == [("a", "two")]
    log = ["2024-02-01T00:00:00Z", "a", "b", "", "2024-01-01T00:00:00Z", "b", "c"]
    got = sources.parse_git_log(spark.createDataFrame(list(enumerate(log)), "at int, line string"))
    assert rows(got) == [("a", log[0]), ("b", log[0]), ("c", log[4])]
    df = spark.createDataFrame([("p", 1)], "id string, n int")
    where = sources.export_jsonl(df, "out", str(tmp_path))
    assert rows(sources.import_jsonl(spark, where, "n int")) == [("p", 1)]


def test_python_extraction():
    source = 'class Greeter:\n    """Doc."""\n\n    def hello(self):\n        return greet(self.name)\n\ndef build(n):\n    g = Greeter()\n    return g.hello()\n'
    found = list(extract.python_symbols(source))
    assert [(r[1], r[3], r[4], r[6], r[7]) for r in found if r[0] == "def"] == [("class", "Greeter", "", 1, 5), ("method", "Greeter.hello", "Greeter", 4, 5), ("function", "build", "", 7, 9)]
    assert [(r[2], r[5]) for r in found if r[0] == "edge"] == [("hello", "greet"), ("build", "Greeter"), ("build", "hello")]
    assert list(extract.python_symbols("def (")) == []
    kotlin = "object A {\n  fun f(): Int {\n    return 1\n  }\n}\n"
    assert list(extract.brace_scan(kotlin, "kotlin")) == [("object", "A", "A", 1, 5), ("method", "f", "A.f", 2, 4)]
