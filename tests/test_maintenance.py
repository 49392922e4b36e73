import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from gristmill.operators import maintenance
from gristmill.operators.maintenance import FileTable, Registry, StateTable

SCHEMA = "path string, hash string, text string"


def chunk(files):
    return files.select(F.col("path").alias("file_path"), F.explode(F.split("text", " ")).alias("word"))


def files(spark, **texts):
    return spark.createDataFrame([(k, None if v is None else f"h:{v}", v) for k, v in texts.items()], SCHEMA)


def words(table, spark):
    return sorted((r.file_path, r.word) for r in table.read(spark).collect())


def digests(path):
    return {p.relative_to(path): (p.stat().st_mtime_ns, hashlib.sha256(p.read_bytes()).hexdigest()) for p in sorted(pathlib.Path(path).rglob("*.parquet"))}


@pytest.fixture
def index(tmp_path):
    return FileTable(f"file://{tmp_path}/chunks", buckets=8), StateTable(f"file://{tmp_path}/state")


def test_untouched_buckets_stay_as_they_are(spark, tmp_path):
    table = FileTable(f"file://{tmp_path}/t", buckets=8)
    rows = spark.range(200).selectExpr("concat('f', id % 40) AS file_path", "id AS x")
    table.create(rows)
    before = digests(tmp_path / "t")
    one = rows.where("file_path = 'f7'")
    touched = {r.b for r in one.select(maintenance.bucket_of("file_path", 8).alias("b")).distinct().collect()}
    assert table.replace(one.select("file_path"), one.limit(2).withColumn("x", F.lit(-1).cast("long"))) == {"deleted": 5, "written": 2}
    after = digests(tmp_path / "t")
    changed = {p.parts[0] for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
    assert changed == {f"bucket={b}" for b in touched}
    assert sorted(r.x for r in table.read(spark).where("file_path = 'f7'").collect()) == [-1, -1]
    assert table.read(spark).count() == 197


def test_replacing_again_changes_nothing_and_empty_buckets_go(spark, tmp_path):
    table = FileTable(f"file://{tmp_path}/t", buckets=4)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("", 3), (None, 4)], "file_path string, x int")
    for _ in range(2):
        table.replace(rows.select("file_path"), rows)
        assert sorted(map(tuple, table.read(spark).collect())) == [("a", 1), ("b", 2)]  # files without a name are no files
    assert table.delete(rows.select("file_path")) == 2 and table.read(spark).count() == 0
    assert table.delete(rows.select("file_path")) == 0


def test_repair(spark, tmp_path):
    table = FileTable(f"file://{tmp_path}/t", buckets=4)
    table.create(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "file_path string, x int"))
    assert table.repair(spark.createDataFrame([("a",)], "file_path string")) == 2
    assert [r.x for r in table.read(spark).collect()] == [1]


def test_commit_diffs_deletes_and_keeps_scope(spark, index):
    table, state = index
    first = maintenance.commit(files(spark, a="one two", b="three", c="four"), table, state, chunk)
    assert (first["added"], first["written"], first["generation"]) == (3, 4, 1)
    second = maintenance.commit(files(spark, a="one two", b="five six"), table, state, chunk)
    assert (second["unchanged"], second["changed"], second["deleted"]) == (1, 1, 1) and second["written"] == 2
    assert words(table, spark) == [("a", "one"), ("a", "two"), ("b", "five"), ("b", "six")]
    third = maintenance.commit(files(spark, b="five six"), table, state, chunk, in_scope=F.col("path") != "a")
    assert third["deleted"] == 0 and {r.path for r in state.load(spark).collect()} == {"a", "b"}


def test_failed_files_are_taken_again(spark, index):
    table, state = index
    maintenance.commit(files(spark, a="old", b="same"), table, state, chunk)
    maintenance.commit(files(spark, a="new", b="same", c="c"), table, state, chunk, fail=F.col("path") == "a")
    assert words(table, spark) == [("b", "same"), ("c", "c")] and {r.path for r in state.load(spark).collect()} == {"b", "c"}
    again = maintenance.commit(files(spark, a="new", b="same", c="c"), table, state, chunk)
    assert again["added"] == 1 and words(table, spark) == [("a", "new"), ("b", "same"), ("c", "c")]


def test_a_run_that_breaks_before_its_state_can_be_done_again(spark, index, monkeypatch):
    table, state = index
    maintenance.commit(files(spark, a="one"), table, state, chunk)
    monkeypatch.setattr(StateTable, "save", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        maintenance.commit(files(spark, a="two", b="b"), table, state, chunk)
    monkeypatch.undo()
    assert [tuple(r) for r in state.load(spark).collect()] == [("a", "h:one")]
    for _ in range(2):
        maintenance.commit(files(spark, a="two", b="b"), table, state, chunk)
        assert words(table, spark) == [("a", "two"), ("b", "b")]
    assert len(state.generations(spark)) == maintenance.GENERATIONS


def test_a_generation_is_written_once(spark, tmp_path):
    state = StateTable(f"file://{tmp_path}/s")
    assert state.load(spark).count() == 0
    state.save(spark.createDataFrame([("a", "1")], "path string, hash string"))
    late = StateTable(f"file://{tmp_path}/s")
    object.__setattr__(late, "generations", lambda _: [])  # as another run saw it
    with pytest.raises(RuntimeError):
        late.save(spark.createDataFrame([("b", "2")], "path string, hash string"))
    assert [r.path for r in state.load(spark).collect()] == ["a"]


def test_registry(spark, tmp_path):
    registry = Registry(StateTable(f"file://{tmp_path}/r", "name string, chunks long"))
    rows = lambda *x: spark.createDataFrame(x, "name string, chunks long")
    registry.upsert(rows(("b", 1), ("a", 2)))
    registry.upsert(rows(("b", 5)))
    assert [tuple(r) for r in registry.list(spark).collect()] == [("a", 2), ("b", 5)]
    assert registry.get(spark, "b").first().chunks == 5 and registry.get(spark, "z").count() == 0


def test_stream_of_changes(spark, index, tmp_path):
    table, state = index
    schema = f"{SCHEMA}, ord long"
    batch = lambda n, *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: maintenance.follow_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, state, chunk, f"{tmp_path}/cp").awaitTermination()
    batch(1, ("a", "h1", "one", 1), ("b", "h2", "two", 1), ("a", "h3", "uno", 2))
    run()
    assert words(table, spark) == [("a", "uno"), ("b", "two")]
    batch(2, ("b", None, None, 3), ("c", "h4", "three", 3))
    run()
    run()  # nothing new
    assert words(table, spark) == [("a", "uno"), ("c", "three")]
    before = state.load(spark).collect()
    again = spark.createDataFrame([("b", None, None), ("c", "h4", "three")], SCHEMA)
    assert maintenance.commit(again, table, state, chunk, partial=True)["written"] == 0
    assert sorted(state.load(spark).collect()) == sorted(before) and words(table, spark) == [("a", "uno"), ("c", "three")]


def test_rows_are_written_once(spark, tmp_path, monkeypatch):
    table, written = FileTable(f"file://{tmp_path}/t", buckets=4), []
    keep = maintenance.materialize
    monkeypatch.setattr(maintenance, "materialize", lambda df, *a: written.append(df.columns) or keep(df, *a))
    table.create(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, x int"))
    files = spark.createDataFrame([("a",), ("b",), ("d",)], "file_path string")
    fresh = spark.createDataFrame([("a", 7), ("d", 8), ("e", 9)], "file_path string, x int")
    assert table.replace(files, fresh) == {"deleted": 2, "written": 2}  # e is none of the files
    assert sorted(map(tuple, table.read(spark).collect())) == [("a", 7), ("c", 3), ("d", 8)]
    assert not [x for x in written if "x" in x]  # names of files alone
