"""Ranks by distributed selection against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import index, retrieval, stats
from gristmill.sources import files


@pytest.mark.parametrize("ordered", [0, 3, 10**6])
def test_ranks_are_those_of_sorting(spark, monkeypatch, ordered):
    monkeypatch.setattr(stats, "ORDERED_ROWS", ordered)
    monkeypatch.setattr(stats, "RANGES", 5)
    rng = random.Random(2)
    groups = {"a": [rng.choice([1, 2, 3, 10**12]) for _ in range(300)], "b": [rng.expovariate(1) for _ in range(200)], "c": [5.0], None: [2.0, 1.0, float(2**53), float(2**53 + 2)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    got = {r.g: r for r in stats.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", [0, 50, 95, 100], ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(map(float, vs))
        assert [got[g][f"p{p}"] for p in (0, 50, 95, 100)] == [vs[int(p / 100 * (len(vs) - 1) + 0.5)] for p in (0, 50, 95, 100)]


def test_one_group_and_long_values_that_doubles_do_not_part(spark, monkeypatch):
    monkeypatch.setattr(stats, "ORDERED_ROWS", 0)
    values = [2**60 + i for i in range(9)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    r = stats.at_ranks(df, "v", {"mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}).first()
    assert (r.n, r.mid, r.top) == (9, values[4], values[8])


def test_symbols_are_taken_literally(spark):
    hits = spark.createDataFrame([(1, "a.b(c) d"), (2, "aXb")], "id int, content string")
    assert [r.id for r in retrieval.sanity_filter(hits, ["a.b"]).collect()] == [1]
    assert retrieval.sanity_filter(hits, [r"x\Ey("]).count() == 2


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_long_sequences_are_filled_in_ranges(spark, parts):
    rng = random.Random(parts)
    values = [rng.choice([None] * 9 + ["x", "y"]) for _ in range(500)]
    values[:30] = [None] * 30
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(5)
    want, last = {}, None
    for i, v in enumerate(values):
        last = v or last
        want[i] = last
    assert {r.i: r.v for r in index.forward_fill_ranges(rows, "v", ["i"], parts).collect()} == want


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    text = "".join(f"2024-{1 + i % 12:02d}-01T00:00:00+02:00\r\n\nfile {i % 50}\n" if i % 3 else f"file {i % 50}\n" for i in range(600))
    (tmp_path / "log").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = files.read_lines(spark, str(tmp_path / "log"))
        got = dict(map(tuple, files.parse_git_log(lines, ("file", "block", "at"), 8).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, date = {}, None
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("2024"):
            date = line
        elif line and date:
            want.setdefault(line, date)
    assert got == want
