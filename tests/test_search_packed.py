"""Searches by products of blocks give what scoring pair by pair gives."""

import random

import pytest

from gristmill.operators import retrieval


@pytest.mark.parametrize(("k", "block"), [(1, 7), (5, 7), (5, 1024), (400, 64)])
def test_blocks_agree_with_pairs(spark, monkeypatch, capsys, k, block):
    monkeypatch.setattr(retrieval, "POINT_BLOCK", block)
    rng = random.Random(k)
    vectors = [[rng.choice([-1.0, 0.5, 2.0, 3.0]) for _ in range(3)] for _ in range(150)]  # many copies and ties
    vectors += [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    odd = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 2.0], [float("inf"), 1.0, 1.0], []]
    rows = list(enumerate(vectors + odd))
    rng.shuffle(rows)
    points = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = points.where("id % 3 = 0 OR id >= 210").selectExpr("CAST(id AS BIGINT) AS qid", "embedding AS qvec")
    packed = retrieval.dense_topk(points, queries, k, "id")
    packed.explain()
    assert "NestedLoopJoin" not in capsys.readouterr().out
    pairs = retrieval._search_block(points, queries, k, "id", "embedding", None)
    assert packed.schema == pairs.schema
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(packed) == key(pairs)
