"""More queries than one block holds."""

import random

import pytest

from gristmill import catalog
from gristmill.operators import retrieval


@pytest.mark.parametrize("block", [3, 4096])
def test_every_query_is_searched(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = random.Random(1)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)], "id long, embedding array<double>")
    queries = points.selectExpr("id AS qid", "embedding AS qvec").where("id % 2 = 0")
    got = [(r.qid, r.id) for r in retrieval.dense_topk(points, queries, 1, "id").collect()]
    assert sorted(got) == [(i, i) for i in range(0, 40, 2)]


@pytest.mark.parametrize("name", ["dense_topk", "filtered_topk", "diff_restricted_topk", "multi_query_merge", "lod_drill"])
def test_full_searches_are_registered(name):
    assert "vec_id % 50 = 0" in catalog.ORACLES[f"{name}_all"]
