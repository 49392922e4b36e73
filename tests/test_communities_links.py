"""Rounds of label propagation join links as they lie."""

import random
from collections import Counter

from gristmill.operators import communities


def test_links_are_shuffled_once(spark, monkeypatch):
    plans, write = [], communities.materialize
    monkeypatch.setattr(communities, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    draw = random.Random(5)
    edges = [(f"n{draw.randrange(60)}", f"n{int(60 * draw.random() ** 3)}", draw.randrange(1, 4)) for _ in range(200)] + [("hub", f"n{i}", 1) for i in range(60)]
    try:
        labels, _ = communities.label_propagation(spark.createDataFrame(edges, "a string, b string, weight int"), 3)
        got = {r.node: r.label for r in labels.collect()}
        bare, _ = communities.label_propagation(spark.createDataFrame(edges, "a string, b string, weight int"), 0)
        assert all(r.node == r.label for r in bare.collect()) and bare.count() == len(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = [x for x in plans if "Join" in x]
    assert rounds and all(x.count("Exchange hashpartitioning(b#") <= 1 for x in rounds)  # the labels' own
    links = Counter()
    for a, b, w in edges:
        if a != b:
            links[a, b] += w
            links[b, a] += w
    held = {a: a for a, _ in links}
    for _ in range(3):
        votes = {a: Counter({own: 1}) for a, own in held.items()}
        for (a, b), w in links.items():
            votes[a][held[b]] += w
        held = {a: min(v, key=lambda x: (-v[x], x)) for a, v in votes.items()}
    assert got == held
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gristmill_links")]
