"""The pipeline's near-dedup against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import neardup

SCHEMA = "doc_id long, text string, k int"


@pytest.fixture(scope="module")
def rows():
    """Edited copies at similarities around the limit, a large group of copies, a shared passage, repeated rows, null ids, blanks."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    text = lambda n: [word() for _ in range(n)]

    def edited(words, places):
        out = list(words)
        for i in rng.sample(range(len(out)), places):
            out[i] = word()
        return out

    base, passage = text(200), text(60)
    texts = [base, base, *(edited(base, e) for e in range(1, 12)), *(text(150) for _ in range(8))]
    big = text(150)
    texts += [edited(big, 1) for _ in range(40)] + [passage + text(40) for _ in range(25)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "a b", "A  b", "one two three four five six"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(i, texts[t], t) for i, t in enumerate(order)]
    return [*out, *[x for x in out if x[2] < 3] * 2, (None, texts[0], 0), (None, "all alone here", -1), (None, "all alone here", -1)]


def brute(rows):
    """The doc ids that stay, one for each group."""
    grams = lambda w: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [grams((t or "").lower().split()) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for i, (doc, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc is None, doc or 0))
    return Counter(None if none else doc for none, doc in map(min, groups.values()))


@pytest.mark.parametrize("few", [neardup.FEW, 2])
def test_one_row_of_each_group(spark, rows, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == brute(rows)
    assert corpus_pipeline.near_dedup(spark, df.where(F.lit(False)), "").count() == 0


def test_repeated_rows_and_null_ids_keep_their_content_once(spark):
    """Copies that share a doc_id or have none leave one row, so that the passage stage keeps the text."""
    rng = random.Random(8)
    one, two, three = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(3))
    df = spark.createDataFrame([(1, one, 0), (1, one, 0), (1, one, 1), (2, two, 0), (None, two, 0), (None, three, 0), (None, three, 0)], SCHEMA)
    left = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, one), (2, two), (0, three)])
    assert sorted(r.text for r in corpus_pipeline.passage_dedup(spark, left, "").collect()) == sorted([one, two, three])
