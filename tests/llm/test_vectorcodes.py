"""Vector codes against plain loops in integers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest

from gristmill.llm import vectorcodes
from gristmill.llm.vectorcodes import CodeParams, Codebook


def brute(rows, p=CodeParams()):
    """vec_id, code, error of (vec_id, vector), sorted, and the codebooks' digest."""
    kept = [(i, [math.floor(p.scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // p.parts
    cut = [[v[k * width : (k + 1) * width] for k in range(p.parts)] for _, v in kept]
    books = [[list(c[k]) for c in cut[: p.entries]] for k in range(p.parts)]
    near = lambda x, book: min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(x, book[j])), j))
    for _ in range(p.rounds):
        for k, book in enumerate(books):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[k], book), []).append(c[k])
            for j, xs in groups.items():
                book[j] = [sum(x) // len(xs) for x in zip(*xs)]
    out = []
    for (i, _), c in zip(kept, cut):
        codes = [near(c[k], books[k]) for k in range(p.parts)]
        out.append((i, "".join(f"{x:02x}" for x in codes), sum((a - b) ** 2 for k in range(p.parts) for a, b in zip(c[k], books[k][codes[k]]))))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(out, key=repr), digest


def run(spark, tmp_path, rows, schema="vec_id long, embedding array<double>, label int"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    return vectorcodes.op12_vector_codes(spark, str(tmp_path)).collect()


def test_against_loops_with_ties_repeats_and_bad_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) + rng.choice([0.0, 0.0, 0.001]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(700)]
    rows += [rows[0], rows[5], (None, [0.1] * 8, None), (900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] + [0.0] * 7, 2)]
    got = run(spark, tmp_path, rows)
    want, digest = brute([r[:2] for r in rows])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    labels = {}
    by_id = {i: label for i, _, label in rows}
    for r in got:
        labels[by_id[r.vec_id]] = labels.get(by_id[r.vec_id], 0) + r.error
    assert all(r.label_error == labels[by_id[r.vec_id]] for r in got)


def test_fewer_vectors_than_entries_and_other_lengths(spark, tmp_path):
    rows = [(1, [0.0, 1.0, 2.0, 3.0], 1), (2, [1.0, 1.0, 1.0, 1.0], 1), (3, [1.0] * 8, 1), (4, [], 1)]
    got = {r.vec_id: r for r in run(spark, tmp_path, rows)}
    assert got[1].code == "00000000" and got[2].code == "01000101" and got[2].error == 0
    assert got[3].code is None and got[3].error is None and got[4].code is None and got[1].label_error == 0


def test_parts_must_divide(spark, tmp_path):
    assert [tuple(r)[:4] for r in run(spark, tmp_path, [(1, [1.0, 2.0, 3.0], None)])] == [(1, None, None, None)]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_clashing_names_are_carried(spark):
    rows = spark.createDataFrame([(1, [0.5] * 4, "a", "b")], "vec_id long, embedding array<float>, code string, `__q` string")
    coded, _, _ = vectorcodes.compress(rows, "embedding", "vec_id", ["code", "__q", "vec_id"])
    assert tuple(coded.first()) == ("a", "b", 1, bytearray(4), 0)


def test_too_large_components_end_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        run(spark, tmp_path, [(1, [1e30, 0.0, 0.0, 0.0], 1)])


@pytest.mark.parametrize("top", [50, 1 << 27])
def test_search_is_exact_from_any_start(top):
    rng = np.random.default_rng(1)
    entries = rng.integers(-top, top, (60, 5))
    entries[7] = entries[3]
    book, x = Codebook(entries), rng.integers(-top, top, (400, 5))
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(400, np.int64), rng.integers(0, 60, 400)):
        index, low = book.search(x, start)
        assert (index == exact.argmin(1)).all() and (low == exact.min(1)).all()


def test_search_scans_only_the_ball():
    entries = np.r_[np.arange(100)[:, None] * 1000, [[5]]].astype(np.int64)
    scanned, book = [], Codebook(entries)
    inner = book.distances
    book.distances = lambda x, e: scanned.append(x.shape[0] * len(e)) or inner(x, e)
    book.search(np.array([[40_001], [40_002]]), np.array([40, 40]))
    assert sum(scanned) <= 6
