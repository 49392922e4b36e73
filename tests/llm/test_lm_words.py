"""The word level of op2's model: classes from training counts, words within a class by context."""

import random
import time
import zlib
from collections import Counter
from math import exp, log
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash

lm = pytest.importorskip("gristmill.llm.lm")

DOCS = "doc_id long, text string"
GOLD = 0x9E3779B97F4A7C15


def signed(word):
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(70)]
    made = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(70)], k=rng.randint(0, 25)))) for i in range(n)]
    return [*made, (None, "w1 w2 w3"), (2, "never seen w1 before"), (n + 1, None), (n + 2, "")]


def slow_bounds(masses, classes):
    """First ranks of the classes: each takes words until it has its share of what mass is left."""
    out, at = [0], 0
    for left in range(min(classes, len(masses)), 1, -1):
        share, took, start = -(-sum(masses[at:]) // left), 0, at
        while took < share:
            took += masses[at]
            at += 1
        at = min(max(at, start + 1), len(masses) - left + 1)
        out.append(at)
    return out + [len(masses)]


def slow_scores(rows, p):
    """Each row's score by the definition: one token, feature and branching at a time."""
    docs = [[w for w in (t or "").encode().lower().split()] + [b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for d, x in zip(docs, held) if not x for w in d)
    order = sorted(count, key=lambda w: (-count[w], signed(w)))
    rank = {w: i for i, w in enumerate(order)}
    masses = [count[w] + 1 for w in order] + [1]
    bounds = slow_bounds(masses, p.classes)
    K = range(len(bounds) - 1)
    of = lambda w: rank.get(w, len(order))
    klass = lambda w: max(k for k in K if bounds[k] <= of(w))

    def path(w):
        k, r = klass(w), of(w)
        low, high, out = bounds[k], bounds[k + 1], []
        while high - low > 1:
            level = (high - low - 1).bit_length() - 1
            mid = low + (1 << level)
            out.append(((mid * 0x9E3779B1 ^ level * 0x85EBCA6B) % (1 << 32), r >= mid, log((high - mid) / (mid - low))))
            low, high = (mid, high) if r >= mid else (low, mid)
        return out

    def keys(d):
        code = [(xxhash.xxh3_64_intdigest(w) >> 32) + 1 for w in d]
        for i in range(len(d)):
            one, two = code[i - 1] if i else 0, code[i - 2] if i > 1 else 0
            yield one * 3, one * 0x100000001B3 % (1 << 64) ^ two * 0x1000193 % (1 << 64), two * 7 + 5

    bucket = lambda x: ((x * GOLD % (1 << 64)) >> 40) % p.buckets
    slot = lambda x, node: ((((x * 0xD6E8FEB86659FD93 % (1 << 64)) >> 32) ^ node) * 0x9E3779B1 % (1 << 32)) >> (32 - p.slot_bits)
    paths = {w: path(w) for d in docs for w in d}
    tokens = [[([bucket(x) for x in f], klass(w), [([slot(x, node) for x in f], up, ref) for node, up, ref in paths[w]]) for f, w in zip(keys(d), d)] for d in docs]
    train = [t for d, x in zip(tokens, held) if not x for t in d]
    sigma = lambda z: 1 / (1 + exp(-z))
    clip = lambda x: max(-1, min(1, x)) / 3
    seen, classes, visits, ups, refs = Counter(), Counter(c for _, c, _ in train), Counter(), Counter(), Counter()
    for f, c, branches in train:
        seen.update((b, c) for b in f)
        for s, up, ref in branches:
            for one in s:
                visits[one] += 1
                ups[one] += up
                refs[one] += sigma(ref)
    prior = [(classes[c] + 1) / (len(train) + len(K)) for c in K]
    whole = {b: sum(seen[b, c] for c in K) for b in range(p.buckets)}
    weight = {(b, c): (log((seen[b, c] + 20 * prior[c]) / (whole[b] + 20)) - log(prior[c])) / 3 for b in whole for c in K}
    bias = [log(x) for x in prior]
    logit = lambda x: log(x / (1 - x))
    usual = {s: refs[s] / visits[s] for s in visits}
    side = Counter({s: (logit((ups[s] + 20 * usual[s]) / (visits[s] + 20)) - logit(usual[s])) / 3 for s in visits})
    logits = lambda f: [bias[c] + sum(weight[b, c] for b in f) for c in K]
    for _ in range(p.rounds):
        want, want_class, upper = Counter(), Counter(), Counter()
        for f, _, branches in train:
            e = [exp(x) for x in logits(f)]
            for c in K:
                want_class[c] += e[c] / sum(e)
                for b in f:
                    want[b, c] += e[c] / sum(e)
            for s, _, ref in branches:
                chance = sigma(ref + sum(side[one] for one in s))
                for one in s:
                    upper[one] += chance
        weight = {k: v + clip((seen[k] - want[k]) / (want[k] + 10)) for k, v in weight.items()}
        bias = [v + clip((classes[c] - want_class[c]) / (want_class[c] + 10)) for c, v in enumerate(bias)]
        side = Counter({s: v + clip((ups[s] - upper[s]) / (upper[s] * (1 - upper[s] / visits[s]) + 10)) for s, v in side.items()})
    out = []
    for d in tokens:
        total = 0.0
        for f, c, branches in d:
            z = logits(f)
            total += z[c] - log(sum(map(exp, z)))
            for s, up, ref in branches:
                x = ref + sum(side[one] for one in s)
                total += log(sigma(x if up else -x))
        out.append(total / log(10))
    return out


def test_scores_equal_definition(spark):
    rows = texts()
    p = lm.LmParams(block_bytes=300, buckets=64, classes=6, slot_bits=9, chunk=50, tree_chunk=20, rank_rows=4)  # equal counts are cut
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score_documents(spark.createDataFrame(rows, DOCS), p).collect())
    want = sorted((i if i is not None else -1, s) for (i, _), s in zip(rows, slow_scores(rows, p)))
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-4)


@pytest.mark.parametrize("sizes", [{}, {3: 1}, {1: 40}, {900: 1, 50: 2, 7: 5, 2: 30, 1: 200}, {10**9: 1, 1: 5}])
@pytest.mark.parametrize("classes", [1, 2, 6, 32])
def test_classes_are_runs_of_ranks_of_equal_mass(sizes, classes):
    ranks = lm.Ranks.of(sizes, classes)
    masses = [c + 1 for c in sorted(sizes, reverse=True) for _ in range(sizes[c])] + [1]
    assert ranks.bounds.tolist() == slow_bounds(masses, classes)
    assert (ranks.counts(np.arange(len(masses))) + 1).tolist() == masses


def test_words_of_a_class_sum_to_one_after_any_context():
    ranks = lm.Ranks.of({900: 1, 50: 2, 7: 5, 2: 30, 1: 200}, 6)
    p = lm.LmParams(slot_bits=10)
    every = np.random.default_rng(1).permutation(239)
    klass = ranks.classes(every)
    weights = np.random.default_rng(2).normal(size=1 << 10).astype(np.float32)
    for context in range(3):  # every word once, each after the same context
        x = SimpleNamespace(ids=np.arange(239), contexts=[np.full(239, 12345 * context + i, np.uint32) for i in range(3)])
        for lambdas in (weights, 0 * weights):
            total = np.zeros(239)
            for tokens, slots, up, uneven, lift in lm.branchings(x, every, klass, ranks, np.arange(239), p):
                z = lm._lifted(slots, uneven, lift, lambdas)
                total[tokens] -= np.log1p(np.exp(np.where(up, -z, z)))
            assert np.bincount(klass, np.exp(total)) == pytest.approx([1] * 6, rel=1e-5)
        assert np.exp(total) == pytest.approx(1 / np.diff(ranks.bounds)[klass], rel=1e-5)  # without features: all alike


def test_words_of_equal_count_are_told_apart_by_context(spark):
    """Forty pairs of words, all as frequent: only the word before tells which comes."""
    rng = random.Random(5)
    pairs = [(f"a{i}xx", f"b{i}xx") for i in range(40)]  # one ending
    common = " ".join(f"f{i}" for i in range(20))  # words frequent enough for classes of their own
    rows = [(i, f"{common} {common} " + " ".join(w for x in rng.sample(pairs, 40) for w in x)) for i in range(150)]
    right, wrong = [i for i in range(10_000, 10_100) if lm._is_held(i, lm.LmParams())][:2]
    ends = [(right, " ".join(f"a{i}xx b{i}xx" for i in range(40))), (wrong, " ".join(f"a{i}xx b{(i + 1) % 40}xx" for i in range(40)))]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows + ends, DOCS)).collect()}
    # class and word alone: the two differ little; a word's five branchings by context: more than half a digit a pair
    assert got[right] > got[wrong] + 20


def test_scores_equal_definition_with_an_odd_number_of_classes(spark):
    rows = texts(30, seed=4)
    p = lm.LmParams(block_bytes=300, buckets=64, classes=5, slot_bits=9, chunk=50, tree_chunk=20)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score_documents(spark.createDataFrame(rows, DOCS), p).collect())
    want = sorted((i if i is not None else -1, s) for (i, _), s in zip(rows, slow_scores(rows, p)))
    assert got == [(i, pytest.approx(s, rel=1e-4)) for i, s in want]


def test_shuffle_files_go_without_garbage_collection_and_weights_are_rows(spark, monkeypatch):
    """Files of finished steps would be on disk beside those of later ones; columns would be copied for every few tokens."""
    folders = [Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for x in folders for f in x.rglob("shuffle_*.data")}
    learnt, train, before = [], lm.train, files()
    monkeypatch.setattr(lm, "train", lambda *a: learnt.append(train(*a)) or learnt[0])
    monkeypatch.setattr(lm, "release", lambda spark: None)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    lm.score_documents(spark.createDataFrame(texts(), DOCS), lm.LmParams(block_bytes=300, buckets=64, classes=6))
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert learnt[0][0].flags.c_contiguous
    assert spark.conf.get(key) == setting
