from collections import defaultdict

import pytest

quality = pytest.importorskip("gristmill.llm.quality")
SCHEMA = "doc_id long, text string, lang string, source string"


def by_definition(rows, p):
    """{doc_id: kept} by plain loops over the definition in the module's docstring."""
    measures = (("word_chars", 1000, 1, 1, 0), ("n_symbols", 10000, 1, 2, 0), ("n_dup_lines", 10000, 1, 3, 5), ("n_repeat_words", 10000, 10, 4, 0))
    feats = {i: quality.text_features(t) for i, t, *_ in rows}
    failed = {i: f[0] < p.min_words or 100 * f[4] > p.max_repeat_percent * f[0] for i, f in feats.items()}
    levels = defaultdict(lambda: defaultdict(list))
    for i, _, lang, source in rows:
        if not failed[i]:
            for name, scale, _, at, over in measures:
                v = feats[i][at] * scale // max(feats[i][over], 1)
                low = v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6)
                for group in ((), (lang or "",), (lang or "", source or "")):
                    levels[group][name].append(low)

    def learnt(group, name):
        """low, high, share, top of a group, averaged with those above it."""
        values = sorted(levels[group][name])
        some = [v for v in values if v]
        at = lambda vs, k, of: vs[-(-k * len(vs) // of) - 1]
        q1, q3 = at(values, 1, 4), at(values, 3, 4)
        own = max(0, q1 - p.fence * (q3 - q1)), q3 + p.fence * (q3 - q1), len(some) / len(values), at(some, p.upper, 100) if some else 0
        if not group:
            return own
        counts = len(values), len(values), len(values), len(some)
        return tuple((n * o + p.borrow * a) / (n + p.borrow) for n, o, a in zip(counts, own, learnt(group[:-1], name)))

    def fences(group, name):
        low, high, share, top = learnt(group, name)
        return (low, high) if name == "word_chars" else (0, share * top)

    kept = {}
    for i, _, lang, source in rows:
        kept[i] = not failed[i]
        for name, scale, unit, at, over in measures if kept[i] else ():
            low, high = fences((lang or "", source or ""), name)
            n, count = max(feats[i][over], 1), feats[i][at]
            for expected, off in ((high * n / scale, count - high * n / scale), (low * n / scale, low * n / scale - count)):
                if off > 0 and off**2 > p.deviations**2 * unit * (expected + unit):
                    kept[i] = False
    return kept


def corpus():
    rows = []
    for i in range(400):
        lang, source = ("en", "de", None)[i % 3], ("plain", "symbols")[i % 2]
        words = [f"{'w' * (3 + (i * j) % 5)}{i}x{j}" for j in range(40 + i % 60)]
        if source == "symbols":
            words = [w + "|%" for w in words]
        text = " ".join(words) + "\n" + "same line\n" * (i % 4)
        if i % 37 == 0:
            text += " ### $$$ ||| " * 40
        if i % 41 == 0:
            text = " ".join("z" * 90 + str(j) for j in range(60))
        rows.append((i, text, lang, source))
    return rows


def test_verdicts_follow_the_definition(spark):
    rows, p = corpus(), quality.QualityParams()
    got = {r.doc_id: r["__kept"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    want = by_definition(rows, p)
    assert got == want
    assert 0 < sum(not k for k in want.values()) < 100
    kept = {r.doc_id for r in quality.quality_filter(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {i for i, k in want.items() if k}


def test_sources_have_fences_of_their_own_and_small_ones_borrow(spark):
    docs = spark.createDataFrame(corpus() + [(1000, " ".join(f"few{j}" for j in range(20)), "en", "tiny")], SCHEMA)
    p = quality.QualityParams()
    learned = quality.fences(quality.sketches(quality.with_features(docs, ["lang", "source"], p), p), p)
    high = {(r.g_lang, r.g_source): r.hi_symbols for r in learned.collect()}
    assert high["en", "symbols"] > high["en", "plain"]
    assert len(set(high.values())) >= 4
    assert abs(high["en", "tiny"] - high["en", "plain"]) < abs(high["en", "symbols"] - 0)


def test_fences_of_the_given_sources_differ(spark):
    docs, p = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), quality.QualityParams()
    learned = quality.fences(quality.sketches(quality.with_features(docs, ["lang", "source"], p), p), p).collect()
    assert len(learned) > 20
    for name in ("hi_symbols", "hi_dup_lines", "hi_repeats", "hi_word_len"):
        assert min(r[name] for r in learned) > 0 and len({r[name] for r in learned}) > len(learned) / 2
