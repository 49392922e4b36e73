"""Operators on small tables: brute force, edge cases, SQL."""

import hashlib
import pathlib
import random
import zlib
from collections import Counter
from math import log10

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import bpe, catalog, chat, common, decontaminate, licenses, lm, neardup, quality, simhash, substrings, tokencount, urls

SF = pathlib.Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, h string, `k1` int"


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, passages, blanks, nulls, repeated rows and a long one."""
    rng = random.Random(2)
    words = [f"wort{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(90)
    base = text(200)
    texts = [base, base, base.replace("wort1 ", "other "), f"{text(30)} {passage} {text(20)}", f"{text(5)} {passage}", f"{passage[:500]} {text(40)}", None, "", " \n\t ", "short", "aé" * 900, text(6000), *(text(60) for _ in range(12))]
    out = [(i, t, None if i == 4 else "en", "s1" if i % 2 else None, None if t is None else len(t), i, "x", 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, base, "en", "s1", 1, 1, "y", 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, none, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r["__q"]), r["__failed"]) for r in quality.judge(docs, ["doc_id"]).collect())
    want = sorted((i if i is not None else -1, f := quality.text_features(t), f[0] < 10 or 100 * f[4] > 20 * f[0]) for i, t, *_ in rows)
    assert got == want
    kept = quality.quality_filter(docs)
    assert kept.schema == docs.schema and kept.count() > 10
    assert quality.quality_filter(none).count() == 0


def test_quality_fences_reject_outliers(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice([f"word{k}" for k in range(60)]) for _ in range(80)), "en", "s") for i in range(80)]
    bad = (99, " ".join(f"w{i}$$$" for i in range(80)), "en", "s")
    kept = {r.doc_id for r in quality.quality_filter(spark.createDataFrame([*good, bad], "doc_id long, text string, lang string, source string")).collect()}
    assert 99 not in kept and len(kept) >= 76


def test_simhash_components(docs, none, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = {i: simhash.fingerprint(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted((i, signed(simhash.fingerprint(t)), root[i]) if i is not None else (-1, signed(simhash.fingerprint(t)), None) for i, t, *_ in rows)
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(3).shuffle(edges)
    got, _ = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)} | {(201, 200)}


@pytest.mark.parametrize("bucket", [64, 3])
def test_near_links_of_hubs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    prints = sorted({0, *(1 << rng.randint(0, 63) for _ in range(30)), *(1 << rng.randint(0, 63) | 1 << rng.randint(0, 63) for _ in range(60))})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = {tuple(sorted(r)) for r in simhash.near_links(spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, rep long"))[0].collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in links)
    root = list(range(len(prints)))
    for _ in prints:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root) == {0}


def brute_removed(texts, length=400):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("index_bytes", [1_000_000, 300, 40])  # the second takes every shared anchor down to whole strings
def test_repeated_passages(docs, none, rows, monkeypatch, index_bytes):
    monkeypatch.setattr(substrings, "INDEX_SYMBOLS", index_bytes)
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for (i, *_), t, gone in zip(rows, texts, brute_removed(texts)):
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want.append((i if i is not None else -1, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    got = [(r.row.doc_id if r.row.doc_id is not None else -1, *r["__r"][:4]) for r in substrings.remove_repeats(docs, ["doc_id"], True).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 1000
    if index_bytes == 1_000_000:
        assert substrings.remove_repeats(none, ["doc_id"], True).count() == 0
        cut = substrings.deduplicate_text(docs)
        assert cut.columns == docs.columns and cut.where("text IS NULL").count() == 1


def brute_words(texts, length=51):
    """Words of each text in repeated passages, and the texts without them."""
    words = [t.split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    gone = [{j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)} for w in words]
    return [len(g) for g in gone], [b" ".join(x for j, x in enumerate(w) if j not in g) for w, g in zip(words, gone)]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_repeated_passages_of_words(docs, none, rows, monkeypatch, most):
    monkeypatch.setattr(substrings, "INDEX_SYMBOLS", most)
    counts, left = brute_words([(t or "").encode() for _, t, *_ in rows])
    got = substrings.remove_repeats(docs, ["doc_id"], True, also=substrings.WORDS).collect()
    assert Counter((r.row.doc_id, r["__r"].n_also) for r in got) == Counter((i, n) for (i, *_), n in zip(rows, counts))
    assert sum(counts) > 300
    if most == 1_000_000:
        cut = substrings.deduplicate_text(docs, p=substrings.WORDS)
        assert Counter((r.doc_id, b" ".join((r.text or "").encode().split())) for r in cut.collect()) == Counter((i, x) for (i, *_), x in zip(rows, left))
        assert substrings.deduplicate_text(none, p=substrings.WORDS).count() == 0


def test_decontaminate(spark, docs, none, rows):
    item = " ".join(rows[3][1].split()[30:70])
    benchmark = spark.createDataFrame([(5, item), (6, None), (7, "not there at all in any text")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(3, 5), (4, 5), (5, 5)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()} == {i for i, *_ in rows} - {3, 4, 5}
    assert decontaminate.contaminated(none, benchmark).count() == decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_bpe_table(docs, none, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocab_path())
    want = Counter((i, *[len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()]) for i, t, *_ in rows for e in [library.encode(t or "", add_special_tokens=False)])
    assert Counter(map(tuple, bpe.encode_documents(docs, with_ids=False).collect())) == want
    assert bpe.encode_documents(none).count() == 0


@pytest.mark.parametrize(("block_ids", "group"), [(7, 3), (64, 2), (1 << 15, 1024)])
def test_token_counts(docs, none, rows, monkeypatch, block_ids, group):
    monkeypatch.setattr(tokencount, "GROUP_BLOCKS", group)
    blocks, order = tokencount.write_token_blocks(docs, block_ids=block_ids)
    found = order.join(tokencount.document_lengths(blocks), ["file", "ordinal"])
    codec = bpe.encoder(bpe.vocab_path(), special=False)
    assert Counter((r.doc_id, r.n_tokens) for r in found.collect()) == Counter((i, len(codec.encode(t))) for i, t, *_ in rows)
    blocks, _ = tokencount.write_token_blocks(none)
    assert tokencount.document_lengths(blocks).count() == 0


def test_token_files(spark, tmp_path):
    import numpy as np

    np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = tokencount.read_token_files(spark, str(tmp_path), 4)
    assert sorted((r.ordinal, r.n_tokens) for r in tokencount.document_lengths(blocks, 9).collect()) == [(0, 2), (1, 0), (2, 5), (3, 1)]


def test_licenses(spark, docs, none):
    df = spark.createDataFrame([(1, "x. Licensed under CC BY-NC 4.0.\ny"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.start_char, r.end_char) for r in licenses.license_scan(df).collect()] == [(1, "CC-BY-NC-4.0", 3, 31)]
    assert licenses.license_scan(docs).count() == licenses.license_scan(none).count() == 0


def test_language_model(docs, none, rows):
    def tokens(t):
        return [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = count.total(), len(count)
    want = Counter((i, held(i), len(x), sum(w in count for w in x), n, round(sum(log10((count[w] + 1) / (n + v + 1)) for w in x), 6)) for i, t, *_ in rows for x in [tokens(t)])
    got = lm.score_documents(docs, lm.LmParams(block_bytes=3000)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(none).count() == 0


def slow_scores(rows, p):
    """Each row's score by the definition: one token, feature and class at a time."""
    from math import exp, log

    docs = [[w for w in (t or "").encode().lower().split()] + [b"\n"] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % p.modulus == p.held_out for i, *_ in rows]
    h64 = lambda w: xxhash.xxh3_64_intdigest(w)
    signed = lambda w: h64(w) - (1 << 64) if h64(w) >> 63 else h64(w)
    count = Counter(w for d, x in zip(docs, held) if not x for w in d)
    top = [w for w, _ in sorted(((w, -c) for w, c in count.items() if w != b"\n"), key=lambda x: (x[1], signed(x[0])))[: p.top_words]]
    klass = lambda w: 0 if w == b"\n" else 1 + top.index(w) if w in top else 1 + p.top_words + zlib.crc32(w[-2:]) % (p.classes - p.top_words - 1)
    mix = lambda x: ((x * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40) % p.buckets

    def features(d):
        code = [(h64(w) >> 32) + 1 for w in d]
        for i in range(len(d)):
            one, two = code[i - 1] if i else 0, code[i - 2] if i > 1 else 0
            yield mix(one * 3), mix(one * 0x100000001B3 % (1 << 64) ^ two * 0x1000193 % (1 << 64)), mix(two * 7 + 5)

    K = range(p.classes)
    train = [(f, klass(w)) for d, x in zip(docs, held) if not x for f, w in zip(features(d), d)]
    seen, classes = Counter(), Counter(c for _, c in train)
    for f, c in train:
        seen.update((b, c) for b in f)
    used = {b for d in docs for f in features(d) for b in f}
    prior = [(classes[c] + 1) / (len(train) + p.classes) for c in K]
    whole = {b: sum(seen[b, c] for c in K) for b in used}
    weight = {(b, c): (log((seen[b, c] + 20 * prior[c]) / (whole[b] + 20)) - log(prior[c])) / 3 for b in used for c in K}
    bias = [log(x) for x in prior]
    logits = lambda f: [bias[c] + sum(weight[b, c] for b in f) for c in K]
    for _ in range(p.rounds):
        want, want_class = Counter(), Counter()
        for f, _ in train:
            e = [exp(x) for x in logits(f)]
            for c in K:
                want_class[c] += e[c] / sum(e)
                for b in f:
                    want[b, c] += e[c] / sum(e)
        step = lambda o, w: max(-1, min(1, (o - w) / (w + 10))) / 3
        weight = {k: v + step(seen[k], want[k]) for k, v in weight.items()}
        bias = [v + step(classes[c], want_class[c]) for c, v in enumerate(bias)]
    n, v = Counter(), Counter()
    for w, c in count.items():
        n[klass(w)] += c
        v[klass(w)] += 1
    out = []
    for d in docs:
        total = 0.0
        for f, w in zip(features(d), d):
            z, k = logits(f), klass(w)
            total += z[k] - log(sum(map(exp, z))) + log((count[w] + 1) / (n[k] + v[k] + 1))
        out.append(total / log(10))
    return out


def test_language_model_equals_definition(spark, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    p = lm.LmParams(block_bytes=3000, buckets=64, classes=8, top_words=3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score_documents(spark.createDataFrame(some, DOCS), p).collect())
    want = sorted((i if i is not None else -1, s) for (i, *_), s in zip(some, slow_scores(some, p)))
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-4)


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
def test_model_beats_word_frequency_on_held_out_text(spark):
    got = [r for r in lm.op2_lm_score(spark, str(SF)).collect() if r.held_out]
    print(sum(r.score for r in got) / sum(r.base_score for r in got))
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)  # both negative


def test_chat_events(spark):
    log = [
        ("c", 1, "message", 0, "user", "hi"), ("c", 2, "delta", 1, "assistant", "one"), ("c", 3, "delta", 1, None, " two"), ("c", 4, "message", 2, "user", "no"),
        ("c", 5, "regenerate", 1, "assistant", None), ("c", 6, "delta", 1, "assistant", "better"), ("c", 7, "edit", 0, "user", "hello"), (None, 1, "message", 0, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq long, kind string, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {("c", 0): ("user", "hello"), ("c", 1): ("assistant", "better"), (None, 0): (None, "")}


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = [*chat.CONTROLS, "\\", "<", "[", "/", "é", "x", "\n", "<\\s>", "[\\INST]"]
    said = [(i // 3, i % 3, rng.choice(["user", "assistant", "system", "tool<s>", "", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for i in range(90)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    for c in range(30):
        mine = [x for x in said if x[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(r or "", t) for _, _, r, t in mine]
        assert back[c].loss_text == "".join(t for _, _, r, t in mine if r == "assistant")
    assert chat.render(df.where("false")).count() == 0


def test_urls(spark):
    pages = [(1, "HTTP://WWW.Example.COM/en/1?x"), (2, "http://a.example.com/en/2#y"), (3, "x://b.net/es/3"), (4, "x://b.org"), (5, None), (6, "no scheme"), (7, "a://b.com"), (8, "u://q.com/z://w.net/es/"), (1, "HTTP://WWW.Example.COM/en/1?x")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/2", "example.com/en/", "block"), 3: ("b.net", "/es/3", "net/es/", "block"),
        4: ("b.org", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b.com", "", None, "allow"), 8: ("q.com", "/z://w.net/es/", "com/", "allow"),
    }
    assert urls.url_filter(df).count() == 9 and urls.url_filter(df.where("false")).count() == 0
    # a branch without labels resembles no labelled sibling: it has the prior, which allows
    mixed = [(i, f"x://h.net/{'es' if i % 10 else 'ok'}/p{i}") for i in range(200)] + [(900, "x://h.net/zz/p9")]
    assert {r.verdict for r in urls.url_filter(spark.createDataFrame(mixed, "page_id long, url string")).where("page_id = 900").collect()} == {"allow"}


def test_url_branches_are_judged_apart_and_like_siblings_together(spark):
    rules = tuple(("h.net", f"/{top}/{leaf}/x", verdict) for top in ("bad", "bad2") for leaf in "abc" for verdict in ("block",)) + (("h.net", "/good/a/x", "allow"),)
    pages, n = [], 0
    for path, count in (("/bad/a/x", 40), ("/bad/b/x", 1), ("/bad2/c/x", 1), ("/good/a/x", 40)):
        pages += [(n := n + 1, f"x://h.net{path}{i}") for i in range(count)]
    asked = {1001: "/bad/a/y7", 1002: "/good/a/y7", 1003: "/bad/none/y", 1004: "/deep/a/b/c/d/e", 1005: "/deep/a/b/c/d/f"}
    pages += [(i, f"x://h.net{path}") for i, path in asked.items()]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert {i: got[i].verdict for i in asked} == {1001: "block", 1002: "allow", 1003: "allow", 1004: "allow", 1005: "allow"}
    assert got[1004].template == "/deep/a/b/c/d/e" and got[1005].template == "/deep/a/b/c/d/f"


def test_extra_columns_with_clashing_names(spark, docs, rows):
    """Names that operators use inside or return, and a name with a dot, change nothing and are carried."""
    names = "g_lang g_source lo_symbols hi_repeats __q __failed __kept c0 c5 n_words kept fp rep class fingerprint component_id __gone row ranges __r start len words counts score code a.b kind place item_id".split()
    crowded = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    plain = docs.columns
    same = lambda f: Counter(map(repr, f(docs).collect())) == Counter(map(repr, f(crowded).collect()))
    assert same(lambda d: quality.judge(d, ["doc_id"]))
    assert same(simhash.near_duplicates)
    assert same(lambda d: substrings.remove_repeats(d, ["doc_id"], True))
    assert same(lambda d: bpe.encode_documents(d, with_ids=False)) and same(licenses.license_scan)
    benchmark = spark.createDataFrame([(5, " ".join(rows[3][1].split()[30:70]))], "item_id long, text string")
    stages = [quality.quality_filter, neardup.keep_one_alike, substrings.deduplicate_text, lambda d: decontaminate.drop_contaminated(d, benchmark)]
    for stage in stages:
        out = stage(crowded)
        assert out.columns == crowded.columns
        got = out.toDF(*[f"x{i}" for i in range(len(out.columns))]).collect()
        assert got and all(list(r)[len(plain):] == list(range(len(names))) for r in got)
        assert Counter(repr(tuple(r)[: len(plain)]) for r in got) == Counter(repr(tuple(r)) for r in stage(docs).collect())


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    mine, theirs = catalog.QUERIES[name](spark, str(SF)).toPandas(), con.sql(catalog.ORACLES[name]).df()
    names = sorted(theirs.columns)
    assert sorted(mine.columns) == names
    key = lambda d: sorted(map(str, d[names].astype(object).where(d[names].notna(), None).itertuples(index=False, name=None)))
    assert key(mine) == key(theirs)


def test_pipeline_stages(spark, rows, tmp_path):
    df = spark.createDataFrame([r[:5] for r in rows if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(rows[15][1].split()[5:45])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {i: t for i, t, *_ in rows if i is not None and t and len(t.split()) >= 10}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs, _ = common.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == before.columns, name
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= set(kept) and 1 not in ids and 15 not in ids and {0, 3, 11, 12, 13, 14} <= ids
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    codec = bpe.encoder(bpe.vocab_path())
    assert all(list(r.ids) == codec.encode(texts[r.doc_id]) for r in out)
    assert "".join(texts[3].split()) != "".join(rows[3][1].split())  # a passage went
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
