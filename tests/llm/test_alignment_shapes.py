"""Fragments are encoded together, and equal ends are aligned once for a block."""

import random
import re

from gristmill.llm import alignment


def test_a_block_spans_batches_and_holds_each_shape_once(spark):
    docs = spark.createDataFrame([(i, f"word{i} anything thlyouble{i}") for i in range(1200)], "doc_id long, text string").coalesce(1)
    r = alignment.tokenize_pairs(docs, "text", ["doc_id"]).selectExpr("size(docs) AS d", "size(fragments) AS f", "size(shapes) AS s", "size(array_distinct(shapes)) AS u").collect()
    assert [(x.d, x.f) for x in r] == [(1200, 2401)] and r[0].s == r[0].u < 300


def test_together_is_as_alone(monkeypatch):
    both = alignment.pair_tokenizer(alignment.vocab_path(alignment.VOCAB), alignment.vocab_path(alignment.PIECES))
    monkeypatch.setattr(alignment, "TOGETHER", 70)
    draw = random.Random(3)
    parts = ["the", "ly", "ou", "É", "ß", "ñ", "12", "'s", ".", ",\n", "\t", "%%%", "<s>", "#", "Ż", "don't", "x" * 40, "नम", "▁", "\xa0", " ", "\x1c"]
    words = list(dict.fromkeys("".join(draw.choices(parts, k=draw.randrange(1, 6))) for _ in range(1500)))
    found, spelt = both.learn(words)
    first, shapes = found.shapes()
    for i, x in enumerate(words):
        alone, (a_ids, a_ends, b_ids, b_ends) = both._alone(x), found[i]
        want = [alignment.np.array(y, "<i4").tobytes() for y in alone or ([], [])]
        assert [a_ids, b_ids] == want and spelt[i] == (alone is not None), x
        assert (a_ends, b_ends) == found[first[shapes[i]]][1::2]


def test_odd_fragments_are_found_by_one_search():
    rule = re.compile(r"[!-~\xc0-ɏ](?:[\t\n!-~\xc0-ɏ]*[!-~\xc0-ɏ])?").fullmatch
    both = alignment.pair_tokenizer(alignment.vocab_path(alignment.VOCAB), alignment.vocab_path(alignment.PIECES))
    draw = random.Random(5)
    texts = ["".join(draw.choices(["a", "é", "नम", " ", "\n", "\t", "\xa0", "\x1c", "x y"], k=draw.randrange(9))) for _ in range(3000)]
    for text in texts:
        fragments = both.fragments(text)
        assert alignment.plain(fragments).tolist() == [rule(x) is not None for x in fragments], repr(text)
    assert alignment.plain([]).tolist() == [] and alignment.plain(["", "a", "", " ", "b"]).tolist() == [False, True, False, False, True]


def test_a_block_holds_each_token_once(spark):
    docs = spark.createDataFrame([(i, f"word{i} anything thlyouble{i} é{i}") for i in range(600)], "doc_id long, text string").coalesce(1)
    r = alignment.tokenize_pairs(docs, "text", ["doc_id"]).first()
    assert r.names[0] == "," and len(r.names) == len(r.halves) == len(set(r.names)) and set(r.names[1:]) == {r.names[x] for f in r.fragments for x in f.tokens[1:]}
    both = alignment.pair_tokenizer(alignment.vocab_path(alignment.VOCAB), alignment.vocab_path(alignment.PIECES))
    a, b = both._alone("anything")
    assert [f";{x}" for x in a] + [f"|{x}" for x in b] in [[r.names[x] for x in f.tokens[1:]] for f in r.fragments]
    assert all(h == (int(n[1:]) << 32 if n[0] == ";" else int(n[1:])) for n, h in list(zip(r.names, r.halves))[1:])


def test_groups_of_several_tokens_on_both_sides(spark):
    texts = [f"{x}{y}" for x in ("naïve", "नमस्ते", "thtionsh", "12345", "ＡＢ") for y in ("", "ouldn't", "😀é", "ﬁzz")]
    rows = alignment.align(spark.createDataFrame([(x,) for x in texts], "text string"), "text", ["text"]).collect()
    both = alignment.pair_tokenizer(alignment.vocab_path(alignment.VOCAB), alignment.vocab_path(alignment.PIECES))
    for r in rows:
        a, b = both._alone(r.c0) or ([], [])
        sides = [[g.split("|")[k] for g in r.groups.split(";")] if a else [] for k in (0, 1)]
        assert [",".join(x) for x in sides] == [",".join(map(str, x)) for x in (a, b)] and r.n_groups == len(sides[0])
    assert any("," in g.split("|")[0] and "," in g.split("|")[1] for r in rows for g in r.groups.split(";") if g)
