"""Cross-tokenizer alignment against plain loops over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import alignment
from gristmill.llm.bpe import byte_alphabet

WORDS = "Some words of a text, which repeats; naïve café 12345 über-long "
TEXTS = [
    None, "", " ", "  ", "a", "Hello  world\n new\t x ", " lead", "trail ", "é ﬁ ２ é", "a▁b", "<s> </s> <0x41> <|endoftext|> <unk>", "\xa0x　y z", "a\r\nb \n c",
    "𝔘nicode 😀 text", "tab\t tab", "x" * 300, "word " * 50, "The same text", "The same text", "\x1c \x1d a", WORDS * 40, "नमस्ते दुनिया", "don't can't  we'll", "﻿bom here",
]


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of (doc_id, text), whole texts encoded by the libraries."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, docs = byte_alphabet(), []
    for _, text in rows:
        a_ids, b_ids, a, b = [], [], [], []
        if text:
            a_ids = a_model.encode(" " + text, add_special_tokens=False).ids
            b_ids = b_model.encode(text, num_threads=1)
            a = [bytes(letters[x] for x in a_model.id_to_token(i)) for i in a_ids]
            b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
            if not b"".join(a) == b"".join(b) == (" " + text).encode():
                a_ids, b_ids, a, b = [], [], [], []
        a_end, b_end = [sum(map(len, a[: i + 1])) for i in range(len(a))], [sum(map(len, b[: i + 1])) for i in range(len(b))]
        links = [(x, y) for x, m, n in zip(a_ids, a, a_end) for y, k, e in zip(b_ids, b, b_end) if max(n - len(m), e - len(k)) < min(n, e)]
        cuts, groups, low = sorted(set(a_end) & set(b_end)), [], 0
        for high in cuts:
            side = lambda ids, ends: ",".join(str(x) for x, e in zip(ids, ends) if low < e <= high)  # noqa: B023, E731
            groups.append(f"{side(a_ids, a_end)}|{side(b_ids, b_end)}")
            low = high
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(pair for d in docs for pair in set(d[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted((i, na, nb, ng, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest) for (i, _), (na, nb, ng, links, digest) in zip(rows, docs))


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows, schema="doc_id long, text string"):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
        return sorted(map(tuple, alignment.op11_tokenizer_alignment(spark, str(tmp_path)).collect()))

    return store


def test_against_loops(stored):
    rows = list(enumerate(TEXTS))
    assert stored(rows) == brute(rows)


def test_shuffled_counts_agree(stored, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_NUMBERS", 0)
    rows = list(enumerate(TEXTS))
    assert stored(rows) == brute(rows)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 1500]
    # counts cover all documents, so only columns of a document's own are compared here
    mine = {r.doc_id: tuple(r)[:5] + (r.groups_sha256,) for r in alignment.op11_tokenizer_alignment(spark, sf).collect()}
    assert len(mine) == 200 and all(mine[x[0]] == x[:5] + x[7:] for x in brute(rows))


def test_empty_table_nulls_and_other_columns(stored):
    assert stored([], "doc_id long, text string") == []


def test_repeated_rows_null_ids_and_clashing_names(spark, tmp_path):
    rows = [(1, "a text", "x", 1), (1, "a text", "y", 2), (2, None, "z", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, a_ids string, `row` long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, alignment.op11_tokenizer_alignment(spark, str(tmp_path)).collect()))
    assert got == brute([(1, "a text"), (1, "a text"), (2, None)])
    named = spark.createDataFrame([(None, "b c", 5)], "doc_id long, text string, t long")
    assert alignment.align(named, "text", ["doc_id", "t"]).select("c0", "c1").first() == (None, 5)


def test_very_long_text(spark):
    text = "".join(f"{WORDS}{i} " for i in range(30_000)) + "y" * 20_000  # about 2 MB, one word of it long
    r = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", ["doc_id"]).selectExpr("n_a", "n_b", "n_groups AS g", "size(links) AS l").first()
    assert r.n_a > 400_000 and r.l == r.n_a + r.n_b - r.g


def test_groups_and_links_are_real(spark):
    r = alignment.align(spark.createDataFrame([("naïve café",)], "text string"), "text", []).first()
    a, b = (",".join(g.split("|")[k] for g in r.groups.split(";")).split(",") for k in (0, 1))
    assert len(a) == r.n_a and len(b) == r.n_b
    assert {str(x >> 32) for x in r.links} == set(a) and {str(x & 0xFFFFFFFF) for x in r.links} == set(b)


def test_small_blocks_and_a_full_cache_change_nothing(stored, monkeypatch):
    rows = list(enumerate(TEXTS))
    both = alignment.pair_tokenizer(alignment.vocab_path(alignment.VOCAB), alignment.vocab_path(alignment.PIECES))
    monkeypatch.setattr(alignment, "CACHE", 3)
    texts = [t for _, t in rows]
    whole, fragments, counts = both.block(texts)
    for i, t in enumerate(texts):
        words, own, n = both.block([t])
        assert [own[w] for w in words[0]] == [fragments[w] for w in whole[i]] and (n[0] == counts[i]).all()
