"""Operators' cores against brute force, without Spark."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from gristmill.llm import bpe, decontaminate, licenses, quality, simhash, substrings


def test_text_features():
    assert quality.text_features(None) == quality.text_features("") == (0, 0, 0, 0, 0, 0)
    text = "a b c d e f a b c d e\n\nx é\nx é\n$$ | <"
    n, chars, symbols, dup, repeated, lines = quality.text_features(text)
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    assert (n, chars, symbols, dup, repeated, lines) == (len(words), sum(map(len, words)), 4, 1, len(covered), 4)
    assert quality.text_features("a\x85b\x1cc")[0] == 1  # not white space here


def test_fingerprint():
    def slow(text):
        words = [w for w in text.lower().encode().split()]
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        out = 0
        for bit in range(64):
            if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
                out |= 1 << bit
        return out

    for text in ("", " \n", "One", "one two", "A b c d e a b c", "x " * 500):
        assert simhash.fingerprint(text) == slow(text)
    assert simhash.fingerprint(None) == 0


def test_bpe_equals_library():
    codec, library = bpe.encoder(bpe.vocab_path()), Tokenizer.from_file(bpe.vocab_path())
    rng, letters = random.Random(5), [*"ab 's\n\t  é!?1§ß\xa0\u3000\x85x'\r\x1c", "<|endoftext|>", " the", "'re", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    assert codec.encode(None) == [] and codec.encode("a" * 5000) == library.encode("a" * 5000).ids
    assert bpe.encoder(bpe.vocab_path(), special=False).encode("<|endoftext|>") != [50256]


@pytest.mark.parametrize("length", [4, 7, 12])
def test_repeats(length):
    rng = random.Random(length)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh"])
        base = bytes(rng.choice(letters) for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 50)
            texts.append(base[a : a + rng.randint(0, 40)] + bytes(rng.choice(letters) for _ in range(rng.randint(0, 15))))
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
        as_bytes = [np.frombuffer(t, np.uint8) for t in texts]
        as_words = [substrings.symbols_of(b" ".join(bytes([x]) for x in t), True) for t in texts]
        for symbols in (as_bytes, as_words):
            got = [[i for a, n in ranges for i in range(a, a + n)] for ranges in substrings.repeated_starts(symbols, length)]
            assert got == want
        for key in (length // 2 + 1, length):
            for symbols in (as_bytes, as_words):
                seen, starts = {}, Counter()
                for i, s, w, h, _ in zip(*substrings.AnchorRuns(key, length).runs(symbols)):
                    for at in range(s, s + w):
                        starts[i, at] += 1
                        assert seen.setdefault(texts[i][at : at + length], h) == h
                assert starts.total() == count.total() and set(starts.values()) <= {1}


def test_index_is_run_compressed():
    index = substrings.RunLengthIndex([np.frombuffer(b"abcdefgh" * 40, np.uint8)] * 5)
    assert index.run_lengths.sum() == index.n and len(index.symbols) < index.n / 10


def test_words_of_long_texts(monkeypatch):
    raw = " ".join(f"wört{i}\n" for i in range(300)).encode() + b"\x85\t" + b"x" * 90
    whole = substrings.symbols_of(raw, True)
    monkeypatch.setattr(substrings, "PIECE", 64)
    assert (substrings.symbols_of(raw, True) == whole).all() and len(whole) == len(raw.split())
    assert [raw[a:b] for a, b in substrings.word_bytes(raw, [(0, 1), (2, 4)])] == ["wört0".encode(), "wört2\n wört3".encode()]
    assert substrings.word_bytes(raw, []) == [] and len(substrings.symbols_of(b"", True)) == 0


def test_cover():
    assert substrings.cover([(5, 5), (0, 3), (3, 2), (20, 10)], 25) == [(0, 10), (20, 25)]


ITEM = " ".join(f"w{i}" for i in range(30))


def test_benchmark_search():
    index = decontaminate.BenchmarkIndex([(1, ITEM), (2, "Tiny, item!"), (3, None), (4, "")])
    words = ITEM.split()
    assert index.search(f"pad pad {ITEM.upper()}. pad") == [(1, 1.0, 2, 30, index.search(f"pad pad {ITEM}. pad")[0][4])]
    assert index.search(None) == index.search("") == index.search("pad " * 100) == []
    assert [x[0] for x in index.search("a tiny item b")] == [2]
    near = [*words[:-2], "z", "z"]
    assert index.search(" ".join(near))[0][1] == pytest.approx(24 / 28)
    assert index.search(" ".join([*words[:10], "z", *words[11:]])) == []  # five of 26 shingles differ
    assert index.search(" ".join(words[:27]))[0][1] == pytest.approx(23 / 26)  # shorter than the item


def test_benchmark_search_equals_brute_force():
    rng = random.Random(9)
    letters = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(6, 25)))) for i in range(12)]
    index = decontaminate.BenchmarkIndex(items)
    for _ in range(40):
        doc = [rng.choice(letters) for _ in range(40)]
        _, text = rng.choice(items)
        inner = text.split()
        for _ in range(rng.randint(0, 2)):
            inner[rng.randint(0, len(inner) - 1)] = "z"
        doc[10:10] = inner
        want = {}
        for i, n, size, bag in index.items:
            for a in range(max(1, len(doc) - n + 1)):
                s = decontaminate.bag_similarity(Counter(decontaminate.shingles([w.encode() for w in doc[a : a + n]], size)), bag)
                if s >= 0.8:
                    want[i] = max(want.get(i, 0), s)
        assert {i: s for i, s, *_ in index.search(" ".join(doc))} == pytest.approx(want)


def test_license_rules():
    known = licenses._known(licenses.SENTENCES)
    full = "\n".join([licenses.SENTENCES["mit-1"], "", licenses.SENTENCES["mit-2"].upper(), "Something else.", licenses.SENTENCES["mit-3"]])
    scan = lambda t: [(x[0], x[1]) for x in licenses.scan_text(t, known, licenses.RULES, 2)]
    assert scan(full) == [("MIT", "mit-full")]
    assert scan(f"Intro. {licenses.SENTENCES['gpl3-notice']} Rest") == [("GPL-3.0-only", "gpl3-notice")]
    assert scan("Released under the MIT License. Released under the MIT License.") == [("MIT", "mit-notice")] * 2
    assert scan(None) == scan("") == scan("The MIT of things.") == []


def test_every_license_sentence_is_found():
    known = licenses._known(licenses.SENTENCES)
    for name, sentence in licenses.SENTENCES.items():
        text = f"Vor. {sentence}\nNach."
        found = {n for n, s in [(known[0].get(licenses.normalise(text[a:b])), 0) for a, b in licenses.sentences_of(text)]}
        assert name in found


def test_class_probabilities_sum_to_one():
    from gristmill.llm import lm

    rng = np.random.default_rng(0)
    logits, _, norm = lm.class_scores(rng.normal(size=(16, 8)).astype(np.float32), np.zeros(8, np.float32), rng.integers(0, 16, (3, 50)).astype(np.uint16))
    assert np.allclose((np.exp(logits) / norm[:, None]).sum(axis=1), 1, atol=1e-5)
