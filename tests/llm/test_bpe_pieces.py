import random

import pytest

bpe_module = pytest.importorskip("gristmill.llm.bpe")


@pytest.fixture(scope="module")
def bpe():
    return bpe_module.ForcedBoundaryBpe(bpe_module.vocab_path())


def test_pieces_are_cut_at_every_forced_pair_and_at_no_other(bpe):
    held = {pair for token in bpe.token_bytes[:-1] for pair in zip(token, token[1:])}
    rng = random.Random(3)
    cuts = 0
    for _ in range(300):
        word = bytes(rng.randrange(256) for _ in range(rng.randint(1, 30)))
        pieces = bpe.pieces(word)
        assert b"".join(pieces) == word
        assert all((a[-1], b[0]) not in held for a, b in zip(pieces, pieces[1:]))
        assert all(pair in held for piece in pieces for pair in zip(piece, piece[1:]))
        cuts += len(pieces) - 1
    assert cuts > 1000


def test_cut_words_encode_as_the_library_encodes_whole_texts(bpe):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe_module.vocab_path())
    rng = random.Random(4)
    letters = "abcXYZ 019 \n\t'sdm.,;é漢字🙂\x1c\x85\xa0　٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["ab9" * 20000, "漢🙂" * 5000, "", " ", "x" * 10000]
    for text in texts:
        assert bpe.encode(text) == whole.encode(text, add_special_tokens=False).ids
        assert bpe.decode(bpe.encode(text)) == text
