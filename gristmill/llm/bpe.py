"""BPE encoding and decoding by forced boundaries (operator 8).

Two neighbouring bytes that never stand side by side inside any vocabulary token can never be
joined by a merge: between them lies a certain cut. The table of such pairs is used twice.
Texts are first cut with one vectorised look-up at those forced pairs, a non-space and white
space, which are ends of pre-tokens whatever surrounds them (no pre-token of the pattern holds a
non-space followed by white space, and its look-ahead only looks from white space to the next
character, which stays in the same fragment). What lies between is split into pre-tokens, and
every pre-token is cut at all its forced pairs; the pieces are encoded independently, without a
pattern, and the ids concatenated. Repeated fragments come from a bounded cache.

Defined cases: null text is empty; empty text has no tokens; the special token's string is one
token where special is on, ordinary text otherwise; repeated rows give repeated results; an empty table gives no rows; very long texts and words
without a space are read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import map_rows

VOCAB = "byte_bpe_50k.json"
#: Entries of the fragment cache, and the longest fragment that it keeps.
CACHE, CACHED_LEN = 300_000, 64
#: The pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
_ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
#: Words of this length are cut by a vectorised look-up, shorter ones in a loop.
VECTOR = 64
_WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # special strings are split off before
        self.core = None
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]} if special else {}
        letters = byte_alphabet()
        self.letters = {ord(x): chr(b) for x, b in letters.items()}
        size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = bytes(map(letters.__getitem__, token))
        inside = np.zeros((256, 256), bool)
        for token in self.token_bytes:
            inside[list(token[:-1]), list(token[1:])] = True
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        vocab, before = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        by_id = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if by_id and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            import tiktoken  # merges rank as their ids: the faster encoder gives the same ids

            self.ranks = {token: i for i, token in enumerate(self.token_bytes) if token}
            self.core = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        for x in spec["added_tokens"]:
            self.token_bytes[x["id"]] = x["content"].encode()
        self.decimal = [str(i) for i in range(size)]
        right = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
        left = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0x80, 0xC0)])
        #: Pairs of bytes that no token holds side by side.
        self.forced = ~inside
        self.forced_flat = self.forced.tobytes()
        self.cuts = self.forced & left[:, None] & right[None, :]
        #: For texts with white space beyond ASCII, whose last byte is a continuation byte.
        self.ascii_cuts = self.cuts & (np.arange(256) < 0x80)[:, None]
        self.cache = _FragmentCache(self._fragment)

    def _fragment(self, fragment: bytes) -> tuple[int, ...]:
        text = fragment.decode("utf-8")
        if self.core is None:
            return tuple(self.model.encode(text, add_special_tokens=False).ids)
        if text.isascii():
            words = _ASCII_WORD.findall(fragment)
        else:
            words = [word.translate(self.letters).encode("latin-1") for word, _ in self.model.pre_tokenizer.pre_tokenize_str(text)]
        encode = self.core._core_bpe.encode_single_piece
        ids: list[int] = []
        for word in words:
            if word in self.ranks:
                ids.append(self.ranks[word])
            else:
                for piece in self.pieces(word):
                    ids += encode(piece)
        return tuple(ids)

    def whole_words(self, fragment: bytes) -> list[int]:
        """The ids of a fragment that begins and ends with a pre-token, special strings as plain text, without cuts inside words."""
        if self.core is None:
            return self.model.encode(fragment.decode("utf-8"), add_special_tokens=False).ids
        if fragment.isascii():
            words = _ASCII_WORD.findall(fragment)
        else:
            words = [word.translate(self.letters).encode("latin-1") for word, _ in self.model.pre_tokenizer.pre_tokenize_str(fragment.decode("utf-8"))]
        ids: list[int] = []
        for word in words:
            if word in self.ranks:
                ids.append(self.ranks[word])
            else:
                ids += self.core._core_bpe.encode_single_piece(word)
        return ids

    def pieces(self, word: bytes) -> list[bytes]:
        """A pre-token cut at every forced pair."""
        if len(word) < VECTOR:
            table = self.forced_flat
            ends = [i + 1 for i, (a, b) in enumerate(zip(word, word[1:])) if table[a << 8 | b]]
        else:
            view = np.frombuffer(word, np.uint8)
            ends = (np.flatnonzero(self.forced[view[:-1], view[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])] if ends else [word]

    def fragments(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if len(raw) < 2:
            return [raw] if raw else []
        view = np.frombuffer(raw, np.uint8)
        table = self.ascii_cuts if _WIDE_SPACE.search(text) else self.cuts
        ends = (np.flatnonzero(table[view[:-1], view[1:]]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        for string, i in self.special.items():
            if string in text:
                parts = [self.encode(x) for x in text.split(string)]
                return list(chain(parts[0], *([i, *x] for x in parts[1:])))
        return list(chain.from_iterable(map(self.cache.__getitem__, self.fragments(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _FragmentCache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> tuple[int, ...]:
        ids = self.encode(fragment)
        if len(fragment) <= CACHED_LEN:
            if len(self) >= CACHE:
                self.clear()
            self[fragment] = ids
        return ids


_loaded: dict[tuple[str, bool], ForcedBoundaryBpe] = {}


def encoder(path: str, special: bool = True) -> ForcedBoundaryBpe:
    """The process's encoder for a vocabulary file."""
    if (path, special) not in _loaded:
        _loaded[path, special] = ForcedBoundaryBpe(path, special)
    return _loaded[path, special]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless declined, ids and the decoded text of every row."""
    path = path or vocab_path()
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def make():
        bpe = encoder(path)

        def one(text: str | None):
            ids = bpe.encode(text)
            decoded = bpe.decode(ids)
            listed = ",".join(map(bpe.decimal.__getitem__, ids)).encode()
            out = len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            return (*out, ids, decoded) if with_ids else out

        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if with_ids else 3]
        names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]

        def step(batch: pa.RecordBatch):
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                rows = [one(x) for x in part.column(1).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

        return step

    return map_rows(docs.select(doc_id, text), schema, make)


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op8_bpe_codec": op8_bpe_codec}
ORACLES: dict[str, str] = {}
