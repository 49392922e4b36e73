"""Benchmark decontamination by SimHash windows (operator 3).

Documents are searched with windows as long as each benchmark item. A window within the wanted
similarity of an item shares most of its five-word shingles, so only windows over a shingle of
the benchmark are fingerprinted; windows slide by one word over all of them. The 64-bit SimHash
of a window's shingle bag then goes through a multi-index of four 16-bit blocks. For each item
the index admits every fingerprint that a similar window can have: the bag may differ by at most
a quarter of the item's weight, so bits whose margin is larger cannot flip, and each block table
lists the item under all block values that agree on those bits. Candidates of all four blocks
are verified by exact similarity of the shingle bags, the sum of smaller weights over the sum of
larger ones, a shingle's weight being how often it occurs.

The benchmark is read in blocks of BLOCK_ITEMS items, each a bounded index that goes to every
task; documents are never moved.

Defined cases: null and empty texts and items match nothing; items under five words use one
shingle of all their words; a document shorter than an item is one window; case and ASCII
punctuation do not count; repeated rows give repeated results; ties go to the earliest window;
empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_rows

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_ITEMS = 2048
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, n_windows long"
_SPACED = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def shingles(words: list[bytes], size: int):
    return zip(*(words[i:] for i in range(size)))


def _bits(grams) -> np.ndarray:
    """A row of 64 plus or minus ones for each shingle."""
    raw = b"".join(xxhash.xxh64_digest(b" ".join(g)) for g in grams)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as four 16-bit blocks a row."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.uint16)


class BenchmarkIndex:
    """Multi-index over the fingerprints of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY):
        self.similarity = similarity
        #: By shingle size: where each shingle occurs, as item places.
        self.where: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.items: list[tuple[int, int, int, Counter]] = []  # id, words, shingle size, bag
        kept = []
        for item_id, text in items:
            words = normal_words(text)
            if words:
                size = min(SHINGLE, len(words))
                bag = Counter(shingles(words, size))
                for gram in bag:
                    self.where[size][gram].append(len(self.items))
                self.items.append((item_id, len(words), size, bag))
                kept.append(list(shingles(words, size)))
        n = len(self.items)
        self.sizes: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(-(-n // 64), np.uint64))
        self.blocks = np.zeros((4, 1 << 16, -(-n // 64)), np.uint64)
        values = np.arange(1 << 16, dtype=np.uint16)
        for i, ((_, n_words, size, _), grams) in enumerate(zip(self.items, kept)):
            sums = _bits(grams).sum(axis=0, dtype=np.int64)[None, :]
            own, fixed = _packed(sums)[0], _packed((np.abs(sums) > (1 / similarity - 1) * len(grams)).astype(np.int8))[0]
            bit = np.uint64(1) << np.uint64(i % 64)
            for b in range(4):
                self.blocks[b, ((values ^ own[b]) & fixed[b]) == 0, i // 64] |= bit
            self.sizes[n_words, size][i // 64] |= bit

    def candidates(self, fingerprints: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
        """(row, item place) of all fingerprints that an allowed item admits."""
        hits = self.blocks[0, fingerprints[:, 0]] & allowed
        for b in range(1, 4):
            hits &= self.blocks[b, fingerprints[:, b]]
        out = []
        for row, word in zip(*np.nonzero(hits)):
            left = int(hits[row, word])
            while left:
                low = left & -left
                out.append((int(row), int(word) * 64 + low.bit_length() - 1))
                left ^= low
        return out

    def search(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, start word, words, windows) of every item found in a text; the best window of each."""
        words = normal_words(text)
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, where in self.where.items():
            if len(words) < size or where.keys().isdisjoint(shingles(words, size)):
                continue
            grams = list(shingles(words, size))
            ranges: dict[int, set[int]] = defaultdict(set)
            for p, gram in enumerate(grams):
                for i in where.get(gram, ()):
                    n_words = self.items[i][1]
                    ranges[n_words].update(range(max(0, p - n_words + size), max(0, min(p, len(words) - n_words)) + 1))
            for n_words, starts in ranges.items():
                allowed = self.sizes.get((n_words, size))
                if allowed is None:
                    continue
                span = min(n_words, len(words)) - size + 1
                order = np.array(sorted(starts))
                # stretches of neighbouring starts share one cumulative sum
                for part in np.split(order, np.flatnonzero(np.diff(order) > 1) + 1):
                    for at in range(0, len(part), 4096):
                        some = part[at : at + 4096]
                        a, b = int(some[0]), int(some[-1]) + span
                        sums = np.zeros((b - a + 1, 64), np.int32)
                        np.cumsum(_bits(grams[a:b]), axis=0, out=sums[1:])
                        prints = _packed(sums[some - a + span] - sums[some - a])
                        for row, i in self.candidates(prints, allowed):
                            start = int(some[row])
                            score = bag_similarity(Counter(grams[start : start + span]), self.items[i][3])
                            if score >= self.similarity:
                                old = best.get(i, (0.0, 0, 0, 0))
                                new = (score, start, min(n_words, len(words))) if score > old[0] else old[:3]
                                best[i] = (*new, old[3] + 1)
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]


def bag_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[x]) for x, n in a.items())
    return common / (a.total() + b.total() - common) if a or b else 0.0


_built: dict[int, BenchmarkIndex] = {}


def _index(items: tuple) -> BenchmarkIndex:
    """The process's index of a block of items."""
    key = hash(items)
    if key not in _built:
        _built.clear()
        _built[key] = BenchmarkIndex(list(items))
    return _built[key]


def _item_blocks(benchmark: DataFrame) -> list[tuple]:
    n = benchmark.count()
    blocks = -(-n // BLOCK_ITEMS)
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    return [tuple((r.item_id, r.text) for r in benchmark.where(own == b).select("item_id", "text").orderBy("item_id", "text").collect()) for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it."""
    found = None
    for items in _item_blocks(benchmark):

        def make(items=items):
            index = _index(items)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

            def step(batch: pa.RecordBatch):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(i, *x) for i, text in zip(ids, texts) for x in index.search(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

            return step

        part = map_rows(docs.select("doc_id", "text"), SCHEMA, make)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item is found."""
    names = docs.columns
    at = names.index(text)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow functions take no names with dots
    for items in _item_blocks(benchmark):

        def make(items=items):
            index = _index(items)

            def step(batch: pa.RecordBatch):
                yield batch.filter(pa.array([not index.search(x) for x in batch.column(at).to_pylist()], pa.bool_()))

            return step

        docs = map_rows(docs, docs.schema, make)
    return docs.toDF(*names)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
