"""Cross-tokenizer alignment by Spark's higher-order functions (operator 11).

One Python step turns texts into ids and byte ends of tokens under a byte-level vocabulary (A) and
under a piece vocabulary (B). Both tokenizers see a text in fragments cut before single spaces that
follow a non-space: no token of A holds white space after a non-space, and B is cut there only where
none of its pieces does. A block of documents holds each of its fragments once, and its documents
point to them; how tokens share bytes depends on their ends alone, so a block also holds each pair
of A's and B's ends once (a shape), which is aligned once for all fragments that have it.

All that follows is expressions over arrays. `array_intersect` of a shape's end arrays gives the
offsets where tokens of both end, which cut the tokens into groups (a fragment's end always does).
Both end arrays are merged by one sort; where A's token i comes in that order, less i, counts the B
tokens that end before it, so each A token has the run of B tokens that share bytes with it, which
`sequence` writes out as links. Fragments put their tokens into their shape's groups and links; of
each distinct token, a block holds the text in groups and the half of a link once. Steps
take time linear in the tokens, but for the sort. Counts of id
pairs over documents are a plain aggregate of the distinct pairs of each document, joined back.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text again
under both vocabularies, have no tokens: zeros and an empty digest. Strings of special tokens inside
texts are plain text. Repeated rows are documents of their own; null ids are carried; an empty table
gives no rows; very long texts are read whole, a block of their own; of equal counts all links are
best; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.arrays import let
from gristmill.llm.bpe import VOCAB, encoder, vocab_path
from gristmill.llm.common import BROADCAST_NUMBERS, bound_batches, column, materialize, small_enough

PIECES = "piece_bpe_32k.model"
#: Entries of the cache of fragments encoded alone, and the longest fragment that it keeps.
CACHE, CACHED_LEN = 300_000, 64
#: Characters of a block of documents, but for a longer text alone.
BLOCK_CHARS = 3_000_000
#: Fragments that are encoded as one text.
TOGETHER = 20_000
#: Ends of both sides below this are bits of one number.
MASKED = 32
#: Where joined fragments, each with a space before and after it, may not be encoded together: empty ones, white space at their ends or inside but line ends and tabs, and letters that some versions of Unicode do not know.
_ODD = re.compile(r"[^\t\n -~\xc0-\u024f]+|[\t\n](?= )| (?=[\t\n ])")
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
#: White space before a space, found from the space on, as few characters are one.
_UNEVEN = re.compile(r" (?<=\s )")


def plain(fragments: list[str]) -> np.ndarray:
    """Which fragments may be encoded together. They are searched as one text, so that only odd ones take a step each."""
    may = np.ones(len(fragments), bool)
    # a fragment's own space at its begin or end is two in a row, and the first of two belongs to the fragment that it begins
    found = np.fromiter((m.start() for m in _ODD.finditer(f" {' '.join(fragments)} ")), np.int64)
    if len(fragments) and len(found):
        begins = np.cumsum(np.fromiter(map(len, fragments), np.int64, len(fragments)) + 1)
        may[np.searchsorted(begins[:-1], found, side="right")] = False
    return may


class Fragments:
    """Fragments of a block: `ids`, A's and then B's of each, the place of each one's first id in `at`, `n_a`, `n_b`, and `ends` like `ids`; those that the tokens spell otherwise have none."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.ids, self.ends, self.n_a, self.n_b = ids, ends, n_a, n_b
        self.at = np.r_[0, np.cumsum(n_a + n_b)]

    def __len__(self) -> int:
        return len(self.n_a)

    def __getitem__(self, i: int) -> tuple[bytes, bytes, bytes, bytes]:
        """A's ids and ends and B's ids and ends, as little-endian bytes."""
        low, high = self.at[i], self.at[i + 1]
        mid = low + self.n_a[i]
        return self.ids[low:mid].tobytes(), self.ends[low:mid].tobytes(), self.ids[mid:high].tobytes(), self.ends[mid:high].tobytes()

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all ids of some fragments, one after the other, and how many each has."""
        sizes = self.at[which + 1] - self.at[which]
        return np.repeat(self.at[which] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()), sizes

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, shape): a fragment of each distinct pair of A's and B's ends, and which of them each fragment has; fragments of MASKED bytes or more are shapes of their own."""
        n = len(self)
        owner = np.repeat(np.arange(n), self.n_a + self.n_b)
        of_b = np.arange(len(self.ids)) - self.at[owner] >= self.n_a[owner]
        long = np.zeros(n, bool)
        long[owner[self.ends >= MASKED]] = True
        bits = np.left_shift(np.uint64(1), (np.where(long[owner], 0, self.ends) + MASKED * of_b).astype(np.uint64))
        # every end of a side is a bit of its own, so sums are unions; prefix sums wrap around, their differences do not
        total = np.r_[np.uint64(0), np.cumsum(bits, dtype=np.uint64)]
        mask = total[self.at[1:]] - total[self.at[:-1]]
        short, own = np.flatnonzero(~long), np.flatnonzero(long)
        _, first, inverse = np.unique(mask[short], return_index=True, return_inverse=True)
        shape = np.empty(n, np.int32)
        shape[short], shape[own] = inverse, len(first) + np.arange(len(own))
        return np.r_[short[first], own], shape


class PairTokenizer:
    """Both tokenizers. Fragments come without their leading space; of those that are encoded alone, a cache holds A's and B's ids, None where the tokens spell something else."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.cache: dict[str, tuple | None] = {}
        self.a = encoder(a_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        #: Whether B may be cut before a space too.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a.token_bytes, self.b_bytes))
        n_a, n_b = len(self.a_len), len(self.b_len)
        #: What stands between tokens of a side in a group, then of all A's and B's tokens the text in groups, with what begins or halves them, and the half of a link.
        self.names = pa.array([",", *(f";{i}" for i in range(n_a)), *(f"|{i}" for i in range(n_b))])
        self.halves = np.r_[0, np.arange(n_a, dtype=np.int64) << 32, np.arange(n_b)]

    def fragments(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        if text[0] != " " and text[-1] != " " and not _UNEVEN.search(text):
            return text.split(" ")
        return [x[1:] for x in _CUT.split(" " + text)]

    def _alone(self, fragment: str) -> tuple[list[int], list[int]] | None:
        """A's and B's ids of a fragment, None where they spell something else."""
        if fragment in self.cache:
            return self.cache[fragment]
        raw = b" " + fragment.encode("utf-8", "replace")
        a, b = self.a.whole_words(raw), self.b.encode(fragment, num_threads=1)
        value = (a, b) if b"".join(map(self.a.token_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)) else None
        if len(fragment) <= CACHED_LEN:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[fragment] = value
        return value

    def _together(self, fragments: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, counts of each fragment) of A, from one text of all fragments, which ends a token before each of its spaces, and of B; None where the tokens spell something else."""
        raw = b" " + " ".join(fragments).encode()
        a = np.frombuffer(self.a.core._core_bpe.encode_to_tiktoken_buffer(raw.decode(), set()), np.uint32).astype(np.int32)
        found = self.b.encode(fragments, num_threads=1)
        b = np.fromiter(chain.from_iterable(found), np.int32)
        if not b"".join(map(self.a.token_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            return None
        n_b = np.fromiter(map(len, found), np.int64, len(fragments))
        a_ends, last = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])[np.cumsum(n_b) - 1]
        upto = np.searchsorted(a_ends, last, side="right")
        size = np.fromiter(map(len, raw[1:].split(b" ")), np.int64, len(fragments)) + 1
        if not ((a_ends[upto - 1] == last).all() and (np.cumsum(size) == last).all()):
            return None
        return [(a, np.diff(np.r_[0, upto])), (b, n_b)]

    def learn(self, fragments: list[str]) -> tuple[Fragments, np.ndarray]:
        """All fragments encoded, and which are spelt."""
        n = len(fragments)
        together = plain(fragments) if self.cuts and self.a.core is not None else np.zeros(n, bool)
        spelt, groups = np.ones(n, bool), []
        where = np.flatnonzero(together)
        for begin in range(0, len(where), TOGETHER):
            part = where[begin : begin + TOGETHER]
            sides = self._together([fragments[i] for i in part.tolist()])
            if sides is None:
                together[part] = False
            else:
                groups.append((part, *sides))
        odd = np.flatnonzero(~together)
        found = [self._alone(fragments[i]) for i in odd.tolist()]
        spelt[odd] = [x is not None for x in found]
        each = [x or ([], []) for x in found]
        flat = [np.fromiter(chain.from_iterable(x[k] for x in each), np.int32) for k in (0, 1)]
        groups.append((odd, *((ids, np.fromiter((len(x[k]) for x in each), np.int64, len(odd))) for k, ids in enumerate(flat))))
        counts = np.zeros((2, n), np.int64)
        for part, *sides in groups:
            for k, (_, own) in enumerate(sides):
                counts[k, part] = own
        both = Fragments(np.zeros(int(counts.sum()), np.int32), np.zeros(int(counts.sum()), np.int32), *counts)
        for part, *sides in groups:
            for k, ((ids, own), lengths) in enumerate(zip(sides, (self.a_len, self.b_len))):
                ends, before = np.cumsum(lengths[ids]), np.cumsum(own) - own
                base = np.r_[0, ends][before]
                place = np.repeat(both.at[part] + (counts[0, part] if k else 0) - before, own) + np.arange(len(ids))
                both.ids[place], both.ends[place] = ids, ends - np.repeat(base, own)
        return both, spelt

    def tokens(self, found: Fragments) -> tuple[np.ndarray, np.ndarray]:
        """(used, at): rows of names and halves that the fragments use, row 0 first, and of each fragment's ids, with 0 before them, the place among those."""
        n, sizes = len(found), np.diff(found.at)
        place = np.repeat(np.arange(1, n + 1), sizes) + np.arange(len(found.ids))
        of_b = place - np.repeat(found.at[:-1] + np.arange(1, n + 1), sizes) >= np.repeat(found.n_a, sizes)
        row = found.ids + np.where(of_b, 1 + len(self.a_len), 1)
        there = np.zeros(len(self.halves), bool)
        there[0] = there[row] = True
        at = np.zeros(len(row) + n, np.int32)
        at[place] = (np.cumsum(there) - 1)[row]
        return np.flatnonzero(there), at

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], Fragments, np.ndarray]:
        """For texts taken together: each one's fragments as indexes, the distinct fragments, and (n_a, n_b) of each text; texts that are not spelt have none."""
        cut = list(map(self.fragments, texts))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        place: defaultdict[str, int] = defaultdict(count().__next__)
        words = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int32, int(sizes.sum()))
        found, spelt = self.learn(list(place))
        last = np.cumsum(sizes)
        summed = lambda x: np.diff(np.r_[0, np.cumsum(x[words])][np.r_[0, last]])
        whole = summed((~spelt).astype(np.int64)) == 0
        counts = np.stack([summed(found.n_a), summed(found.n_b)], axis=1) * whole[:, None]
        return [words[b - n : b] if ok else words[:0] for n, b, ok in zip(sizes.tolist(), last.tolist(), whole.tolist())], found, counts


_loaded: dict[tuple[str, str], PairTokenizer] = {}


def pair_tokenizer(a_path: str, b_path: str) -> PairTokenizer:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = PairTokenizer(a_path, b_path)
    return _loaded[a_path, b_path]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


def _one(values: pa.Array) -> pa.ListArray:
    """A row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def tokenize_pairs(docs: DataFrame, text: str, carry: list[str], a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Blocks of documents: `docs` (carry columns as c0, c1, ..., n_a, n_b, words), `fragments` (shape, tokens), which words point to, `shapes` (a_ends, b_ends), and `names` and `halves`, which tokens point to.

    A block holds each of its fragments once, 0, A's tokens and then B's, and each pair of ends and each token that they have once.
    """
    a_path, b_path = a_path or vocab_path(VOCAB), b_path or vocab_path(PIECES)
    named = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)], column(text).alias("t"))
    ints = T.ArrayType(T.IntegerType(), False)
    own = [named.schema[f"c{i}"] for i in range(len(carry))]
    doc = T.StructType([*own, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("words", ints)])
    fragment = T.StructType([T.StructField("shape", T.IntegerType()), T.StructField("tokens", ints)])
    shape = T.StructType([T.StructField("a_ends", ints), T.StructField("b_ends", ints)])
    columns = {"docs": doc, "fragments": fragment, "shapes": shape, "names": T.StringType(), "halves": T.LongType()}
    schema = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in columns.items()])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[str | None]]]:
        """Runs of rows of BLOCK_CHARS, over the bounds of batches: carried columns and texts."""
        parts, texts, size = [], [], 0
        for batch in batches:
            begin, new = 0, batch.column(len(carry)).to_pylist()
            for end, x in enumerate(new):
                n = len(x or "")
                if size and size + n > BLOCK_CHARS:
                    parts.append(batch.slice(begin, end - begin))
                    yield [pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(carry))], texts + new[begin:end]
                    parts, texts, size, begin = [], [], 0, end
                size += n
            parts.append(batch.slice(begin))
            texts += new[begin:]
        if texts:
            yield [pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(carry))], texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_tokenizer(a_path, b_path)
        for carried, texts in blocks(batches):
            words, found, counts = both.block(texts)
            first, shapes = found.shapes()
            at, sizes = found.take(first)
            of_a = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(found.n_a[first], sizes)
            lists = _lists(np.concatenate(words), [len(x) for x in words])
            columns = [*carried, pa.array(counts[:, 0]), pa.array(counts[:, 1]), lists]
            used, tokens = both.tokens(found)
            ends = [_lists(found.ends[at[side]], n[first]) for side, n in ((of_a, found.n_a), (~of_a, found.n_b))]
            rows = [
                pa.StructArray.from_arrays(columns, doc.fieldNames()), pa.StructArray.from_arrays([pa.array(shapes), _lists(tokens, np.diff(found.at) + 1)], fragment.fieldNames()),
                pa.StructArray.from_arrays(ends, shape.fieldNames()), both.names.take(pa.array(used)), pa.array(both.halves[used]),
            ]
            yield pa.RecordBatch.from_arrays(list(map(_one, rows)), names=schema.fieldNames())

    bound_batches(docs.sparkSession)
    return named.mapInArrow(run, schema)


def _step(array: str, **new: str) -> str:
    """SQL of array with each f in it replaced by a struct of new values. Steps nest as arguments, which are worked out once, whatever an optimizer merges."""
    return f"transform({array}, f -> named_struct({', '.join(f'{k!r}, {v}' for k, v in new.items())}))"


def _aligned() -> str:
    """SQL of (order, links) of all shapes: the tokens in the order of groups, as places from 1 on in A's and then B's, with 0 before those that are not the first of their side, and the pairs of A's and B's tokens that share bytes, as two arrays of places."""
    # all ends in one order, A's before B's where they are equal; the lower bits tell the side and A's index
    order = "sort_array(concat(transform(f.a_ends, (e, i) -> shiftleft(CAST(e AS BIGINT), 32) | i), transform(f.b_ends, e -> shiftleft(CAST(e AS BIGINT), 32) | 2147483648L)))"
    # A's token i shares bytes with B's up to hi[i]: as many of B's end before it as its place in that order tells
    hi = f"filter(transform({order}, (c, k) -> IF((c & 2147483648L) = 0, k - CAST(c & 2147483647L AS INT), -1)), v -> v >= 0)"
    high = _step("shapes", ae="f.a_ends", be="f.b_ends", hi=hi)
    low = _step(
        high, m="size(f.ae)", hi="f.hi", cuts="array_intersect(f.ae, f.be)", al="filter(transform(f.hi, (x, i) -> IF(f.be[x] = f.ae[i], i + 1, 0)), v -> v > 0)",
        lo="transform(f.hi, (h, i) -> IF(i = 0, 0, f.hi[i - 1] + IF(f.be[f.hi[i - 1]] = f.ae[i - 1], 1, 0)))",
    )
    # a group has A's tokens after the last group's, up to f.al[g], and the B tokens of their links; most groups have one of each
    before, last = "IF(g = 0, 0, f.al[g - 1])", "f.m + 1 + f.hi[f.al[g] - 1]"
    part = "transform(sequence({}, {}), (i, k) -> IF(k > 0, array(0, i), array(i)))".format
    several = f"flatten(concat({part(f'{before} + 1', 'f.al[g]')}, {part(f'f.m + 1 + f.lo[{before}]', last)}))"
    ordered = f"flatten(transform(f.cuts, (x, g) -> IF({before} = f.al[g] - 1 AND f.lo[f.al[g] - 1] = f.hi[f.al[g] - 1], array(f.al[g], {last}), {several})))"
    i, j = "array_repeat(i + 1, h - f.lo[i] + 1)", "sequence(f.m + 1 + f.lo[i], f.m + 1 + h)"
    return _step(low, order=ordered, **{side: f"flatten(transform(f.hi, (h, i) -> {x}))" for side, x in (("i", i), ("j", j))})


def align(docs: DataFrame, text: str, carry: list[str], a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """carry columns as c0, c1, ..., n_a, n_b, n_groups, `groups` (A's ids, `|`, B's ids of each, parted by `;`) and `links` (A's id * 2^32 + B's id of each), in the order of the text."""
    joined = "array_join(transform(s[f.shape].order, x -> names[own[x]]), '')"
    # a name begins with what parts it from the other side's or group's; where 0 is before it, a comma stands instead
    groups = let(f"substring(replace(replace({joined}, ',;', ','), ',|', ','), 2)", own="f.tokens")
    links = let("zip_with(s[f.shape].i, s[f.shape].j, (i, j) -> halves[own[i]] | halves[own[j]])", own="f.tokens")
    # a lambda's result is copied whole, so what all fragments or documents share is no lambda's but a column; s is used twice, so projections are not merged
    shared = tokenize_pairs(docs, text, carry, a_path, b_path).select("docs", "fragments", "names", "halves", F.expr(_aligned()).alias("s"))
    blocks = shared.select("docs", *(F.expr(f"transform(fragments, f -> {x})").alias(side) for side, x in (("groups", groups), ("links", links))))
    own = ", ".join(f"'{x}', d.{x}" for x in [*(f"c{i}" for i in range(len(carry))), "n_a", "n_b"])
    whole = f"transform(docs, d -> named_struct({own}, 'groups', array_join(transform(d.words, w -> groups[w]), ';'), 'links', flatten(transform(d.words, w -> links[w]))))"
    # the tokens of a group have one link less than they are, as each but the last end of a side opens one
    groups = (F.col("d.n_a") + F.col("d.n_b") - F.size("d.links")).alias("n_groups")
    return blocks.select(F.explode(F.expr(whole)).alias("d")).select(*(f"d.c{i}" for i in range(len(carry))), "d.n_a", "d.n_b", groups, "d.groups", "d.links")


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether no pair of its A id has more."""
    counts, _ = materialize(docs.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # one row an A id
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of documents (row, links) with links."""
    side = F.broadcast(counts) if small_enough(counts, BROADCAST_NUMBERS) else counts  # else a shuffle, whose hot pairs AQE splits
    flat = docs.select("row", F.explode("links").alias("pair"))
    return flat.join(side, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), 1).otherwise(0)).alias("n_best"), F.sum("n").alias("count_sum"))


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = align(docs, "text", ["doc_id"]).select(
        F.col("c0").alias("doc_id"), "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"),
        F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "links", F.monotonically_increasing_id().alias("row"),
    )
    rows, _ = materialize(aligned, "aligned")
    counts, _ = materialize(pair_counts(rows), "pair-scores")
    return rows.drop("links").join(link_scores(rows, counts), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
ORACLES: dict[str, str] = {}
