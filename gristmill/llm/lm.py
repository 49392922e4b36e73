"""Language-model scoring by a hashed maximum-entropy model (operator 2).

P(word | context) = P(class | context) P(word | class, context). Context features are the hashes of
the last word, the last two words and the word before the last (a skip). Words are ranked by their
training counts; CLASSES classes are runs of ranks of about equal add-one mass, as learnt from these
counts, and one leaf after the last rank stands for the unknown words. The first factor is a softmax
over the classes, whose features are a bias and the context hashes into BUCKETS buckets. The second
walks a balanced binary tree over the ranks of the class, whose words have similar counts: each
branching is a log-linear choice, whose reference is the number of ranks on either side and whose
features are the hashes, into 2 ** SLOT_BITS slots, of context and branching. Both factors sum to one
over all words and the unknown one.

Training: observed feature counts come from one pass over all training tokens; each of ROUNDS
further passes computes expected counts of both factors under the broadcast weights in every task,
the counts are summed across tasks in a tree of streaming sums, and the weights take a diagonally
scaled gradient step (observed less expected). Only weights of fixed size reach the driver, and one
row for each distinct count (at most the root of twice the token count), from which any rank's
count and class follow.

If top_words is given, classes are these words and the other words' hashed endings, and words within
a class have their add-one frequency, whatever the context: a plainer model, which the query is not.

Texts are tokenised once into blocks of a few MB: a local dictionary of 64-bit word hashes (words
with equal hashes count as one) and compressed local ids, their lowest bytes first. Word counts are a grouped sum over the
blocks' dictionaries; ranks are row numbers in groups of equal count, and go back to the blocks by a
join on the hash, so no vocabulary is ever gathered in one place. Training and scoring read blocks in
numpy batches.

Defined cases: null text is empty, and has its end alone; null doc_id counts as training; without
training tokens all words are unknown and every probability is 1; repeated rows count and
score each time; words of equal count are ordered by hash; a very long text is one block, of which
a few bytes a token are in memory; other columns are ignored whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import time
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_ROWS, bound_batches, discard, map_rows, materialize, release

END = "\n"  # no word holds a line break
TILE = 1 << 12  # tokens whose class scores are in a core's cache
CLEANING_S = 3  # Spark removes the shuffle files that it is let go of in the background: that of the texts waits for it
BLOCK = "block long, doc_ids array<long>, lens binary, held binary, ids binary, words array<long>, counts array<int>, tails binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class LmParams:
    buckets: int = 1 << 13
    classes: int = 32
    top_words: int | None = None
    slot_bits: int = 18
    rounds: int = 2
    block_bytes: int = 8_000_000
    chunk: int = 1 << 16
    tree_chunk: int = 1 << 14
    modulus: int = 7
    held_out: int = 2
    parts: int = 16
    rank_rows: int = 10_000


def _is_held(doc_id, p: LmParams) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % p.modulus == p.held_out


END_HASH = int(np.frombuffer(xxhash.xxh3_64_digest(END.encode()), ">i8")[0])


def token_blocks(docs: DataFrame, p: LmParams) -> DataFrame:
    def make():
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1)

        def block(rows):
            nonlocal number
            local: dict[bytes, int] = defaultdict()
            local.default_factory = local.__len__
            end = local[END.encode()]
            ids, lens, held = [], [], []
            for doc_id, raw in rows:
                mine = list(map(local.__getitem__, raw.lower().split()))
                mine.append(end)
                ids += mine
                lens.append(len(mine))
                held.append(_is_held(doc_id, p))
            flat, sizes = np.array(ids, np.int32), np.array(lens, np.int32)
            counts = np.bincount(flat[~np.repeat(held, sizes)], minlength=len(local))
            words = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, local)), ">i8").astype(np.int64)
            tails = np.array([] if p.top_words is None else [zlib.crc32(w[-2:]) % (p.classes - p.top_words - 1) for w in local], np.uint8)
            number += 1
            values = [number, [x for x, _ in rows], sizes.tobytes(), np.array(held, np.uint8).tobytes(), pack.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes()), words, counts.astype(np.int32), tails.tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = [x.split(" ")[0] for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        return block

    def run(batches):
        block, rows, size = make(), [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows.append((doc_id, raw or b""))
                size += len(raw or b"")
                if size >= p.block_bytes:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


class Features:
    """The hashed features and classes of a block's tokens."""

    def __init__(self, p: LmParams, lens: bytes, ids: bytes, hashes: np.ndarray):
        self.lens = np.frombuffer(lens, np.int32).astype(np.int64)
        self.ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
        word = np.append(hashes.view(np.uint32).astype(np.uint64) + np.uint64(1), np.uint64(0))  # the last: no word
        first = np.cumsum(self.lens) - self.lens
        before, earlier = np.empty((2, len(self.ids)), np.intp)  # places in word of the last word and of that before
        for to, source in ((before, self.ids), (earlier, before)):
            to[1:] = source[:-1]
            to[first] = len(hashes)
        mix = lambda x: (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint32) % np.uint32(p.buckets)).astype(np.uint16)
        spread = lambda x: ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        one, two = word * np.uint64(3), word * np.uint64(7) + np.uint64(5)  # a key a word, looked up for each token
        pair = (word * np.uint64(0x100000001B3))[before]
        pair ^= (word * np.uint64(0x1000193))[earlier]
        self.features = np.stack([mix(one)[before], mix(pair), mix(two)[earlier]])
        self.contexts = [spread(one)[before], spread(pair), spread(two)[earlier]] if p.top_words is None else []


def class_scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the classes for each token of a batch, their exponentials and the exponentials' sums.

    Log lifts and log priors are bounded by twice the logarithm of the token count, far from overflow.
    """
    logits = np.take(weights, features[0], axis=0)
    logits += np.take(weights, features[1], axis=0)
    logits += np.take(weights, features[2], axis=0)
    logits += bias
    raised = np.exp(logits)
    return logits, raised, raised @ np.ones(raised.shape[1], np.float32)


@dataclass(frozen=True)
class Ranks:
    """The words' ranks by falling count, then by hash, with the unknown word's last: one entry for each distinct count."""

    first: np.ndarray  # the first rank of the count
    count: np.ndarray
    before: np.ndarray  # add-one mass of all ranks before; one entry more, the whole
    bounds: np.ndarray  # the classes' first ranks; one entry more, the number of leaves

    @staticmethod
    def of(sizes: dict[int, int], classes: int) -> Ranks:
        """From the number of words of each count."""
        count = np.array([*sorted(sizes, reverse=True), 0], np.int64)
        n = np.array([*(sizes[c] for c in count[:-1].tolist()), 1], np.int64)
        first, before = np.cumsum(n) - n, np.concatenate(([0], np.cumsum(n * (count + 1))))
        leaves, bounds, done = int(n.sum()), [0], 0
        for left in range(min(classes, leaves), 1, -1):  # classes left to fill, this one included
            aim = done + -(-(int(before[-1]) - done) // left)
            g = int(np.searchsorted(before[1:], aim))
            rank = int(first[g]) - (int(before[g]) - aim) // int(count[g] + 1)  # the least with this mass before it
            bounds.append(min(max(rank, bounds[-1] + 1), leaves - left + 1))
            g = int(np.searchsorted(first, bounds[-1], "right")) - 1
            done = int(before[g]) + (bounds[-1] - int(first[g])) * int(count[g] + 1)
        return Ranks(first, count, before, np.array([*bounds, leaves], np.int64))

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.first, ranks, "right") - 1]

    def classes(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, ranks, "right") - 1


def branchings(x: Features, rank: np.ndarray, klass: np.ndarray, ranks: Ranks, some: np.ndarray, p: LmParams):
    """The branchings above the tokens at some, level by level: tokens (places in some), the features' slots, whether
    the token is above the split, places of splits whose sides differ, and these sides' log ratio (none above: -inf)."""
    ids = x.ids[some]
    k = klass[ids]
    low, leaves = ranks.bounds[:-1], np.diff(ranks.bounds)
    depths = np.array([int(n - 1).bit_length() for n in leaves], np.uint8)
    order = np.argsort(np.uint8(255) - depths[k], kind="stable")  # deepest first: a level's tokens are a prefix
    k = k[order]
    many = np.searchsorted(-depths[k].astype(np.int64), -np.arange(int(depths.max(initial=0))))
    kind = np.uint32 if ranks.bounds[-1] < 1 << 31 else np.uint64
    base, size = low.astype(kind)[k], leaves.astype(kind)[k]
    place = rank.astype(kind)[ids[order]] - base
    contexts = [c[some[order]] for c in x.contexts]
    shift = np.uint32(32 - p.slot_bits)
    for level, n in enumerate(many.tolist()):
        if not n:
            break
        half = kind(1 << level)
        upper = place[:n] >> kind(level)
        mid = upper | kind(1)
        mid <<= kind(level)
        node = base[:n] + mid
        node *= kind(0x9E3779B1)
        node = node.astype(np.uint32, copy=False)
        node ^= np.uint32(level * 0x85EBCA6B & 0xFFFFFFFF)
        slots = []
        for c in contexts:
            mixed = c[:n] ^ node
            mixed *= np.uint32(0x9E3779B1)
            mixed >>= shift
            slots.append(mixed.astype(np.intp))
        uneven = np.flatnonzero(mid + half > size[:n])
        above = np.maximum(size[uneven], mid[uneven]) - mid[uneven]
        with np.errstate(divide="ignore"):
            lift = np.log(above / float(half)).astype(np.float32)
        upper &= kind(1)
        yield order[:n], slots, upper.astype(bool), uneven, lift


def _lifted(slots: list[np.ndarray], uneven: np.ndarray, lift: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """Log odds of the upper side."""
    z = np.take(lambdas, slots[0], mode="clip")  # all slots are in range: clip spares the search for others
    z += np.take(lambdas, slots[1], mode="clip")
    z += np.take(lambdas, slots[2], mode="clip")
    z[uneven] += lift
    return z


def _words(tails: bytes, n: int, at, code, p: LmParams, ranks: Ranks | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Training count, class and (classes by count) rank of each of the n words of a block's dictionary."""
    place, codes = (np.zeros(0, np.int64) if v is None else v for v in (at, code))
    if ranks is not None:
        rank = np.full(n, ranks.bounds[-1] - 1)
        rank[place] = codes
        return ranks.counts(rank), ranks.classes(rank), rank
    count, klass = np.zeros(n, np.int64), np.frombuffer(tails, np.uint8).astype(np.int64) + 1 + p.top_words
    klass[0] = 0
    count[place], klass[place] = codes >> 6, codes & 63
    return count, klass, None


def _rows(batch: pa.RecordBatch):
    """The rows of a batch of coded blocks: doc_ids as Arrow, bytes, and arrays of numbers (at and code None: no word is known)."""
    for i in range(batch.num_rows):
        doc_ids, *data = (batch.column(j)[i] for j in range(5))
        yield doc_ids, *(v.as_py() for v in data), *(v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in (batch.column(j)[i] for j in range(5, 8)))


def _counts_pass(blocks: DataFrame, ranks, p: LmParams, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed counts (model None) or expected ones, of training documents only: by bucket and class; by class; by slot.

    Observed counts by slot are branchings, upper sides and the reference's expectation of these above one half; expected ones, upper sides.
    """
    slots = 0 if ranks is None else 1 << p.slot_bits
    kinds = 3 if model is None else 1
    shapes = ((p.classes, p.buckets), (p.classes,), (kinds, slots))

    def run(batches):
        total, bias, sides = (np.zeros(shape) for shape in shapes)
        both = np.zeros(slots, np.int64)  # of a block: branchings, and upper sides times 2 ** 32
        pairs = -(-p.classes // 2)  # of classes, summed as complex numbers: one addition for both
        columns, two = np.zeros((pairs, 0 if model is None else p.chunk), np.complex128), np.zeros((pairs, p.buckets), np.complex128)
        known = ranks.value if ranks is not None else None
        *weights, lambdas = model.value if model is not None else (None,)
        for batch in batches:
            for _, lens, held, ids, tails, hashes, at, code in _rows(batch):
                x = Features(p, lens, ids, hashes)
                keep = np.flatnonzero(np.repeat(np.frombuffer(held, np.uint8) == 0, x.lens))
                _, klass, rank = _words(tails, len(hashes), at, code, p, known)
                label = klass[x.ids]
                for a in range(0, len(keep), p.chunk):
                    some = keep[a : a + p.chunk]
                    f = x.features[:, some].astype(np.intp)
                    if not weights:
                        c = label[some]
                        bias += np.bincount(c, minlength=p.classes)
                        for one in f:
                            np.add.at(total.reshape(-1), c * p.buckets + one, 1.0)
                    else:
                        n = len(some)
                        for b in range(0, n, TILE):
                            _, prob, norm = class_scores(*weights, f[:, b : b + TILE])
                            prob *= (1 / norm)[:, None]
                            if p.classes % 2:
                                prob = np.pad(prob, ((0, 0), (0, 1)))
                            columns[:, b : min(b + TILE, n)] = prob.view(np.complex64).T
                        for to, column in zip(two, columns[:, :n]):
                            for one in f:
                                np.add.at(to, one, column)
                        bias += columns[:, :n].sum(axis=1).view(np.float64)[: p.classes]
                for a in range(0, len(keep) if known is not None else 0, p.tree_chunk):
                    for _, places, up, uneven, lift in branchings(x, rank, klass, known, keep[a : a + p.tree_chunk], p):
                        if weights:
                            chance = 1 / (1 + np.exp(-_lifted(places, uneven, lift, lambdas).astype(np.float64)))
                            for one in places:
                                np.add.at(sides[0], one, chance)
                            continue
                        alone = np.isneginf(lift)  # no branching
                        step = up.astype(np.int64)
                        step <<= 32
                        step += 1
                        step[uneven[alone]] = 0
                        uneven, lift = uneven[~alone], lift[~alone]
                        odd = 1 / (1 + np.exp(-lift.astype(np.float64))) - 0.5
                        for one in places:
                            np.add.at(both, one, step)
                            np.add.at(sides[2], one[uneven], odd)
                if not weights:  # a token is at few branchings of one slot, a text has under 2 ** 30 tokens: no overflow
                    sides[0] += both & 0xFFFFFFFF
                    sides[1] += both >> 32
                    both[:] = 0
        if model is not None:
            total = np.stack((two.real, two.imag), axis=1).reshape(-1, p.buckets)[: p.classes]
        flat = np.concatenate([v.ravel() for v in (total, bias, sides)]).astype(np.float32)  # of one task: sums are double
        for i, part in enumerate(np.array_split(flat, p.parts)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], names=["part", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                x = np.frombuffer(data, np.float32).astype(np.float64)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.astype(np.float32).tobytes()])], names=["part", "data"])

    kind = "part int, data binary"
    tasks = blocks.rdd.getNumPartitions()
    rows = blocks.mapInArrow(run, kind)
    if tasks > p.parts**2:  # groups of tasks first, so that no sum reads what every task sends
        groups = int(tasks**0.5)
        grouped = rows.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
        rows = grouped.repartition(p.parts * groups, "part", "g").drop("g").mapInArrow(add, kind)
    rows = rows.repartition(p.parts, "part").mapInArrow(add, kind).collect()  # fixed size: buckets times classes, and slots
    found = {r.part: np.frombuffer(r.data, np.float32) for r in rows}
    flat = np.concatenate([found[i] for i in range(p.parts)]).astype(np.float64) if found else np.zeros(sum(map(np.prod, shapes)))
    total, bias, sides = (v.reshape(shape) for v, shape in zip(np.split(flat, np.cumsum([np.prod(x) for x in shapes])[:-1]), shapes))
    return total.T, bias, sides


def train(blocks: DataFrame, ranks, p: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and bias (classes) of classes, and weights of branchings (slots; none without ranks)."""
    spark = blocks.sparkSession
    observed, classes, (visits, ups, reference) = _counts_pass(blocks, ranks, p, None)
    prior = (classes + 1) / (classes.sum() + p.classes)
    seen = observed.sum(axis=1, keepdims=True)
    # start: damped log lift of each feature alone, a third for each kind of feature
    weights = (np.log((observed + 20 * prior) / (seen + 20)) - np.log(prior)) / 3
    bias = np.log(prior)
    logit = lambda x: np.log(x / (1 - x))
    usual = np.clip(0.5 + reference / np.maximum(visits, 1), 1e-6, 1 - 1e-6)
    lambdas = (logit((ups + 20 * usual) / (visits + 20)) - logit(usual)) / 3
    for _ in range(p.rounds):
        release(spark)
        sent = spark.sparkContext.broadcast((np.ascontiguousarray(weights, np.float32), bias.astype(np.float32), lambdas.astype(np.float32)))
        expected, expected_classes, (upper,) = _counts_pass(blocks, ranks, p, sent)
        weights = weights + np.clip((observed - expected) / (expected + 10), -1, 1) / 3
        bias = bias + np.clip((classes - expected_classes) / (expected_classes + 10), -1, 1) / 3
        curve = upper * (1 - upper / np.maximum(visits, 1))  # at least the variance
        lambdas = lambdas + np.clip((ups - upper) / (np.maximum(curve, 0) + 10), -1, 1) / 3
        sent.destroy()
    return np.ascontiguousarray(weights, np.float32), bias.astype(np.float32), lambdas.astype(np.float32)


def rank_words(counts: DataFrame, sizes: dict[int, int], p: LmParams) -> DataFrame:
    """(word, code) of counts (word, c): ranks from 0 by falling count, then by hash.

    Row numbers are counted in groups of words of equal count; a large group is cut by the hash.
    """
    spark = counts.sparkSession
    cuts = {c: n // p.rank_rows + 1 for c, n in sizes.items() if n > p.rank_rows}
    if cuts:  # equal ranges of the hash, which is uniform, in its order as a signed number
        steps = F.create_map(*(F.lit(v).cast("long") for c, k in cuts.items() for v in (c, -(-(1 << 32) // k))))
        high = F.shiftright("word", 32) + F.lit(1 << 31)
        group = F.coalesce(F.floor(high / F.element_at(steps, F.col("c"))), F.lit(0)).cast("long")
    else:
        group = F.lit(0).cast("long")
    keyed = counts.select("word", "c", group.alias("g"))
    found = sorted(keyed.groupBy("c", "g").agg(F.count("*").alias("n")).collect(), key=lambda r: (-r.c, r.g))  # a row a count and a cut
    start, rows = 0, []
    for r in found:
        rows.append((r.c, r.g, start))
        start += r.n
    starts = spark.createDataFrame(rows, "c long, g long, start long")
    starts = F.broadcast(starts) if len(rows) <= BROADCAST_ROWS else starts
    number = F.row_number().over(Window.partitionBy("c", "g").orderBy("word"))
    return keyed.select("word", "c", "g", number.alias("i")).join(starts, ["c", "g"]).select("word", (F.col("start") + F.col("i") - 1).alias("code"))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as it ends, not whenever the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score_documents(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    with shuffles_removed(docs.sparkSession):
        return _scored(docs, p)


def _scored(docs: DataFrame, p: LmParams) -> DataFrame:
    spark = docs.sparkSession
    blocks, blocks_path = materialize(token_blocks(docs, p), "blocks")
    tail = [] if p.top_words is None else [F.ascii(F.substring("tails", F.col("at") + 1, F.lit(1))).alias("tail")]
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e"), "tails").select(
        "block", "at", F.col("e.words").alias("word"), F.col("e.counts").alias("n"), *tail
    )
    counts = entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), *(F.min("tail").alias("tail") for _ in tail))
    counts, counts_path = materialize(counts, "counts")
    release(spark)
    sizes = {r.c: r.n for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row a count: at most the root of twice the tokens
    n_all, v_all = sum(c * n for c, n in sizes.items()), sum(sizes.values())
    n_k, v_k, ranks = np.zeros(p.classes), np.zeros(p.classes), None
    if p.top_words is None:
        found = Ranks.of(sizes, p.classes)
        p = replace(p, classes=len(found.bounds) - 1)
        ranks = spark.sparkContext.broadcast(found)
        codes = rank_words(counts, sizes, p)
    else:
        frequent = counts.where(F.col("word") != END_HASH).orderBy(F.desc("c"), "word").limit(p.top_words).collect()  # a fixed few
        klass = F.col("tail") + (1 + p.top_words)
        for i, row in enumerate(frequent):
            klass = F.when(F.col("word") == row.word, 1 + i).otherwise(klass)
        counts = counts.select("word", "c", F.when(F.col("word") == END_HASH, 0).otherwise(klass).cast("long").alias("k"))
        for row in counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row a class
            n_k[row.k], v_k[row.k] = row.n, row.v
        codes = counts.select("word", (F.col("c") * 64 + F.col("k")).alias("code"))

    coded = entries.select("block", "at", "word").join(codes, "word").select("block", "at", "code")
    dictionary, dictionary_path = materialize(coded.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("code").alias("code")), "codes")
    discard(spark, counts_path)
    release(spark)
    time.sleep(CLEANING_S)
    short = F.transform("words", lambda w: F.shiftright(w, 32).cast("int")).alias("hashes")  # the bits that features are made of
    rows = blocks.select("block", "doc_ids", "lens", "held", "ids", "tails", short).join(dictionary, "block", "left").drop("block")
    rows, _ = materialize(rows, "coded")
    discard(spark, blocks_path, dictionary_path)
    release(spark)
    model = spark.sparkContext.broadcast((*train(rows, ranks, p), n_k, v_k))
    release(spark)

    def make():
        weights, bias, lambdas, n_k, v_k = model.value
        known = ranks.value if ranks is not None else None
        names = [x.split(" ")[0] for x in RESULT.split(", ")]

        def step(batch: pa.RecordBatch):
            for doc_ids, lens, held, ids, tails, hashes, at, code in _rows(batch):
                x = Features(p, lens, ids, hashes)
                count, klass, rank = _words(tails, len(hashes), at, code, p, known)
                base = np.log10((count + 1) / (n_all + v_all + 1))
                inside = np.log((count + 1) / (n_k + v_k + 1)[klass]) if known is None else None
                score = np.empty(len(x.ids))
                for a in range(0, len(x.ids), TILE):
                    some = x.ids[a : a + TILE]
                    logits, _, norm = class_scores(weights, bias, x.features[:, a : a + TILE].astype(np.intp))
                    score[a : a + TILE] = logits[np.arange(len(some)), klass[some]] - np.log(norm)
                if known is None:
                    score += inside[x.ids]
                for a in range(0, len(x.ids) if known is not None else 0, p.tree_chunk):
                    part = score[a : a + p.tree_chunk]
                    for tokens, places, up, uneven, lift in branchings(x, rank, klass, known, np.arange(a, a + len(part)), p):
                        z = _lifted(places, uneven, lift, lambdas)
                        np.negative(z, out=z, where=up)
                        part[tokens] -= np.log1p(np.exp(z, out=z), out=z)
                first = np.cumsum(x.lens) - x.lens
                total = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0)
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(np.frombuffer(held, np.uint8).astype(bool)), pa.array(x.lens), pa.array(total((count > 0).astype(np.int64)[x.ids])),
                     pa.array(np.full(n, n_all, np.int64)), pa.array(total(base[x.ids])), pa.array(total(score) / np.log(10))], names=names,
                )

        return step

    return map_rows(rows, RESULT, make)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_lm_score": op2_lm_score}
ORACLES: dict[str, str] = {}
