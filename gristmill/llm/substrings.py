"""Removal of long repeated passages by a run-length compressed index (operator 10).

A symbol goes if a string of `length` symbols that covers it also starts anywhere else in the
corpus. Symbols are the bytes of a text, or its words (white space between them does not count);
PassageParams says which, and how many make a passage.

Search space: equal strings choose the same anchor (the key-sized substring of least hash), so
every text is cut into runs of start positions that share an anchor, and only runs whose anchor
occurs again can hold repeats. Runs with equal symbols are counted by a grouped sum and marked
without further work. What remains, anchors shared by different runs, is indexed: the runs of an
anchor meet in one shard, whose run-compressed Burrows-Wheeler transform is built with suffix
positions sampled at the ends of its runs. Matching statistics are streamed from the samples:
between two samples the longest match with a neighbour in suffix order shrinks by one a symbol, so
only sampled positions are compared. Positions with a match of `length` or more are marked.

Skew: runs are short whatever the document; equal runs are summed before they move. An anchor
whose different runs exceed INDEX_SYMBOLS (a passage in very many documents) is not indexed in one
task: its runs are cut again by longer anchors (keys), by which the passage's inside collapses
into equal runs; with a key of `length` symbols every run is one string, which ends the descent.

Defined cases: null text counts as empty; texts shorter than a passage lose nothing; overlapping
repeats count; repeated rows repeat each other and so lose all that is as long as a passage; very
long texts are cut into pieces that share their ends, so each start is seen once; an empty table
gives an empty result; extra columns are carried whatever their names. Removal of bytes that splits
a UTF-8 character leaves bytes that the text form drops.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BROADCAST_NUMBERS, column, discard, map_rows, materialize, release, small_enough

#: Symbols of one index, and the most that the different runs of one anchor may hold to be indexed.
INDEX_SYMBOLS = 1_000_000
#: Runs of eight numbers, some 30 MB, that may be sent to the texts.
SENT_RUNS = 400_000
#: Symbols hashed at once.
PIECE = 1 << 20
_POSITION = (1 << 24) - 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RUN = "h long, d long, k1 long, k2 long, s long, w long, c long"
MARK = "k1 long, k2 long, start long, len long"


@dataclass(frozen=True)
class PassageParams:
    """A passage is `length` symbols; anchors have keys[0] symbols first, then the longer keys."""

    length: int = 400
    keys: tuple[int, ...] = (192, 369, 397, 400)
    words: bool = False


BYTES = PassageParams()
#: Passages of over fifty words.
WORDS = PassageParams(51, (24, 46, 50, 51), True)


def symbols_of(raw: bytes, words: bool) -> np.ndarray:
    """A text's bytes, or the 64-bit hashes of its words."""
    if not words:
        return np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(raw):  # a long text piece by piece: few words are objects at a time
        cut = raw.find(b" ", at + PIECE)
        part = raw[at : cut if cut >= 0 else len(raw)].split()
        out.append(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, part)), np.uint64))
        at = cut if cut >= 0 else len(raw)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class AnchorRuns:
    """Cuts symbol arrays into runs of start positions with one anchor."""

    def __init__(self, key: int, length: int):
        self.key, self.length, self.width = key, length, length - key + 1
        size, base = PIECE + 2 * length, 0x9E3779B97F4A7C15
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        powers[1:] = pow(base, -1, 1 << 64)
        self.inverse = np.cumprod(powers, dtype=np.uint64)
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

    def pieces(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
        """Concatenations of texts of at least `length` symbols; long texts are cut so that each start is in one piece."""
        held, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, max(0, len(text) - self.length + 1), PIECE):
                part = text[at : at + PIECE + self.length - 1]
                if size + len(part) > PIECE + self.length and held:
                    yield np.concatenate(held), parts
                    held, parts, size = [], [], 0
                parts.append((i, at, len(part)))
                held.append(part)
                size += len(part)
        if held:
            yield np.concatenate(held), parts

    def runs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Arrays: text index, first start, number of starts, anchor hash, digest of the run's symbols."""
        out: list[tuple[np.ndarray, ...]] = []
        for view, parts in self.pieces(texts):
            n, raw, width = len(view), view.tobytes(), view.itemsize
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((self.values[view] if width == 1 else view) * self.powers[:n], out=prefix[1:])
            m = n - self.key + 1
            hashed = (prefix[self.key :] - prefix[:m]) * self.inverse[:m]
            hashed ^= hashed >> np.uint64(29)
            hashed *= np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(32)
            starts, w = n - self.length + 1, self.width
            rows = -(-m // w)
            order = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
            order[:m] = (hashed & ~np.uint64(_POSITION)) | np.arange(m, dtype=np.uint64)
            blocks = order.reshape(rows, w)
            before = np.minimum.accumulate(blocks, axis=1).ravel()
            after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            anchor = (np.minimum(after[:starts], before[w - 1 : w - 1 + starts]) & np.uint64(_POSITION)).astype(np.int64)
            lens = np.array([x[2] for x in parts])
            ends = np.cumsum(lens)
            valid = np.repeat(ends, lens)[:starts] - np.arange(starts) >= self.length
            fresh = valid.copy()
            fresh[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]))
            first = np.flatnonzero(fresh)
            count = np.bincount(np.cumsum(fresh[valid]) - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
            which = np.searchsorted(ends, first, "right")
            digest = b"".join(xxhash.xxh3_64_digest(raw[a:b]) for a, b in zip((first * width).tolist(), ((first + count + self.length - 1) * width).tolist()))
            text, offset = np.array([x[0] for x in parts])[which], np.array([x[1] for x in parts])[which]
            out.append((text, first - (ends - lens)[which] + offset, count, hashed[anchor[first]].view(np.int64), np.frombuffer(digest, np.int64)))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*out))


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of non-negative keys, and the keys in it."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()).bit_length() + bits <= 64:  # place in the low bits: sorting values is faster than arguments
        both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    order = np.argsort(key, kind="stable")
    return order, key[order]


class RunLengthIndex:
    """Run-compressed BWT of a collection with sampled run ends.

    `longest` streams, for every position, the longest string starting there that also starts at
    another position of the collection.
    """

    def __init__(self, texts: list[np.ndarray]):
        self.lens = np.array([len(x) for x in texts], np.int64)
        raw = np.concatenate(texts)
        self.n = n = len(raw)
        self.begin = np.zeros(n, bool)
        self.begin[(np.cumsum(self.lens) - self.lens)[self.lens > 0]] = True
        self.left = np.repeat(np.cumsum(self.lens), self.lens) - np.arange(n)
        if raw.itemsize == 1:
            symbols, base = raw.astype(np.int64) + 1, 257
        else:
            known, symbols = np.unique(raw, return_inverse=True)
            symbols, base = symbols.astype(np.int64) + 1, len(known) + 1
        self.symbols_at = symbols
        step = max(1, min(5, int(40 / np.log2(base))))
        key = symbols.copy()
        for j in range(1, step):
            key *= base
            key[: max(0, n - j)] += np.where(self.left[: max(0, n - j)] > j, symbols[j:], 0)
        self.levels: list[tuple[int, np.ndarray]] = []
        longest = int(self.lens.max(initial=0))
        while True:  # suffix order by doubling
            order, ranked = _sorted(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            self.levels.append((step, rank.astype(np.int32)))
            if step >= longest or (n and rank[order[-1]] == n - 1):
                break
            key = rank * (n + 1)
            key[: max(0, n - step)] += np.where(self.left[: max(0, n - step)] > step, rank[step:] + 1, 0)
            step *= 2
        # texts end below every symbol and in their own order, so ties stand in text order
        before = np.where(self.begin[order], -1, symbols[order - 1])
        same = (before[1:] == before[:-1]) & (before[1:] >= 0)
        heads, tails = np.flatnonzero(np.concatenate(([True], ~same))), np.flatnonzero(np.concatenate((~same, [True])))
        self.symbols, self.run_lengths = before[heads], tails - heads + 1
        # samples: the suffix at each end of a run, with the longest match to the neighbour beyond it
        self.samples = [self._sampled(order, heads, -1), self._sampled(order, tails, 1)]

    def _sampled(self, order: np.ndarray, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        position, beyond = order[at], at + side
        inside = (beyond >= 0) & (beyond < self.n)
        match = np.zeros(len(at), np.int64)
        match[inside] = self._common(position[inside], order[beyond[inside]])
        by_text = np.argsort(position)
        return position[by_text], match[by_text]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.left[a], self.left[b])
        match = np.zeros(len(a), np.int64)
        for step, rank in reversed(self.levels):
            within = np.flatnonzero(match + step <= most)
            within = within[rank[a[within] + match[within]] == rank[b[within] + match[within]]]
            match[within] += step
        for _ in range(self.levels[0][0] - 1):  # fewer symbols than the first level are left
            live = np.flatnonzero(match < most)
            match[live[self.symbols_at[a[live] + match[live]] == self.symbols_at[b[live] + match[live]]]] += 1
        return match

    def longest(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        positions = np.arange(self.n)
        for sample, match in self.samples:
            last = np.searchsorted(sample, positions, "right") - 1
            np.maximum(out, match[last] - (positions - sample[last]), out=out)
        return out


def repeated_starts(texts: list[np.ndarray], length: int) -> list[list[tuple[int, int]]]:
    """For each text, ranges (first, count) of starts whose string of `length` symbols starts elsewhere in texts too."""
    if not sum(map(len, texts)):
        return [[] for _ in texts]
    index = RunLengthIndex(texts)
    marked = np.concatenate(([0], (index.longest() >= length).astype(np.int8), [0]))
    edges = np.diff(marked)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum(index.lens)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, i in zip(first.tolist(), last.tolist(), np.searchsorted(ends, first, "right").tolist()):
        out[i].append((a - int(ends[i] - index.lens[i]), b - a))
    return out


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """k1, k2: a row's key. Rows with equal keys have equal id and text, and lose the same bytes."""
    return docs.select(F.xxhash64(doc_id, text).alias("k1"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("k2"), F.col(text).alias("text"))


def _document_runs(keyed: DataFrame, p: PassageParams) -> DataFrame:
    def make():
        cutter = AnchorRuns(p.keys[0], p.length)

        def step(batch: pa.RecordBatch):
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            i, s, w, h, d = cutter.runs([symbols_of(x or b"", p.words) for x in batch.column(2).cast(pa.binary()).to_pylist()])
            yield _batch(RUN, h, d, k1[i], k2[i], s, w, np.ones(len(i), np.int64))

        return step

    return map_rows(keyed.where(F.octet_length("text") >= p.length), RUN, make)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _run_marks(runs: DataFrame, p: PassageParams) -> DataFrame:
    return runs.select("k1", "k2", F.col("s").alias("start"), (F.col("w") + (p.length - 1)).alias("len"))


def _fetch(wanted: DataFrame, keyed: DataFrame, p: PassageParams, send: bool) -> DataFrame:
    """wanted runs with their symbols."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "d", "s", "w", "c", F.col("hot").cast("long").alias("hot"))).alias("runs"))
    if send and small_enough(wanted, SENT_RUNS):  # else texts and runs meet by their key
        lists = F.broadcast(lists)
    # of rows with equal keys any has the same text
    joined = keyed.where(F.octet_length("text") >= p.length).join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs")
    schema = f"{RUN}, hot long, bytes binary"

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                k1, k2, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
                rows = [
                    (x["h"], x["d"], a, b, x["s"], x["w"], x["c"], x["hot"], t[x["s"] : x["s"] + x["w"] + p.length - 1].tobytes())
                    for a, b, t, xs in zip(k1, k2, (symbols_of(t, p.words) for t in texts), part.column(3).to_pylist())
                    for x in xs
                ]
                if rows:
                    yield _batch(schema, *zip(*rows))

        return step

    return map_rows(joined, schema, make)


def _kind(p: PassageParams) -> type:
    return np.uint64 if p.words else np.uint8


def _recut(regions: DataFrame, key: int, p: PassageParams) -> DataFrame:
    """The runs of regions by longer anchors, with their symbols."""
    schema = f"{RUN}, bytes binary"

    def make():
        cutter = AnchorRuns(key, p.length)

        def step(batch: pa.RecordBatch):
            k1, k2, s0, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 6))
            texts = [np.frombuffer(x, _kind(p)) for x in batch.column(8).to_pylist()]
            i, s, w, h, d = cutter.runs(texts)
            cut = [texts[a][b : b + n + p.length - 1].tobytes() for a, b, n in zip(i.tolist(), s.tolist(), w.tolist())]
            yield _batch(schema, h, d, k1[i], k2[i], s0[i] + s, w, c[i], cut)

        return step

    return map_rows(regions, schema, make)


def _index_marks(regions: DataFrame, p: PassageParams) -> DataFrame:
    """Marks of the runs of anchors that fit an index; equal anchors meet in one task."""
    most = INDEX_SYMBOLS * np.dtype(_kind(p)).itemsize

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            rows = [
                (k1, k2, s + first, count + p.length - 1)
                for (_, k1, k2, s, c, _), ranges in zip(held, repeated_starts([np.frombuffer(x[-1], _kind(p)) for x in held], p.length))
                if c == 1  # others repeat as a whole and are marked
                for first, count in ranges
            ]
            return _batch(MARK, *zip(*rows)) if rows else None

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[0] != last and size >= most:
                    if (out := flush()) is not None:
                        yield out
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[-1])
        if held and (out := flush()) is not None:
            yield out

    return regions.select("h", "k1", "k2", "s", "c", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, MARK)


def repeat_marks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p: PassageParams = BYTES, send: bool = False) -> tuple[DataFrame, list[str]]:
    """(k1, k2, start, len): symbol ranges to remove, of the rows keyed by _keyed; and the tables that hold them."""
    spark, keyed = docs.sparkSession, _keyed(docs, text, doc_id)
    marks: list[tuple[DataFrame, str]] = []
    runs, path = materialize(_document_runs(keyed, p), "runs")
    trash = [path]
    for level, key in enumerate(p.keys):
        # tables that are joined are written first: a join of two plain tables lets AQE split an anchor of very many runs
        again = runs.groupBy("h").agg(F.sum("c").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1")).where("n > 1")
        again, again_path = materialize(again.select("h", (F.col("d0") != F.col("d1")).alias("mixed")), "again")
        shared, path = materialize(runs.join(F.broadcast(again) if send and small_enough(again, BROADCAST_NUMBERS) else again, "h"), "shared")
        discard(spark, again_path, *trash)
        release(spark)
        trash = [path]
        mixed = shared.where("mixed")
        first = F.min(F.struct("k1", "k2", "s", "w", *(["bytes"] if level else []))).alias("r")
        kinds = mixed.groupBy("h", "d").agg(F.sum("c").alias("c"), first)
        kinds, path = materialize(kinds.select("h", "d", "c", "r.*"), "kinds")
        trash.append(path)
        equal, path = materialize(kinds.where("c > 1").select("h", "d"), "equal")
        trash.append(path)
        repeated = _run_marks(shared.where("NOT mixed"), p).union(_run_marks(mixed.join(equal, ["h", "d"]), p))
        marks.append(materialize(repeated, "marks"))
        weight = kinds.groupBy("h").agg((F.sum(F.col("w") + (p.length - 1)) > INDEX_SYMBOLS).alias("hot"))
        wanted = kinds.join(weight, "h")
        if level:
            regions = wanted.select("h", "d", "k1", "k2", "s", "w", "c", F.col("hot").cast("long").alias("hot"), "bytes")
        else:
            wanted, path = materialize(wanted, "wanted")
            trash.append(path)
            regions = _fetch(wanted, keyed, p, send)
        regions, region_path = materialize(regions, "regions")
        discard(spark, *trash)
        release(spark)
        marks.append(materialize(_index_marks(regions.where("hot = 0"), p), "marks"))
        hot = regions.where("hot = 1")
        trash = [region_path]
        if level + 1 == len(p.keys) or hot.isEmpty():
            break
        runs, path = materialize(_recut(hot, p.keys[level + 1], p), "runs")
        discard(spark, *trash)
        trash = [path]
    discard(spark, *trash)
    out = marks[0][0]
    for frame, _ in marks[1:]:
        out = out.union(frame)
    return out, [path for _, path in marks]


def cover(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal disjoint (start, end) ranges from (start, len) ranges."""
    out: list[list[int]] = []
    for a, n in sorted(ranges):
        b = min(a + n, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of ranges of words."""
    if not spans:
        return []
    starts, ends = zip(*(x.span() for x in _WORD.finditer(raw)))
    return [(starts[a], ends[b - 1]) for a, b in spans]


def _ranges(docs: DataFrame, text: str, doc_id: str, p: PassageParams, send: bool) -> DataFrame:
    marks, paths = repeat_marks(docs, text, doc_id, p, send)
    found, _ = materialize(marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "len")).alias("ranges")), "ranges")
    few = send and small_enough(marks, BROADCAST_NUMBERS)
    discard(docs.sparkSession, *paths)
    release(docs.sparkSession)
    # so few ranges are sent to the texts; more meet them by their key
    return F.broadcast(found) if few else found


def remove_repeats(
    docs: DataFrame, carry: list[str], digest: bool, text: str = "text", doc_id: str = "doc_id", p: PassageParams = BYTES, also: PassageParams | None = None, send: bool = False
) -> DataFrame:
    """carry columns and a struct `__r`: n_bytes, n_removed, n_spans, kept_sha256 or the kept text, and n_also.

    n_also counts the symbols in repeated passages of a second kind, which stay. send: where few
    texts have repeats, as after near-dedup, a checked number of ranges goes to the texts; else
    texts and ranges meet by their key.
    """
    found = _ranges(docs, text, doc_id, p, send)
    rows = docs.select(F.xxhash64(doc_id, text).alias("k1"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("k2"), F.struct(*map(column, carry)).alias("row"), F.col(text).alias("text"))
    joined = rows.join(found, ["k1", "k2"], "left")
    if also is None:
        joined = joined.select("row", "text", "ranges", F.expr("CAST(NULL AS ARRAY<STRUCT<start: BIGINT, len: BIGINT>>)").alias("other"))
    else:
        joined = joined.join(_ranges(docs, text, doc_id, also, send).withColumnRenamed("ranges", "other"), ["k1", "k2"], "left").select("row", "text", "ranges", "other")
    schema = joined.select("row", F.expr("named_struct('n_bytes', 0L, 'n_removed', 0L, 'n_spans', 0L, 'kept', '', 'n_also', 0L)").alias("__r")).schema

    def make():
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("n_also", pa.int64())])
        spans_of = lambda ranges: cover([(x["start"], x["len"]) for x in ranges or ()], 1 << 62)

        def one(raw: bytes | None, ranges, other):
            raw = raw or b""
            spans = word_bytes(raw, spans_of(ranges)) if p.words else spans_of(ranges)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            text = hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8", "ignore")
            return {"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(spans), "kept": text, "n_also": sum(b - a for a, b in spans_of(other))}

        def step(batch: pa.RecordBatch):
            out = [one(*x) for x in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "__r"])

        return step

    return map_rows(joined, schema, make)


def deduplicate_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p: PassageParams = BYTES) -> DataFrame:
    """docs with repeated passages cut out of their texts and n_chars, if there, counted anew. Null texts stay null."""
    done = remove_repeats(docs, docs.columns, False, text, doc_id, p, send=True)
    kept = F.when(F.col("row").getField(text).isNotNull(), F.col("__r.kept"))
    changed = {text: kept, "n_chars": F.length(kept).cast("long")} if "n_chars" in docs.columns else {text: kept}
    return done.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the words in passages of over fifty words that repeat."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], True, also=WORDS)
    return done.select("row.doc_id", "__r.n_bytes", "__r.n_removed", "__r.n_spans", F.col("__r.kept").alias("kept_sha256"), F.col("__r.n_also").alias("n_passage_words"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES: dict[str, str] = {}
