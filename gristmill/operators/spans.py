"""Code spans of hits: where a symbol or a usage begins and ends in its source, and its code.

Sources become blocks of BLOCK lines, each with the lines around that its spans can reach, and a hit
meets one block, so a file with many lines or many hits is never gathered in one row. Lines carry
their balance of braces outside strings; a fold over at most `most` lines finds the first line where
a symbol's braces close, or that ends a symbol without braces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.arrays import let
from gristmill.operators.symbols import structural_rank
from gristmill.scratch import materialize, small_enough

BLOCK = 128
#: Most lines of a symbol, of the symbol around a usage, lines searched upwards for that, notes before a symbol, and lines around a usage without one.
SYMBOL_LINES, USAGE_LINES, USAGE_ABOVE, NOTES, AROUND = 90, 80, 40, 6, 8
#: Sources whose hits are symbols, unless they are properties.
SYMBOL_SOURCES = ("symbol", "search_symbol")
# What opens a line that holds the symbol around a usage, a line that belongs to the symbol below it, and words of a line that begins another symbol.
HEADS = ("fun ", "def ", "function ", "class ", "interface ", "object ")
NOTE_MARKS = ("@", "//", "/*", "*")
SYMBOL_WORDS = "class|interface|object|enum|fun|def|function|val|var"

_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRING = r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?$)|'(?:[^'\\]++|\\.)*+(?:'|\\?$)"""
_SYMBOL = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{SYMBOL_WORDS})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])|=>|\{{"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{_WHITE}+|{_WHITE}+$", "")


def brace_delta(line: Column) -> Column:
    """Opening less closing braces of a line, those inside strings left out; a string ends with its line."""
    bare = F.regexp_replace(line, _STRING, "")
    return F.length(F.regexp_replace(bare, "[^{]", "")) - F.length(F.regexp_replace(bare, "[^}]", ""))


#: Lines that a span can reach above and below the line of its hit.
ABOVE, BELOW = USAGE_ABOVE + NOTES, SYMBOL_LINES
# What a line is, as bits: it opens a brace, ends a symbol without braces, is a note, may hold the symbol around a usage.
_OPEN, _ENDS, _NOTE, _HEAD = 1, 2, 4, 8


def _mark(line: Column) -> Column:
    bit = lambda test, b: F.when(test, b).otherwise(0)
    ends = line.rlike(_SYMBOL) | line.rlike(rf"^{_WHITE}*\z")
    note, head = ("|".join(f"\\Q{x}\\E" for x in marks) for marks in (NOTE_MARKS, HEADS))
    marks = bit(F.contains(line, F.lit("{")), _OPEN) + bit(ends, _ENDS) + bit(line.rlike(f"^{_WHITE}*(?:{note})"), _NOTE) + bit(line.rlike(f"^{_WHITE}*(?:{head})"), _HEAD)
    return marks.cast("byte")


def line_blocks(sources: DataFrame) -> DataFrame:
    """(path, block, n, low, raw, delta, mark): the lines of each block of sources (path, text) from `low`, with those that spans of its lines can reach; positions count from 0.

    `n` is the number of lines of the text, whose last block is number -1.
    """
    lines = sources.where("text IS NOT NULL").select("path", F.split("text", "\n").alias("l")).withColumn("n", F.size("l"))
    cut = lines.select("*", F.explode(F.expr(f"sequence(0, (n - 1) div {BLOCK})")).alias("block")).withColumn("low", F.expr(f"greatest(block * {BLOCK} - {ABOVE}, 0)"))
    number = F.expr(f"IF(block = (n - 1) div {BLOCK}, -1, block)").alias("block")
    held = cut.select("path", number, "n", "low", F.expr(f"slice(l, low + 1, (block + 1) * {BLOCK} + {BELOW} - low)").alias("raw"))
    braces = lambda x: F.when(F.contains(x, F.lit("{")) | F.contains(x, F.lit("}")), brace_delta(x)).otherwise(0)
    return held.select("*", F.transform("raw", braces).alias("delta"), F.transform("raw", _mark).alias("mark"))


def _bounds() -> str:
    """SQL of (start_line, end_line, code) from a block, the place `_idx` of a target in it, `_line`, `_n` and `_symbol`."""
    notes = "aggregate(reverse(filter(w, x -> x.pos >= at - {0} AND x.pos < at)), named_struct('k', 0, 'go', true), (s, x) -> named_struct('k', s.k + IF(s.go AND x.note, 1, 0), 'go', s.go AND x.note)).k"
    step = let(
        "named_struct('bal', b, 'open', o, 'end', CASE WHEN s.end >= 0 THEN s.end WHEN x.pos = at THEN -1 WHEN o AND b <= 0 THEN x.pos + 1 WHEN NOT o AND x.ends THEN x.pos ELSE -1 END)",
        b="s.bal + x.delta",
        o="s.open OR x.open",
    )
    closed = f"aggregate(filter(w, x -> x.pos >= at AND x.pos < at + most), named_struct('bal', 0, 'open', false, 'end', -1), (s, x) -> {step}).end"
    found = let(
        "named_struct('first', at + 1 - notes, 'last', IF(closed >= 0, closed, least(_n, at + most)))", notes=notes.format(NOTES), closed=closed
    )
    around = f"named_struct('first', greatest(_line - {AROUND}, 1), 'last', least(_line + {AROUND}, _n))"
    near = "arrays_zip(" + ", ".join(f"slice({x}, begin - _low + 1, {ABOVE + BELOW + 1})" for x in ("_raw", "_delta", "_mark")) + ")"
    bits = ", ".join(f"'{name}', x.`2` & {bit} > 0" for name, bit in (("open", _OPEN), ("ends", _ENDS), ("note", _NOTE), ("head", _HEAD)))
    body = let(
        "named_struct('start_line', r.first, 'end_line', r.last, 'code', array_join(transform(filter(w, x -> x.pos >= r.first - 1 AND x.pos < r.last), x -> x.raw), '\\n'))",
        begin=f"greatest(_idx - {ABOVE}, 0)",
        w=f"transform({near}, (x, i) -> named_struct('pos', begin + i, 'raw', x.`0`, 'delta', x.`1`, {bits}))",
        at=f"IF(_symbol, _idx, coalesce(array_max(transform(filter(w, x -> x.head AND x.pos <= _idx AND x.pos >= _idx - {USAGE_ABOVE}), x -> x.pos)), -1))",
        most=f"IF(_symbol, {SYMBOL_LINES}, {USAGE_LINES})",
        r=f"IF(at < 0, {around}, {found})",
    )
    return f"IF(_raw IS NOT NULL AND _line IS NOT NULL, {body}, NULL)"


def attach_code(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """hits (file_path, line, source, kind, ...) with `start_line`, `end_line` and `code`, from sources (path, text).

    Symbols begin up to six lines of notes above and end with their braces, or before the next blank
    or symbol line; a usage takes the symbol that begins within 40 lines above, or eight lines to
    either side. Texts are shuffled once, and code is made where hit and block meet, so that no code
    is shuffled. Hits of files that are not there keep nulls.
    """
    as_symbol = F.coalesce(F.col("source").isin(*SYMBOL_SOURCES) & (F.coalesce("kind", F.lit("")) != "property"), F.lit(False))
    kept = [c for c in hits.columns if c not in ("start_line", "end_line", "code")]
    marked = hits.select(*kept, as_symbol.alias("_symbol"), F.col("line").cast("int").alias("_line")).withColumn("_block", F.expr(f"greatest(coalesce(_line, 1) - 1, 0) div {BLOCK}"))
    # the line's block may be the last one or lie beyond it: a hit asks for both, and one answer counts
    asked = marked.withColumn("_at", F.explode(F.array(F.col("_block"), F.lit(-1))))
    blocks = line_blocks(sources).toDF("_path", "_number", "_n", "_low", "_raw", "_delta", "_mark")
    met = asked.join(blocks, (F.col("file_path") == F.col("_path")) & (F.col("_at") == F.col("_number")), "left")
    met = met.where(f"IF(_at >= 0, _n IS NOT NULL, _n IS NULL OR _block >= (_n - 1) div {BLOCK})").withColumn("_idx", F.expr("least(greatest(_line - 1, 0), _n - 1)"))
    found = met.select(*kept, F.expr(_bounds()).alias("_b"))
    return found.select(*kept, F.col("_b.start_line").cast("long").alias("start_line"), F.col("_b.end_line").cast("long").alias("end_line"), F.col("_b.code").alias("code"))


def islands(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """spans with `island`: runs of spans of a key, each of which overlaps an earlier one of its run."""
    order = Window.partitionBy(*by).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", F.when(F.col("start_line") <= reach, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


class _Kept:
    """Spans kept so far, of which a later one may overlap none by `share` of the shorter.

    Kept spans never hold one another, so in order of their starts their ends are in order too, and only neighbours are looked at.
    """

    def __init__(self, share: float) -> None:
        self.share, self.spans, self.starts = share, [], []

    def takes(self, a: int | None, b: int | None) -> bool:
        if a is None or b is None:
            return True  # overlaps nothing
        kept, starts, share = self.spans, self.starts, self.share
        at = bisect.bisect_right(starts, a)
        clashes = lambda c, d: min(b, d) - max(a, c) + 1 >= share * max(min(b - a, d - c) + 1, 1)
        left, right = at - 1, at
        while left >= 0 and kept[left][1] >= a:
            if clashes(*kept[left]):
                return False
            left -= 1
        while right < len(kept) and kept[right][0] <= b:
            if clashes(*kept[right]):
                return False
            right += 1
        if a <= b:
            starts.insert(at, a)
            kept.insert(at, (a, b))
        return True


def greedy(spans: Sequence[tuple[int, int]], share: float) -> list[int]:
    """Indexes of the spans, best first, that overlap none kept before by `share` of the shorter."""
    kept = _Kept(share)
    return [i for i, (a, b) in enumerate(spans) if kept.takes(a, b)]


def overlap_dedupe(spans: DataFrame, order: Sequence[str] = ("rank",), by: Sequence[str] = ("file_path",), share: float = 0.5) -> DataFrame:
    """Spans (start_line, end_line, ...) without those that overlap a better kept one of their key by `share` of the shorter, at most the whole of it.

    Greedy by `order`, ties by place. Only runs of overlapping spans are decided together. A task
    passes over its runs one after the other and holds the kept places of one, so many small runs
    cost no call each, and a run costs n log n, whatever the overlaps.
    """
    best = Window.partitionBy(*by, "island").orderBy(*[F.asc_nulls_last(c) for c in order], "start_line", "end_line")
    runs = islands(spans, by).withColumn("_i", F.row_number().over(best)).drop("island")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(share)
        for batch in batches:
            keep = []
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("_i", "start_line", "end_line"))):
                if i == 1:
                    kept = _Kept(share)
                keep.append(kept.takes(a, b))
            yield batch.filter(pa.array(keep, pa.bool_()))

    # a window's rows leave it run by run, in its order
    return runs.mapInArrow(decide, runs.schema).drop("_i")


def resolve_with_code(hits: DataFrame, sources: DataFrame, limit: int = 20, by: Sequence[str] = ("qid", "role")) -> DataFrame:
    """Hits of many requests (`by`, file_path, line, source, kind, name, signature, score) with code, ranked, without overlaps, `limit` of each.

    Definitions without code go; `place` is the rank among a request's kept hits.
    """
    start, end = F.coalesce(F.nullif("start_line", F.lit(0)), "line"), F.coalesce(F.nullif("end_line", F.lit(0)), "line")

    def with_rank(coded: DataFrame) -> DataFrame:
        placed = coded.withColumn("code", F.coalesce("code", F.lit(""))).withColumn("start_line", start).withColumn("end_line", end).withColumn("_t", trimmed(F.col("code")))
        return placed.withColumn("rank", structural_rank(F.col("score"), F.col("start_line"), F.col("end_line"), F.coalesce("signature", F.lit("")), F.col("_t")))

    shown = F.coalesce((F.col("role") != "definitions") | (F.col("_t") != ""), F.lit(False))
    # code is found again for what is kept; what is not shown goes after the overlaps, as a filter before them would find the code twice
    ranked = with_rank(attach_code(hits, sources)).withColumn("worse", -F.col("rank")).withColumn("_shown", shown).drop("code", "rank", "_t")
    kept = overlap_dedupe(ranked, ("worse", "line", "name"), (*by, "file_path", "_shown")).where("_shown").drop("_shown")
    order = Window.partitionBy(*by).orderBy("worse", "file_path", "line", "name")
    first = kept.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).drop("worse", "start_line", "end_line")
    first, _ = materialize(first, "first-hits")
    paths = first.select(F.col("file_path").alias("path")).distinct()
    read = sources.join(F.broadcast(paths) if small_enough(first) else paths, "path", "left_semi")
    return with_rank(attach_code(first, read)).select(*[c for c in hits.columns if c not in ("start_line", "end_line", "code")], "start_line", "end_line", "code", "rank", "place")
