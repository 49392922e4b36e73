"""Token counts by separator scan (operator 5).

A token file is a flat run of ids of 2 or 4 bytes, little-endian, documents ended by one identifier, without an index.
Files are read as fixed-size blocks that ignore document boundaries. Each block is searched with
one vectorised comparison and reduced to a summary: its length, its separators, the ids before
the first and after the last, and the lengths between. A two-level prefix scan over the
summaries (inside groups of blocks, then over the groups' totals) gives every block the number
of documents ended before it and the ids left open, which stitches documents that span blocks.

Defined cases: an empty document counts 0; ids after the last separator are a document of their
own if there are any; an empty file has no documents; null texts are written as empty ones;
repeated rows are counted each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.bpe import encoder, vocab_path
from gristmill.llm.common import bound_batches, map_rows, materialize

EOS = 50256
BLOCK_IDS = 1 << 15
GROUP_BLOCKS = 1024


def id_type(width: int) -> str:
    """numpy's name of an id of that many bytes."""
    if width not in (2, 4):
        raise ValueError("ids have 2 or 4 bytes")
    return f"<u{width}"


def write_token_blocks(docs: DataFrame, path: str | None = None, block_ids: int = BLOCK_IDS, eos: int = EOS, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Flat token files, as tables: blocks (file, block, data) and the order of documents (file, ordinal, doc_id).

    Each task writes one file; a block is cut every block_ids ids wherever documents end.
    """
    path, kind_of_id = path or vocab_path(), id_type(width)

    def run(batches):
        from pyspark import TaskContext

        bpe = encoder(path, special=False)
        if max(len(bpe.token_bytes) - 1, eos) >= 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary do not fit in {width} bytes")
        name = f"part-{TaskContext.get().partitionId():06d}"
        pending, held, block, ordinal = [], 0, 0, 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        names = ["kind", "file", "place", "data", "doc_id"]

        def row(kind, places, data, ids):
            n = len(places)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([kind] * n, [name] * n, places, data, ids), kinds)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                for text in part.column(1).to_pylist():
                    x = np.array([*bpe.encode(text), eos], kind_of_id)
                    pending.append(x)
                    held += len(x)
                yield row("order", list(range(ordinal, ordinal + len(ids))), [None] * len(ids), ids)
                ordinal += len(ids)
                if held >= block_ids:
                    flat = np.concatenate(pending)
                    full = len(flat) // block_ids
                    yield row("block", list(range(block, block + full)), [flat[i * block_ids : (i + 1) * block_ids].tobytes() for i in range(full)], [None] * full)
                    block, pending = block + full, [flat[full * block_ids :]]
                    held = len(pending[0])
        if held:
            yield row("block", [block], [np.concatenate(pending).tobytes()], [None])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(run, "kind string, file string, place long, data binary, doc_id long")
    table, _ = materialize(rows, "tokens", ["kind"])
    return (
        table.where("kind = 'block'").select("file", F.col("place").alias("block"), "data"),
        table.where("kind = 'order'").select("file", F.col("place").alias("ordinal"), "doc_id"),
    )


def read_token_files(spark, path: str, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """Blocks of existing flat files, by Spark's binary file source: a file, of up to 2 GB, is read once, by one task."""
    id_type(width)
    size = width * block_ids

    def make():
        def step(batch: pa.RecordBatch):
            for file, content in zip(*batch.columns):
                name, view = file.as_py(), memoryview(content.as_buffer())
                for block, at in enumerate(range(0, len(view), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([bytes(view[at : at + size])], pa.binary())], names=["file", "block", "data"])

        return step

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_rows(files, "file string, block long, data binary", make)


def summaries(blocks: DataFrame, eos: int = EOS, width: int = 2) -> DataFrame:
    """(file, block, n, seps, head, tail, inner): what a block contributes."""
    kind_of_id = id_type(width)
    schema = "file string, block long, n long, seps long, head long, tail long, inner array<long>"

    def make():
        names = ["file", "block", "n", "seps", "head", "tail", "inner"]

        def step(batch: pa.RecordBatch):
            rows = []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", kind_of_id)
                ends = np.flatnonzero(ids == eos)
                if len(ends):
                    rows.append((len(ids), len(ends), int(ends[0]), len(ids) - 1 - int(ends[-1]), (np.diff(ends) - 1).tolist()))
                else:
                    rows.append((len(ids), 0, len(ids), len(ids), []))
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds))], names=names
            )

        return step

    return map_rows(blocks.select("file", "block", "data"), schema, make)


def document_lengths(blocks: DataFrame, eos: int = EOS, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in flat token files."""
    parts, _ = materialize(summaries(blocks, eos, width), "summaries")
    grouped = parts.withColumn("grp", F.expr(f"block div {GROUP_BLOCKS}"))
    inside = Window.partitionBy("file", "grp").orderBy("block")
    # `done` is the position just behind the last separator so far, relative to the group's start
    local = grouped.withColumns({
        "n_to": F.sum("n").over(inside),
        "seps_to": F.sum("seps").over(inside),
    }).withColumn("done", F.max(F.when(F.col("seps") > 0, F.col("n_to") - F.col("tail"))).over(inside))
    totals = grouped.groupBy("file", "grp").agg(F.sum("n").alias("gn"), F.sum("seps").alias("gs"))
    last = local.groupBy("file", "grp").agg(F.max("done").alias("gd"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.join(last, ["file", "grp"]).withColumns({
        "n0": F.coalesce(F.sum("gn").over(before), F.lit(0)),
        "s0": F.coalesce(F.sum("gs").over(before), F.lit(0)),
    })
    bases = bases.withColumn("d0", F.coalesce(F.max(F.col("gd") + F.col("n0")).over(before), F.lit(0)))
    placed = local.join(bases.select("file", "grp", "n0", "s0", "d0"), ["file", "grp"])
    earlier = F.max("done").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("open", F.col("n0") + F.col("n_to") - F.col("n") - F.coalesce(earlier + F.col("n0"), F.col("d0")))
    counts = placed.where("seps > 0").select(
        "file", F.expr("s0 + seps_to - seps").alias("base"), F.expr("concat(array(open + head), inner)").alias("lengths")
    ).select("file", "base", F.posexplode("lengths").alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")
    rest = bases.groupBy("file").agg(F.sum("gn").alias("n"), F.sum("gs").alias("ordinal"), F.coalesce(F.max(F.expr("gd + n0")), F.lit(0)).alias("d"))
    return counts.union(rest.where("n > d").select("file", "ordinal", (F.col("n") - F.col("d")).alias("n_tokens")))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    blocks, order = write_token_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return order.join(document_lengths(blocks), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
