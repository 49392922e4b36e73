"""Sources and sinks: file trees, JSON lines, git logs, exports."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import index

# Languages by file extension, and extensions of documentation.
LANGUAGES = {
    "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "dart": "dart",
}
DOCS = ("md", "mdx", "txt", "rst")


def language_of(path):
    """Language column of a path column, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def discover(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """(path, content, hash, language) of the files under root; a path with a skipped component is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if extensions is not None:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    if skip:
        files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip))))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), language_of(F.col("path")).alias("language"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(file, summary) of a JSON-lines file: bad lines and empty or failed summaries go, the last of a file wins."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return last_summary(lines.select("at", F.from_json("value", "file string, summary string").alias("r")).select("at", "r.*"))


def last_summary(rows: DataFrame) -> DataFrame:
    good = rows.where("file IS NOT NULL AND trim(summary) != '' AND NOT startswith(summary, 'ERROR')")
    return good.groupBy("file").agg(F.max_by("summary", "at").alias("summary"))


#: Days of history that dates are taken from, and what a line with a commit's date looks like (RFC 3339).
RECENT_DAYS = 180
_DATE_LINE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of text files; the first three together order the lines as they stand, however the files are split."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def parse_git_log(lines: DataFrame, order: Sequence[str] = ("at",), parts: int = 200, now: Column | None = None, days: int = RECENT_DAYS) -> DataFrame:
    """(path, date): the newest commit date of each path, from lines of dates and file names, newest first.

    The log is filled forward in ranges of its lines, so a long history is not one task. Names before
    any date have none and go; with `now`, so do dates of more than `days` before it.
    """
    clean = lines.withColumn("line", F.regexp_replace("line", "\r+$", "")).where("line != ''")
    dated = clean.withColumn("date", F.when(F.col("line").rlike(_DATE_LINE), F.col("line")))
    named = index.forward_fill_ranges(dated, "date", order, parts).where(~F.col("line").rlike(_DATE_LINE) & F.col("date").isNotNull())
    if now is not None:
        named = named.where(F.to_timestamp("date") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return named.groupBy(F.col("line").alias("path")).agg(F.min_by("date", F.struct(*order)).alias("date"))


def export_jsonl(points: DataFrame, target: str, root: str, id_column: str = "id") -> str:
    """Write {"id", "payload"} a line, below root only."""
    place = (Path(root) / target).resolve()
    if not place.is_relative_to(Path(root).resolve()):
        raise ValueError("exports stay below their root")
    rest = [c for c in points.columns if c != id_column]
    points.select(F.to_json(F.struct(F.col(id_column).alias("id"), F.struct(*rest).alias("payload"))).alias("value")).write.mode("overwrite").text(str(place))
    return str(place)


def import_jsonl(spark: SparkSession, path: str, payload: str) -> DataFrame:
    return spark.read.schema(f"id string, payload struct<{payload}>").json(path).select("id", "payload.*")
