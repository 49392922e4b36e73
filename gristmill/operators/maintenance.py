"""Tables kept in buckets of files, and index runs that commit batch by batch.

A table of rows of files lies in folders `bucket=<k>` by a hash of the file. A change of some files
rewrites their buckets alone, by Spark's dynamic partition overwrite; all other partitions stay as
they are, byte for byte. A state table (path, hash) has generations: a new one is written aside and
renamed into place, which takes effect at once or not at all, and readers take the last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.index import next_state, state_diff
from gristmill.scratch import discard, materialize, small_enough

BUCKETS = 64
#: Generations of a state that are kept: a reader of the last but one is not disturbed.
GENERATIONS = 2


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class FileTable:
    """Rows of files in a bucketed table at `path`; `key` is the column that names the file."""

    path: str
    key: str = "file_path"
    buckets: int = BUCKETS

    def _held(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(spark.read.parquet(f"{self.path}/_schema").schema).parquet(self.path)

    def _keep_schema(self, rows: DataFrame) -> None:
        """A table whose rows are all gone still has its columns."""
        if not exists(rows.sparkSession, f"{self.path}/_schema"):
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_schema")

    def create(self, rows: DataFrame) -> None:
        self._keep_schema(rows.withColumn("bucket", bucket_of(self.key, self.buckets)))
        # one file a bucket: rows of a bucket come together before they are written
        _overwrite(rows.withColumn("bucket", bucket_of(self.key, self.buckets)).repartition(self.buckets, "bucket"), self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._held(spark).drop("bucket")

    def replace(self, files: DataFrame, fresh: DataFrame, theirs: bool = False) -> dict[str, int]:
        """Put `fresh` rows in place of all rows of `files` (a column named as key); null and empty names are no files.

        Rewrites the buckets of those files alone. Doing it again changes nothing. Returns how many
        rows went and came. With `theirs`, all fresh rows are known to be of those files. Buckets are
        written straight from what they held: an overwrite of partitions sets its files aside until all are read.
        """
        spark = files.sparkSession
        named = F.col(self.key).isNotNull() & (F.col(self.key) != "")
        files, files_path = materialize(files.select(self.key).where(named).distinct().withColumn("bucket", bucket_of(self.key, self.buckets)), "touched")
        touched = sorted(r.bucket for r in files.select("bucket").distinct().collect())  # a number a bucket
        if not touched:
            discard(spark, files_path)
            return {"deleted": 0, "written": 0}
        few = small_enough(files)
        ours = F.broadcast(files.select(self.key)) if few else files.select(self.key)
        fresh = fresh.where(named).withColumn("bucket", bucket_of(self.key, self.buckets))
        if not theirs:
            fresh = fresh.join(ours, self.key, "left_semi")
        self._keep_schema(fresh)
        old = self._held(spark).where(F.col("bucket").isin(touched))
        columns = [c for c in fresh.columns if c != "bucket"] + ["bucket"]
        deleted = old.select(self.key).join(ours, self.key, "left_semi").count()
        stay = old.join(ours, self.key, "left_anti").select(*columns, F.lit(False).alias("_new"))
        rows = stay.unionByName(fresh.select(*columns, F.lit(True).alias("_new"))).repartition(min(len(touched), self.buckets), "bucket")
        seen = Observation()
        _overwrite(rows.observe(seen, F.sum(F.col("_new").cast("long")).alias("written"), F.collect_set("bucket").alias("left")).select(*columns), self.path)
        left = set(seen.get["left"] or ())
        discard(spark, *[f"{self.path}/bucket={b}" for b in touched if b not in left])  # overwriting by nothing leaves a bucket as it was
        discard(spark, files_path)
        return {"deleted": deleted, "written": seen.get["written"] or 0}

    def delete(self, files: DataFrame) -> int:
        """Remove all rows of `files`; returns how many."""
        return self.replace(files, self.read(files.sparkSession).limit(0))["deleted"]

    def repair(self, on_disk: DataFrame) -> int:
        """Remove rows of files that `on_disk` lacks; returns how many."""
        indexed = self.read(on_disk.sparkSession).select(self.key).distinct()
        return self.delete(indexed.join(on_disk.select(self.key), self.key, "left_anti"))


@dataclass(frozen=True)
class StateTable:
    """Generations of a small table under `path`, the last of which counts."""

    path: str
    schema: str = "path string, hash string"

    def generations(self, spark: SparkSession) -> list[int]:
        fs, where = _filesystem(spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(x.split("=")[1]) for x in names if x.startswith("gen="))

    def load(self, spark: SparkSession) -> DataFrame:
        """The last generation; no rows where there is none."""
        found = self.generations(spark)
        return spark.read.schema(self.schema).parquet(f"{self.path}/gen={found[-1]}") if found else spark.createDataFrame([], self.schema)

    def save(self, rows: DataFrame) -> int:
        """Write the next generation aside and rename it into place; returns its number. Of two writers of one generation the second fails."""
        spark = rows.sparkSession
        number = (self.generations(spark) or [0])[-1] + 1
        written, aside = materialize(rows, "state")
        fs, target = _filesystem(spark, f"{self.path}/gen={number}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
            discard(spark, aside)
            raise RuntimeError(f"generation {number} of {self.path} was written by another run")
        discard(spark, *[f"{self.path}/gen={n}" for n in self.generations(spark)[:-GENERATIONS]])
        return number


@dataclass(frozen=True)
class Registry:
    """Repositories (name, collection, files, chunks) as a state table, one row a name."""

    state: StateTable

    def list(self, spark: SparkSession) -> DataFrame:
        return self.state.load(spark).orderBy("name")

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        return self.state.load(spark).where(F.col("name") == name)

    def upsert(self, rows: DataFrame) -> int:
        others = self.state.load(rows.sparkSession).join(rows.select("name"), "name", "left_anti")
        return self.state.save(others.unionByName(rows))


def commit(files: DataFrame, table: FileTable, state: StateTable, chunk: Callable[[DataFrame], DataFrame], in_scope: Column | None = None, fail: Column | None = None, partial: bool = False) -> dict[str, int]:
    """One index run over files (path, hash, text): diff, delete, chunk again, upsert, and the state last.

    `chunk` makes rows with the table's key from changed and added files. Files outside `in_scope`
    (an expression of the state's columns) keep their hashes. With `partial`, files are a batch of a
    stream: what the batch does not name is not deleted; a null text deletes. Files that `fail` selects
    are not chunked: their old rows and their hashes go, so that the next run takes them again; the
    rest of the run goes on. A run that ends before the state is saved changes no state, and doing it
    again gives the same rows.
    """
    spark, within = files.sparkSession, F.lit(True) if in_scope is None else in_scope
    gone = files.where("text IS NULL").select("path")
    current = files.where("text IS NOT NULL").select("path", "hash")
    before, before_path = materialize(state.load(spark), "state-before")
    scoped = before.where(within)
    if partial:
        scoped = scoped.join(files.select("path"), "path", "left_semi")
    diff, diff_path = materialize(state_diff(current, scoped), "diff")
    todo = files.join(diff.where("status IN ('added', 'changed')").select("path"), "path", "left_semi").where("text IS NOT NULL")
    ready = todo if fail is None else todo.where(~fail)
    touched = diff.where("status <> 'unchanged'").select(F.col("path").alias(table.key))
    if partial:
        touched = touched.union(gone).distinct()
    counts = table.replace(touched, chunk(ready), theirs=True)
    kept = before.where(~within)
    if partial:
        kept = kept.union(before.where(within).join(files.select("path"), "path", "left_anti"))
    after = kept.union(next_state(current, scoped, F.lit(True), ready.select("path").distinct()))
    generation = state.save(after)
    by_status = {r.status: r.n for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    discard(spark, before_path, diff_path)
    return {"generation": generation, **counts, **{x: by_status.get(x, 0) for x in ("added", "changed", "unchanged", "deleted")}}


def follow_changes(changes: DataFrame, table: FileTable, state: StateTable, chunk: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream of changed files (path, hash, text, ord) committed batch by batch; a null text deletes, the last row of a path in a batch counts.

    A batch that is given again after a failure finds its hashes in the state and changes nothing.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("hash", "text"), "ord").alias("x")).select("path", "x.*")
        rows, path = materialize(last, "batch")
        commit(rows, table, state, chunk, partial=True)
        discard(batch.sparkSession, path)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
