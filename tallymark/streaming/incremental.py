"""Incremental scoring of append-only result logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.logs import latest
from ..sources.json_tables import parse_lines
from .runs import BUCKETS, Runs


def stream_files(
    spark: SparkSession, path: str, schema, fmt: str = "json", glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_log(spark: SparkSession, path: str, schema: str = S.DEPTH_RESULT, files_per_trigger: int | None = None) -> DataFrame:
    """A result log as a stream, with the casts, skipped lines and folder values of `json_tables.read_log`."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.load(path), schema).drop("_path")


def first_of_each(rows: DataFrame, keys: Sequence[str], event_time: str | None = None) -> DataFrame:
    """The first row of every key by `event_time`, then by a hash of all columns; rows of a hot key drop out before the shuffle."""
    # a map has no hash: rows that differ in one only are equal here
    hashed = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]
    order = [*([event_time] if event_time else []), F.xxhash64(*hashed)]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def score_incrementally(
    log: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str,
    checkpoint: str,
    event_time: str | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Score new log rows, each key once, into a parquet table; late keys are new keys like others.

    The keys written so far are the memory: they stand next to the table, in runs by key bucket, and a batch opens the
    buckets of its own keys only. So there is no state that a watermark would have to bound, and no row is lost to one.
    Of a batch's rows with one key the first by `event_time`, then by a hash of all columns, stays, so a batch replayed
    after a failure rewrites its own folder with the same rows. `buckets` is to grow with the keys, and stays for a table. Every batch leaves a numbered snapshot (`snapshots`).
    """
    spark = log.sparkSession
    done = _keys_of(spark, path, keys, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch_id={batch_id}"
        before = done.newest(before=batch_id)
        first = first_of_each(batch, keys, event_time)
        if before.runs:
            first = first.persist()  # read twice: for its buckets and for its rows
            mine = [r[0] for r in first.select(done.bucket()).distinct().collect()]  # at most the number of buckets
            fresh = _unseen(first, done.read(before, mine), keys)
        else:
            fresh = first
        score(fresh).write.mode("overwrite").option("compression", "zstd").parquet(target)
        first.unpersist()
        done.add(spark.read.parquet(target).select(*keys), batch_id, before)

    return _start(log.writeStream.foreachBatch(write), checkpoint)


def _unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the seen ones; a NULL in a key is a value like others."""
    other = seen.select(*[F.col(k).alias(f"_seen_{k}") for k in keys])
    return rows.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_seen_{k}")) for k in keys]), "left_anti")


def _keys_of(spark: SparkSession, path: str, keys: Sequence[str] = (), buckets: int = BUCKETS) -> Runs:
    """Keys that stand in a scored table, next to it and hidden from its readers."""
    return Runs(spark, f"{path}/_keys", tuple(keys), lambda rows: rows, buckets)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Numbered snapshots of a table that `score_incrementally` writes: number, rows added, rows so far."""
    versions = _keys_of(spark, path).versions()
    if versions is None:
        return spark.createDataFrame([], "snapshot LONG, n_new LONG, n_rows LONG")
    return versions.select(F.col("version").alias("snapshot"), "n_new", "n_rows")


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The scored table as it was when snapshot `number` was taken (the newest one by default).

    A snapshot is the number of its last batch: rows are never written twice, and no copy stands next to the table.
    """
    if number is None:
        number = snapshots(spark, path).agg(F.max("snapshot")).first()[0]
    rows = spark.read.parquet(path)
    return rows.filter(F.col("batch_id") <= F.lit(-1 if number is None else number)).drop("batch_id")


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_counts(
    scored: DataFrame, by: Sequence[str], path: str, checkpoint: str, correct: str = "is_correct"
) -> StreamingQuery:
    """Counts per group, kept up to date; every batch writes the changed groups as a new version."""
    counts = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("k"))

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_counts(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Current counts: the newest version of each group."""
    return latest(spark.read.parquet(path).drop("batch_id"), list(by), ["version"]).drop("version")


def _cache(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> Runs:
    return Runs(spark, path, tuple(keys), lambda rows: latest(rows, keys, order))


def upsert_cache(
    updates: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Cache in which the last write per key wins.

    Each batch adds its own last write per key as a run; full levels of runs are merged on the way, so a batch never
    rewrites the whole cache and a reader finds few runs, with few rows per live key, however many batches there were.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        _cache(spark, path, keys, order).add(latest(batch, keys, order), batch_id)

    return _start(updates.writeStream.foreachBatch(write), checkpoint)


def read_cache(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows: the latest of each key among the live runs."""
    rows = _cache(spark, path, keys, order).read()
    if rows is None:
        raise FileNotFoundError(f"no cache in '{path}'")
    return latest(rows, keys, order)
