"""Writers. Tasks commit their own files; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from .manifest import commit, is_committed


def _laid_out(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Few files per directory: rows of a directory meet in few tasks, AQE splits a directory that is too large."""
    return df.hint("rebalance", *partition_by) if partition_by else df


#: JSON lines repeat their field names and texts: the fastest gzip level leaves a small part of the bytes.
GZIPPED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: A gzip file is read by one task, so a file holds no more rows than this.
ROWS_PER_FILE = 100_000


def _write_lines(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    writer = _laid_out(df, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.options(maxRecordsPerFile=ROWS_PER_FILE, **GZIPPED).json(path)


def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Whole result set as JSON lines, gzipped, in files of bounded length."""
    _write_lines(df, path, partition_by)
    return path


def write_lines(df: DataFrame, path: str) -> str:
    """A column of lines as they are, gzipped, in files of bounded length."""
    df.write.mode("overwrite").options(maxRecordsPerFile=ROWS_PER_FILE, **GZIPPED).text(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """An intermediate table in Parquet, for rows that several writes or reads need."""
    _laid_out(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return path


def write_documents(df: DataFrame, path: str, per_file: int = 1000) -> str:
    """JSON documents: each file is one array of at most `per_file` records, over several lines.

    The files are those of Spark's text writer, `*.txt`. Records that a task holds next to each other share a file, so the number of files is that of the records divided by
    `per_file`, and one more for the last ones of each task.
    """
    place = F.monotonically_increasing_id()  # the task's number in the upper bits, the row's in the lower 33
    records = df.select(F.to_json(F.struct("*")).alias("_json"), place.alias("_place"))
    group = F.concat_ws(",", F.shiftright("_place", 33), F.floor(F.col("_place").bitwiseAND((1 << 33) - 1) / per_file))
    records = records.withColumn("_group", group)
    document = F.concat(F.lit("[\n"), F.array_join(F.collect_list("_json"), ",\n"), F.lit("\n]"))
    documents = records.groupBy("_group").agg(document.alias("value")).select("value")
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def append_log(df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ("model", "regime")) -> str:
    """Append the rows of one named batch to a result log laid out by model and regime.

    The batch is written to a folder of its own and counts once it stands in the manifest of the log: an append that is
    tried again after a failure replaces what the first try left, and one that had succeeded adds nothing.
    """
    spark = df.sparkSession
    if not is_committed(spark, path, batch):
        _write_lines(df, f"{path}/batch={quote(batch, safe='')}", partition_by)
        commit(spark, path, batch)
    return path


def append_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> str:
    """Append to a log that is a table in buckets by its keys; the first call makes the table, at `path` if one is given.

    Rows of a bucket meet in one task before the write, so an append adds one file to each bucket. Joins and group-bys on
    the keys read the log without a shuffle. Unlike `append_log`, an append that is tried again adds its rows again.
    """
    writer = df.repartition(buckets, *keys).write.mode("append").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    """Metric table as one CSV file with a header, sorted by `order`.

    Metric tables are small; the shuffle into one partition keeps the stages before it parallel.
    """
    one = df.repartition(1)
    (one.sortWithinPartitions(*order) if order else one).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_by_depth(df: DataFrame, path: str) -> str:
    """One directory per depth; the root is the combined set."""
    return write_json(df, path, ("depth",))


def model_config(model_id: Column, short_name: Column, family: Column, dtype: Column) -> Column:
    return F.struct(
        model_id.alias("model_id"), short_name.alias("short_name"), family.alias("family"), dtype.alias("dtype")
    )


def report(metric: DataFrame, meta: dict[str, Column] | None = None) -> DataFrame:
    """One JSON document: run metadata and, per variant, the metrics of each model.

    Only the metric table goes into the document; per-row results stay a table of their own.
    """
    block = metric.groupBy("variant").agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(
                    F.struct("model", F.struct("accuracy", "n_correct", "n_evaluated", "n_skipped_no_gold").alias("m"))
                )
            )
        ).alias("models")
    )
    meta_column = F.struct(
        *[c.alias(n) for n, c in (meta or {"system_prompt": F.lit(V.SYSTEM_SOLVE)}).items()]
    )
    document = block.agg(
        *[F.first(F.when(F.col("variant") == v, F.col("models")), True).alias(v) for v in ("original", "enhanced")]
    )
    return document.select(F.to_json(F.struct(meta_column.alias("meta"), "original", "enhanced")).alias("value"))


def write_report(metric: DataFrame, path: str, meta: dict[str, Column] | None = None) -> str:
    report(metric, meta).write.mode("overwrite").text(path)
    return path
