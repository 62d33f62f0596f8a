"""Helpers of the training-data operators: folds, table access, cut lineage, Arrow maps, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import shared_dir

#: Rows handed to a Python worker at once; texts may be long, so fewer than Spark's default.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is none of `taken`, also where case does not count."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from: remainder 2. A NULL id is not held out (and never learned from either)."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table of the cluster's shared folder: computed once, readable after executors are lost."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:  # workers are reused: what a task freed goes back to the system
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows that `keep()`, made once in a task, says so of by one column; all columns go along whatever their names."""
    place = df.columns.index(column)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for batch in batches:
            yield batch.filter(judge(batch.column(place)))

    return map_arrow(plain, run, plain.schema).toDF(*df.columns)


def one_each(df: DataFrame, *keys: str) -> DataFrame:
    """The least row of every key, by all columns: rows repeated any number of times count once."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def sample_runs(n: int, most: int, run: int) -> list[range]:
    """Runs of neighbours, `run` long and spread evenly over 0 .. n - 1, with `most` places in all; everything if n is no more."""
    if n <= most:
        return [range(n)]
    run = min(run, most)
    count = most // run
    return [range(at, at + run) for at in ((n - run) * k // max(1, count - 1) for k in range(count))]


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition of costly rows, which adaptive execution must not merge."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected `edges` (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps, which shrink paths to stars in a logarithmic number of
    rounds; every round is two aggregations with partial sums and two joins over edges only. Rounds are
    checkpointed in the shared folder, nothing but a row count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = cut(e, "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = cut(small, "small-star")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (now.n, now.h) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (now.n, now.h)


class Forest:
    """Links among n local nodes, kept as labels: what remains is at most one edge per node, with the same components."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        lab = self.label
        while len(i):
            a, b = lab[i], lab[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(lab, high, low)
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.flatnonzero(self.label != np.arange(len(self.label)))
        return nodes, self.label[nodes]
