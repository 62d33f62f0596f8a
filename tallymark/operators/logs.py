"""Append-only result logs: resume, latest record, running figures, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows whose key is not in the log yet; rows with a NULL in their key are always pending.

    The log is read without a shuffle where it is bucketed by the keys (`sinks.append_bucketed`).
    """
    return planned.join(done.select(*keys), list(keys), "left_anti")


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last record per key; a maximum of structs, so a hot key combines on the map side.

    Finding the maximum of the leading order column first, by hash, and the structs of its ties after a join was slower
    on few, on many and on hot keys: it reads the log twice and ships whole rows of a key that here combine first.
    """
    rest = [c for c in log.columns if c not in keys and c not in order]
    top = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in [*order, *rest]]).select(*log.columns)


def serve_from_cache(
    examples: DataFrame, cache: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(examples with their latest cached record, examples still to be processed)."""
    current = latest(cache, keys, order)
    return examples.join(current, list(keys)), pending(examples, current, keys)


def first_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """First n rows per group; each task drops all but its first n before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _in_ranges(rows: DataFrame, order: Sequence[str], parts: int | None) -> DataFrame:
    """The rows with _part and _tie: sorted by `order`, then _tie, they run through the parts one after another.

    Parts are balanced by a sample; _tie keeps rows that are equal in `order` (a hot key without order values, say) from
    having to share a part. The table is written once, since a range that is sampled again could have other bounds.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]  # a map has no hash
    tied = rows.withColumn("_tie", F.struct(F.xxhash64(*hashed).alias("h"), F.monotonically_increasing_id().alias("i")))
    ranged = tied.repartitionByRange(parts, *order, "_tie").withColumn("_part", F.spark_partition_id())
    path, schema = shared_dir(spark, "ranges"), ranged.schema
    ranged.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """Adds the 1-based place of each row by `order`: places inside range parts, plus one offset for each part."""
    rows = _in_ranges(df, order, parts)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order, "_tie"))
    return rows.join(offsets, "_part").select(*df.columns, place.alias(name))


def running_totals(
    log: DataFrame,
    key: str,
    order: Sequence[str],
    totals: dict[str, Column],
    every: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running row number and running sums per key, optionally only at every n-th row.

    Distributed prefix sums: the log is cut into balanced ranges of (key, order), rows are numbered and summed inside a
    range, and one row per key and range gives the offsets. No window spans a key, or all rows that are equal in it.
    NULL keys and NULL order values are values like others, NULLs first.
    """
    sums = list(totals)
    narrow = log.select(key, *order, *[c.alias(n) for n, c in totals.items()])
    rows = _in_ranges(narrow, [key, *order], parts)
    per_part = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_row_count"), *[F.sum(n).alias(f"_{n}") for n in sums])
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col(key).alias("_key"),
        F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in ("row_count", *sums)],
    )
    inside = W.partitionBy("_part", key).orderBy(*order, "_tie")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = (
        rows.join(offsets, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
        .withColumn("row_no", F.col("_row_count_before") + F.row_number().over(inside))
        .select(
            key,
            *order,
            "row_no",
            # NULL values add nothing
            *[(F.col(f"_{n}_before") + F.coalesce(F.sum(n).over(upto), F.lit(0))).alias(f"running_{n}") for n in sums],
        )
    )
    return out if every is None else out.filter(F.col("row_no") % every == 0)
