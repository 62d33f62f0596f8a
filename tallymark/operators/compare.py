"""Comparisons between variants, methods and models.

All inputs are metric tables or scored rows; where two sides come from the same rows they are compared inside
one group-by or window over the metric table instead of joining it with itself, so the rows are scored once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def variant_drop(
    metric: DataFrame, original: str = "original", changed: str = "enhanced", variant: str = "variant"
) -> DataFrame:
    """Accuracy on both variants and the drop, for models that have both."""
    both = metric.groupBy("model").agg(
        F.max(F.when(F.col(variant) == original, F.col("accuracy"))).alias("acc_original"),
        F.max(F.when(F.col(variant) == changed, F.col("accuracy"))).alias("acc_enhanced"),
    )
    return both.dropna(subset=["acc_original", "acc_enhanced"]).withColumn(
        "drop", F.col("acc_original") - F.col("acc_enhanced")
    )


def two_runs(first: DataFrame, second: DataFrame, value: str = "accuracy") -> DataFrame:
    """Models of both metric tables with their values and the difference."""
    a = first.select("model", F.col(value).alias("acc_first"))
    b = second.select("model", F.col(value).alias("acc_second"))
    return a.join(b, "model").withColumn("difference", F.col("acc_second") - F.col("acc_first"))


def require_overlap(joined: DataFrame) -> DataFrame:
    """Raise if two metric tables share no model."""
    if joined.isEmpty():
        raise ValueError("no overlapping models")
    return joined


def gap_to_reference(acc: DataFrame, reference: str | None = None) -> DataFrame:
    """Gap of every other model to the reference model of its regime at the same depth.

    Without a named reference it is the model with the greatest mean accuracy (first by name on a tie). The gap
    is NULL where the reference has no value at that depth.
    """
    if reference is None:
        mean = F.avg("acc").over(W.partitionBy("regime", "model"))
        ranked = W.partitionBy("regime").orderBy(F.col("_mean").desc(), "model")
        tagged = acc.withColumn("_mean", mean).withColumn("ref_model", F.first("model").over(ranked)).drop("_mean")
    else:
        tagged = acc.withColumn("ref_model", F.lit(reference))
    is_ref = F.col("model") == F.col("ref_model")
    ref_acc = F.max(F.when(is_ref, F.col("acc"))).over(W.partitionBy("regime", "depth"))
    return (
        tagged.withColumn("ref_acc", ref_acc)
        .filter(~is_ref)
        .select("model", "regime", "depth", "acc", "ref_model", "ref_acc", (F.col("ref_acc") - F.col("acc")).alias("gap"))
    )


def method_delta(
    metric: DataFrame, keys: Sequence[str] = ("model", "depth"), base: str = "cot", method: str = "chunked"
) -> DataFrame:
    """Accuracy of two methods and their difference where both exist."""
    both = metric.groupBy(*keys).agg(
        F.max(F.when(F.col("method") == base, F.col("acc"))).alias("acc_base"),
        F.max(F.when(F.col("method") == method, F.col("acc"))).alias("acc_method"),
    )
    return both.dropna(subset=["acc_base", "acc_method"]).withColumn(
        "delta", F.col("acc_method") - F.col("acc_base")
    )


def shared_keys(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    return first.select(*keys).intersect(second.select(*keys))


def all_keys(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    return first.select(*keys).union(second.select(*keys)).distinct()


def stack_methods(*frames: DataFrame, columns: Sequence[str] = ("model", "method", "depth", "correct")) -> DataFrame:
    """One table of all methods on common columns; ids differ between methods and become text."""
    out = None
    for frame in frames:
        part = frame.select(*columns)
        if "problem_id" in columns:
            part = part.withColumn("problem_id", F.col("problem_id").cast("string"))
        out = part if out is None else out.unionByName(part)
    return out
