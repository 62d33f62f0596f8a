"""Metric tables.

Each one is a single group-by over the scored rows: counts and sums combine on the map side, so what is
shuffled is one row per group and task, whatever share of the rows a group holds. Ratios are made from exact
integer counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.base import col
from ..functions.stats import label_of, mean_std_label, ratio, step_bin, wilson

MODEL_METHOD = ("model", "method")
MODEL_METHOD_DEPTH = ("model", "method", "depth")


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a NULL key; such rows belong to no group."""
    return df.dropna(subset=list(keys))


def depth_accuracy(df: DataFrame, keys: Sequence[str] = ("model", "regime"), depth: str = "depth") -> DataFrame:
    """n_total, n_correct, n_collapse, acc, collapse_rate, step_acc per key and depth.

    step_acc is the mean share of steps solved before the first error; without a `first_error_step` column
    all steps count as solved.
    """
    by = [*keys, depth]
    solved = F.col(depth)
    if "first_error_step" in df.columns:
        solved = F.coalesce(F.col("first_error_step") - 1, F.col(depth))
    share = F.greatest(F.lit(0), F.least(F.col(depth), solved)) / F.col(depth)
    return (
        known_keys(df, by)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if("is_correct").alias("n_correct"),
            F.count_if("is_collapse").alias("n_collapse"),
            F.avg(share).alias("step_acc"),
        )
        .withColumn("acc", ratio(F.col("n_correct"), F.col("n_total")))
        .withColumn("collapse_rate", ratio(F.col("n_collapse"), F.col("n_total")))
    )


def with_interval(counted: DataFrame, z: float = V.WILSON_Z) -> DataFrame:
    """Adds acc, ci_lo and ci_hi to a table with k and n."""
    return (
        counted.withColumn("acc", F.coalesce(ratio(F.col("k"), F.col("n")), F.lit(0.0)))
        .withColumn("_ci", wilson("k", "n", z))
        .withColumn("ci_lo", F.col("_ci.lo"))
        .withColumn("ci_hi", F.col("_ci.hi"))
        .drop("_ci")
    )


def accuracy(
    df: DataFrame, by: Sequence[str] = MODEL_METHOD_DEPTH, correct: str = "correct", z: float = V.WILSON_Z
) -> DataFrame:
    """n, k, acc and Wilson interval per group."""
    counted = (
        known_keys(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("k"))
    )
    return with_interval(counted, z)


def accuracy_by_bin(
    df: DataFrame, steps: str = "estimated_steps", width: int = 2, correct: str = "correct"
) -> DataFrame:
    """Accuracy per step-count bin."""
    return accuracy(df.withColumn("step_bin", step_bin(steps, width)), (*MODEL_METHOD, "step_bin"), correct)


def accuracy_rollup(df: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Accuracy per key value plus one row for all (key NULL, is_total 1)."""
    return (
        known_keys(df, [key])
        .rollup(key)
        .agg(
            F.grouping(key).cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(correct).alias("k"),
        )
        .withColumn("acc", ratio(F.col("k"), F.col("n")))
    )


def chunk_diagnostics(df: DataFrame, by: Sequence[str] = ("model", "depth")) -> DataFrame:
    """Mean corrections, fallbacks, extraction failures and chunks per problem."""
    return (
        known_keys(df, by)
        .groupBy(*by)
        .agg(
            F.avg("corrections_applied").alias("corrections_per_prob"),
            F.avg("unverified_fallbacks").alias("fallbacks_per_prob"),
            F.avg("extraction_failures").alias("ext_fail_per_prob"),
            F.avg("num_chunks").alias("chunks_per_prob"),
        )
    )


def run_summary(df: DataFrame, depth: str = "depth") -> DataFrame:
    """Per depth and overall (is_total 1): n, acc, diagnostics per problem, total corrections."""
    return (
        known_keys(df, [depth])
        .rollup(depth)
        .agg(
            F.grouping(depth).cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("correct").alias("k"),
            F.sum("corrections_applied").alias("corrections"),
            F.avg("corrections_applied").alias("corrections_per_prob"),
            F.avg("unverified_fallbacks").alias("unverified_per_prob"),
            F.avg("extraction_failures").alias("ext_fail_per_prob"),
        )
        .withColumn("acc", ratio(F.col("k"), F.col("n")))
    )


def macro_mean(metric: DataFrame, by: Sequence[str] = MODEL_METHOD, *columns: str) -> DataFrame:
    """Unweighted mean of metric columns over the remaining keys."""
    names = columns or ("acc",)
    return metric.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in names])


def variant_accuracy(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """n_correct, n_evaluated, n_skipped_no_gold and accuracy (0 when nothing was evaluated)."""
    return (
        df.groupBy(*by)
        .agg(
            F.count_if("correct").alias("n_correct"),
            F.count_if("evaluated").alias("n_evaluated"),
            F.count_if(~F.col("evaluated")).alias("n_skipped_no_gold"),
        )
        .withColumn("accuracy", F.coalesce(ratio(F.col("n_correct"), F.col("n_evaluated")), F.lit(0.0)))
    )


def depth_ceiling(
    acc: DataFrame, keys: Sequence[str] = ("model", "regime"), drop: float = V.CEILING_DROP
) -> DataFrame:
    """First depth whose accuracy falls below `(1 - drop)` of that at depth 1; NULL if none.

    Groups without depth 1 have no baseline and no row.
    """
    baseline = F.max(F.when(F.col("depth") == 1, F.col("acc"))).over(W.partitionBy(*keys))
    limit = F.col("baseline") * (1 - drop)
    return (
        acc.withColumn("baseline", baseline)
        .filter(F.col("baseline").isNotNull())
        .groupBy(*keys)
        .agg(
            F.round(F.max("baseline"), 4).alias("baseline_acc"),
            F.round(F.max(limit), 4).alias("threshold"),
            F.min(F.when((F.col("depth") > 1) & (F.col("acc") < limit), F.col("depth"))).alias("k_star"),
        )
    )


def best_model(acc: DataFrame, by: Sequence[str] = ("regime",)) -> DataFrame:
    """Model with the greatest mean accuracy; the first by name on a tie."""
    means = acc.groupBy(*by, "model").agg(F.avg("acc").alias("mean_acc"))
    return means.groupBy(*by).agg(
        F.min(F.struct((-F.col("mean_acc")).alias("order"), "model")).alias("best")
    ).select(*by, F.col("best.model").alias("model"), (-F.col("best.order")).alias("mean_acc"))


def value_profile(df: DataFrame, by: Sequence[str], value: str = "ground_truth") -> DataFrame:
    """Count, minimum and maximum of a value per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value")
    )


def preparation_profile(df: DataFrame, min_steps: int = V.MIN_STEPS) -> DataFrame:
    """One row: totals, skipped by reason, kept, step range and upper median of the kept rows.

    The upper median is the discrete median from above, so it needs a count per distinct step number only.
    """
    kept = F.col("ground_truth").isNotNull() & (F.col("estimated_steps") >= min_steps)
    steps = F.when(kept, F.col("estimated_steps"))
    return df.select("ground_truth", "estimated_steps", steps.alias("kept_steps")).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("ground_truth").isNull()).alias("n_no_gold"),
        F.count_if(F.col("ground_truth").isNotNull() & (F.col("estimated_steps") < min_steps)).alias("n_few_steps"),
        F.count("kept_steps").alias("n_kept"),
        F.min("kept_steps").alias("min_steps"),
        F.max("kept_steps").alias("max_steps"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY kept_steps DESC)").cast("int").alias("median_steps"),
    )


def model_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct models and records per load."""
    return df.groupBy(*by).agg(F.count_distinct("model").alias("n_models"), F.count(F.lit(1)).alias("n_records"))


def wide(metric: DataFrame, index: str, column: str, values: Sequence, value: str = "acc", prefix: str = "") -> DataFrame:
    """One row per index value and one column per listed value; a missing cell is NULL."""
    cells = [
        F.max(F.when(F.col(column) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in values
    ]
    return metric.groupBy(index).agg(*cells)


def wide_mean_std(metric: DataFrame, depths: Sequence[int], mean: str = "acc", std: str = "std_acc") -> DataFrame:
    """`mean ± std` texts per model and depth."""
    return wide(metric.withColumn("cell", mean_std_label(mean, std)), "model", "depth", depths, "cell", "d")


def corrections_table(df: DataFrame, models: Sequence[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Row per depth (`d1` …), mean corrections and fallbacks per model as three-digit texts."""
    labels = V.MODEL_LABELS if labels is None else labels
    cells = []
    for m in models:
        name = labels.get(m, m)
        for source, title in (("corrections_applied", "Corrections"), ("unverified_fallbacks", "Fallbacks")):
            mean = F.avg(F.when(F.col("model") == m, F.col(source)))
            cells.append(F.when(mean.isNotNull(), F.format_string("%.3f", mean)).alias(f"{name} - {title}"))
    return known_keys(df, ["depth", "model"]).groupBy(
        F.concat(F.lit("d"), F.col("depth").cast("string")).alias("Depth")
    ).agg(*cells)


def dense_grid(metric: DataFrame, depths: Sequence[int], value: str = "acc") -> DataFrame:
    """Every model at every listed depth; a missing cell is 0.

    A metric table holds one row per model and depth, so a model's cells fit one small map; no join is needed.
    """
    cells = metric.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("depth", value))).alias("cells")
    )
    return cells.select("model", "cells", F.explode(F.lit(list(depths)).cast("array<int>")).alias("depth")).select(
        "model", "depth", F.coalesce(F.try_element_at("cells", F.col("depth")), F.lit(0.0)).alias(value)
    )


def labelled(df: DataFrame, column: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Replace a column by its display label."""
    return df.withColumn(column, label_of(column, V.MODEL_LABELS if labels is None else labels))


def depth_label(depth: str | Column) -> Column:
    return F.concat(F.lit("d"), col(depth).cast("string"))
