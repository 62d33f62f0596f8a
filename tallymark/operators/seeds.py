"""Aggregation over repeated runs ("seeds").

The seed is a column. Two group-bys: per-seed accuracy from the rows, then statistics over the seeds of each
cell of that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.stats import bootstrap_ci
from .compare import method_delta
from .metrics import MODEL_METHOD_DEPTH, accuracy, chunk_diagnostics


def sample_std(c: str) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def by_seed(value: str) -> Column:
    """Values of a cell in seed order (one per run)."""
    return F.transform(F.sort_array(F.collect_list(F.struct("seed", value))), lambda s: s[value])


def seed_accuracy(df: DataFrame, by: Sequence[str] = MODEL_METHOD_DEPTH, correct: str = "correct") -> DataFrame:
    return accuracy(df, ["seed", *by], correct)


def with_bootstrap(
    grouped: DataFrame, values: str, by: Sequence[str], draws: int = V.BOOTSTRAP_DRAWS, seed: int = 0
) -> DataFrame:
    """Adds ci_lo and ci_hi from a list of per-seed values.

    One cell costs `draws` resamples, so the few cells are spread over the cores first.
    """
    cores = grouped.sparkSession.sparkContext.defaultParallelism
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in by])
    return (
        grouped.repartition(cores, *by)
        .withColumn("_ci", bootstrap_ci(values, key, draws, seed))
        .withColumn("ci_lo", F.col("_ci.lo"))
        .withColumn("ci_hi", F.col("_ci.hi"))
        .drop("_ci", values)
    )


def across_seeds(
    per_seed: DataFrame,
    seeds: Sequence[str] = (),
    by: Sequence[str] = MODEL_METHOD_DEPTH,
    draws: int = V.BOOTSTRAP_DRAWS,
) -> DataFrame:
    """n_seeds, mean, sample std, bootstrap interval and one `acc_<seed>` column per listed seed.

    Cells missing in a seed contribute nothing.
    """
    grouped = per_seed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("acc").alias("acc"),
        sample_std("acc").alias("std_acc"),
        by_seed("acc").alias("_values"),
        *[F.max(F.when(F.col("seed") == s, F.col("acc"))).alias(f"acc_{s}") for s in seeds],
    )
    return with_bootstrap(grouped, "_values", by, draws)


def macro_across_seeds(per_seed: DataFrame) -> DataFrame:
    """Mean over depths per seed, then mean and std over the seeds."""
    per_run = per_seed.groupBy("seed", "model", "method").agg(F.avg("acc").alias("acc"))
    return per_run.groupBy("model", "method").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("acc").alias("mean_acc"), sample_std("acc").alias("std_acc")
    )


def diagnostics_across_seeds(df: DataFrame) -> DataFrame:
    """Mean and std over the seeds of the chunk diagnostics per model and depth."""
    per_run = chunk_diagnostics(df, ("seed", "model", "depth"))
    names = ["corrections_per_prob", "fallbacks_per_prob", "ext_fail_per_prob", "chunks_per_prob"]
    return per_run.groupBy("model", "depth").agg(
        *[F.avg(n).alias(f"mean_{n}") for n in names], *[sample_std(n).alias(f"std_{n}") for n in names]
    )


def delta_across_depths(ms_acc: DataFrame, base: str = "cot", method: str = "chunked") -> DataFrame:
    """Mean difference of two methods over their common depths, with its std, per model."""
    return method_delta(ms_acc, ("model", "depth"), base, method).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_depths"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_samp("delta").alias("std_delta"),
    )


def delta_across_seeds(
    per_seed: DataFrame, base: str = "cot", method: str = "chunked", draws: int = V.BOOTSTRAP_DRAWS
) -> DataFrame:
    """Difference of the two methods' means over all seeds at each depth.

    The bootstrap interval is of the differences in seeds that have both methods; without such a seed it is the mean.
    """
    means = method_delta(
        per_seed.groupBy("model", "method", "depth").agg(F.avg("acc").alias("acc")), ("model", "depth"), base, method
    ).select("model", "depth", F.col("delta").alias("mean_delta"))
    paired = method_delta(per_seed, ("seed", "model", "depth"), base, method)
    paired = paired.groupBy("model", "depth").agg(F.count(F.lit(1)).alias("n_seeds"), by_seed("delta").alias("_values"))
    grouped = means.join(paired, ["model", "depth"], "left").select(
        "model", "depth", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), "mean_delta",
        F.coalesce("_values", F.array().cast("array<double>")).alias("_values"),
    )
    out = with_bootstrap(grouped, "_values", ("model", "depth"), draws)
    return out.withColumns({c: F.coalesce(c, "mean_delta") for c in ("ci_lo", "ci_hi")})


def first_seed(df: DataFrame) -> DataFrame:
    """Label of the representative run: the first in text order."""
    return df.agg(F.min("seed").alias("seed"))
