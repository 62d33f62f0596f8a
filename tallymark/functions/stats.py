"""Intervals, bins and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .base import col, let


def wilson(k: str | Column, n: str | Column, z: float = V.WILSON_Z) -> Column:
    """STRUCT<lo, hi>: Wilson score interval, clamped to [0, 1]; (0, 1) for no trials."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    margin = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return F.struct(
        F.coalesce(F.greatest(F.lit(0.0), centre - margin), F.lit(0.0)).alias("lo"),
        F.coalesce(F.least(F.lit(1.0), centre + margin), F.lit(1.0)).alias("hi"),
    )


def step_bin(steps: str | Column, width: int = 2) -> Column:
    """First step count of the bin; floors, so a count of 0 falls below 1."""
    return (F.floor((col(steps) - 1) / width) * width + 1).cast("int")


def draw(size: Column, *parts: Column) -> Column:
    """Reproducible 0-based draw below `size` from a key; independent of row order and partitioning.

    NULL for size 0.
    """
    digest = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8)
    return F.try_mod(F.conv(digest, 16, 10).cast("bigint"), size).cast("int")


def bootstrap_ci(
    values: str | Column, key: str | Column, draws: int = V.BOOTSTRAP_DRAWS, seed: int = 0
) -> Column:
    """STRUCT<lo, hi>: percentile bootstrap of the mean of a short list (one value per run).

    All resamples of a key stay in its row: no row is multiplied and nothing is shuffled. Four draws are cut
    from each digest. No values give NULLs, one value gives itself.
    """

    def interval(vs: Column) -> Column:
        n = F.size(vs)

        def resample(b: Column) -> Column:
            digests = F.transform(
                F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")),
                lambda block: F.md5(F.concat_ws("|", F.lit(str(seed)), col(key), b, block).cast("binary")),
            )
            return let(
                digests,
                lambda ds: F.aggregate(
                    F.sequence(F.lit(0), n - 1),
                    F.lit(0.0),
                    lambda acc, j: acc
                    + F.get(
                        vs,
                        (
                            F.conv(
                                F.substring(F.get(ds, F.floor(j / 4).cast("int")), (j % 4) * 8 + 1, F.lit(8)), 16, 10
                            ).cast("bigint")
                            % n
                        ).cast("int"),
                    ),
                )
                / n,
            )

        means = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), resample))
        several = let(
            means,
            lambda m: F.struct(
                F.get(m, F.lit(int(0.025 * draws))).alias("lo"), F.get(m, F.lit(int(0.975 * draws))).alias("hi")
            ),
        )
        only = F.get(vs, F.lit(0))
        return F.when(n > 1, several).otherwise(F.struct(only.alias("lo"), only.alias("hi")))

    return let(col(values), interval)


def ratio(k: Column, n: Column) -> Column:
    return F.try_divide(k.cast("double"), n.cast("double"))


def percent_label(value: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(value) * 100)


def mean_std_label(mean: str | Column, std: str | Column) -> Column:
    """Three digits; halves round up, as `round` does in SQL."""
    return F.format_string("%.3f ± %.3f", col(mean), col(std))


def label_of(value: str | Column, labels: dict[str, str]) -> Column:
    """Display label; a value without one stands for itself."""
    value = col(value)
    if not labels:
        return value
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)
