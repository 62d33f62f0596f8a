"""Two-stage evaluation: label clauses, solve the relevant text, analyse what the filter caught."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import clauses as C
from ..functions import fixed as V
from ..functions.stats import label_of, ratio
from .scoring import gold_text


def filter_records(df: DataFrame, response: str = "filter_response", question: str = "question") -> DataFrame:
    """Adds relevant_clauses, irrelevant_clauses, their numbers, filter_failed and clean_problem."""
    return (
        df.withColumn("_lines", C.parse_filter_lines(response))
        .withColumn("relevant_clauses", F.col("_lines.relevant"))
        .withColumn("irrelevant_clauses", F.col("_lines.irrelevant"))
        .drop("_lines")
        .withColumn("n_relevant", F.size("relevant_clauses"))
        .withColumn("n_irrelevant", F.size("irrelevant_clauses"))
        .withColumn("filter_failed", F.col("n_relevant") == 0)
        .withColumn(
            "clean_problem",
            F.when(F.col("filter_failed"), F.col(question)).otherwise(F.array_join("relevant_clauses", " ")),
        )
    )


def attach_filter(examples: DataFrame, records: DataFrame, key: str = "problem_id") -> DataFrame:
    """Examples with their filter record, matched by id."""
    return examples.join(records, key)


def score_solutions(df: DataFrame, answer: str = "answer", response: str = "solve_response") -> DataFrame:
    """Adds ground_truth, predicted and is_correct."""
    return (
        df.withColumn("ground_truth", gold_text(answer))
        .withColumn("predicted", A.final_answer(response))
        .withColumn("is_correct", A.match_relative(F.coalesce("ground_truth", F.lit("")), "predicted"))
    )


def _share(condition: Column) -> Column:
    return ratio(F.count_if(condition & F.col("is_correct")), F.count_if(condition))


def filter_summary(df: DataFrame, by: Sequence[str] = ("solver_model",)) -> DataFrame:
    """Accuracy overall and by filter outcome, failure rate, clauses kept and removed.

    Needs the numbers of clauses only, so that no clause text has to go through a join; the lists serve where they lack.
    """
    failed = F.coalesce(F.col("filter_failed"), F.lit(False))

    def number(kind: str) -> Column:
        if f"n_{kind}" in df.columns:
            return F.coalesce(F.col(f"n_{kind}"), F.lit(0))
        return F.size(F.coalesce(F.col(f"{kind}_clauses"), F.array().cast("array<string>")))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if("is_correct"), F.count(F.lit(1))).alias("accuracy"),
        F.count_if(~failed).alias("n_filter_ok"),
        _share(~failed).alias("acc_filter_ok"),
        F.count_if(failed).alias("n_filter_failed"),
        _share(failed).alias("acc_filter_failed"),
        ratio(F.count_if(failed), F.count(F.lit(1))).alias("fail_rate"),
        F.avg(number("relevant")).alias("avg_relevant"),
        F.avg(number("irrelevant")).alias("avg_irrelevant"),
    )


def known_type(df: DataFrame, column: str = "distractor_type") -> DataFrame:
    return df.withColumn(column, F.coalesce(column, F.lit("UNKNOWN")))


def accuracy_by_type(df: DataFrame, by: Sequence[str] = ("solver_model",)) -> DataFrame:
    """Accuracy per distractor type, for groups that have more than one type."""
    counted = (
        known_type(df)
        .groupBy(*by, "distractor_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("k"))
    )
    types = F.count(F.lit(1)).over(W.partitionBy(*by))
    return (
        counted.withColumn("_types", types)
        .filter(F.col("_types") > 1)
        .drop("_types")
        .withColumn("acc", ratio(F.col("k"), F.col("n")))
    )


def detection_table(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Detection rate per distractor type plus an OVERALL row."""
    labels = V.DISTRACTOR_LABELS if labels is None else labels
    detected = C.distractor_detected("distractor", "irrelevant_clauses")
    table = (
        known_type(df)
        .select("distractor_type", detected.alias("_hit"))
        .rollup("distractor_type")
        .agg(
            F.grouping("distractor_type").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            F.count_if("_hit").alias("detected"),
        )
    )
    is_all = F.col("_all") == 1
    return table.select(
        F.when(is_all, "OVERALL").otherwise(F.col("distractor_type")).alias("distractor_type"),
        F.when(is_all, "").otherwise(label_of("distractor_type", labels)).alias("description"),
        "n",
        "detected",
        ratio(F.col("detected"), F.col("n")).alias("rate"),
    )
