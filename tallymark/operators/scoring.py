"""Score recorded responses; every function is a narrow projection, one output row per input row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import fixed as V
from ..functions.base import col, none_if_empty


def keep_complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose required texts are neither NULL nor empty."""
    for name in columns:
        df = df.filter(F.col(name) != "")
    return df


def capture_errors(df: DataFrame, response: str = "response", error: str = "error") -> DataFrame:
    """A failed call stays in the log as `[ERROR: …]`, to be evaluated like any other response."""
    text = F.when(F.col(error).isNotNull(), F.concat(F.lit("[ERROR: "), F.col(error), F.lit("]")))
    return df.withColumn(response, F.coalesce(text, F.col(response)))


def score_depth_log(
    df: DataFrame,
    response: str = "response",
    gold: str = "ground_truth",
    expected: str = "intermediate_values",
    tolerance: float = V.DEPTH_TOLERANCE,
    step_tolerance: float = V.STEP_TOLERANCE,
) -> DataFrame:
    """Adds predicted, is_correct, is_collapse and first_error_step."""
    return (
        df.withColumn("predicted", A.reported_answer(response))
        .withColumn("is_correct", A.match_percent(gold, "predicted", tolerance))
        .withColumn("is_collapse", F.col("predicted").isNull())
        .withColumn("first_error_step", A.first_error_step(response, expected, step_tolerance))
    )


def score_qa_log(df: DataFrame, response: str = "response", gold: str = "ground_truth") -> DataFrame:
    """Adds predicted, is_correct and is_collapse for problems with one numeric gold value."""
    return (
        df.withColumn("predicted", A.numeric_answer(response))
        .withColumn("is_correct", A.match_scaled(gold, "predicted"))
        .withColumn("is_collapse", F.col("predicted").isNull())
    )


def gold_text(answer: str | Column) -> Column:
    """Gold answer as text: the `####` line, else whatever the response cascade finds."""
    return F.coalesce(A.hash_answer(none_if_empty(col(answer))), A.final_answer(answer))


def score_variant_log(
    df: DataFrame, response: str = "response", answer: str = "answer", error: str | None = None
) -> DataFrame:
    """Adds ground_truth_extracted, predicted_extracted, correct, evaluated and error.

    Rows without a gold answer stay, count as wrong and are not evaluated; failed calls are evaluated and wrong.
    """
    failure = F.col(error) if error else F.lit(None).cast("string")
    gold = F.col("ground_truth_extracted")
    usable = gold.isNotNull() & failure.isNull()
    return (
        df.withColumn("ground_truth_extracted", gold_text(answer))
        .withColumn("predicted_extracted", F.when(usable, A.final_answer(response)))
        .withColumn("correct", F.when(usable, A.match_relative(gold, "predicted_extracted")).otherwise(False))
        .withColumn("evaluated", gold.isNotNull())
        .withColumn("error", F.when(gold.isNull(), "failed to extract gold answer").otherwise(failure))
    )


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill optional fields and cast them to the type of their default."""
    types = {bool: "boolean", int: "int", float: "double", str: "string"}
    for name, value in defaults.items():
        typed = F.lit(value).cast(types[type(value)])
        known = F.col(name).cast(types[type(value)]) if name in df.columns else typed
        df = df.withColumn(name, F.coalesce(known, typed))
    return df


def step_count(df: DataFrame, *candidates: str) -> Column:
    """First present and non-NULL of the candidate columns, else 0."""
    present = [F.col(c).cast("int") for c in candidates if c in df.columns]
    return F.coalesce(*present, F.lit(0))


def stable_id(df: DataFrame, sequence: str, *candidates: str) -> Column:
    """First non-NULL candidate, else `prob_%04d` of a sequence column."""
    present = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*present, F.format_string(V.SEQUENCE_ID, F.col(sequence)))


def select_members(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """Keep rows of the named members; no names means all of them."""
    return df if not names else df.filter(F.col(column).isin(names))


def unknown_names(spark, requested: list[str], known: DataFrame) -> DataFrame:
    """Requested names that do not occur in the first column of `known`."""
    wanted = spark.createDataFrame([(n,) for n in requested], "name STRING")
    return wanted.join(known.select(F.col(known.columns[0]).alias("name")).distinct(), "name", "left_anti")


def require_known(spark, requested: list[str], known: DataFrame) -> None:
    """Raise for names that do not exist (the answer holds at most the requested names)."""
    missing = sorted(r["name"] for r in unknown_names(spark, requested, known).collect())
    if missing:
        raise ValueError(f"unknown names: {missing}")
