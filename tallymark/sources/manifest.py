"""Commits of a folder that is written batch by batch: a batch counts once its name stands in the manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Hidden from readers of the data, as every name with a leading underscore is.
_FOLDER = "_committed"


def read_or_none(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType) -> DataFrame | None:
    """The table at `path`, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Names of the committed batches as rows (batch), or None for a folder without a manifest."""
    found = read_or_none(spark, f"{path}/{_FOLDER}", "json", "batch STRING")
    return None if found is None else found.distinct()


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    found = committed(spark, path)
    return found is not None and not found.filter(found.batch == batch).isEmpty()


def commit(spark: SparkSession, path: str, batch: str) -> None:
    """One row of its own file; written after the batch, so a batch that failed halfway stays unseen."""
    spark.createDataFrame([(batch,)], "batch STRING").coalesce(1).write.mode("append").json(f"{path}/{_FOLDER}")
