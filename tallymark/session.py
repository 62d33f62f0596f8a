"""Session helpers: a tuned local session for tests and the shared work folder of a cluster."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tallymark") -> SparkSession:
    """Local session for tests and the bench; a cluster session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_root() -> str:
    """The folder of a local session without the setting, one for the process."""
    return tempfile.mkdtemp(prefix="run-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster its lack is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return os.path.join(root, "tallymark", f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str, per_split: int = 1) -> DataFrame:
    """Use all cores for a table scan whose rows come in few, compact splits but are costly to process.

    A large table has more splits than cores and is left as it is, without a shuffle. `per_split` is for narrow rows that
    grow many times in their task: each split is dealt to so many tasks, since a split of such rows alone can be hours of
    work (and some splits have no row group, and no rows). For scans only: asking a plan with a shuffle for its partitions
    would run it.
    """
    splits = df.rdd.getNumPartitions()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, splits * per_split)
    return df if splits >= tasks else df.repartition(tasks, *keys)
