"""Keyed rows that grow batch by batch: runs by key bucket, a version that names the live runs, merges of like runs.

Every batch writes its rows as one run, a folder with one sub-folder for each bucket of the key's hash, and then a version,
one small file that lists the runs that count. Readers follow the newest version, so a batch that fails halfway is never
seen and a batch that runs again replaces its own run and version. Runs of one level that reach `FAN` are merged into one of
the next level in which each key stands once; so the live runs stay few (FAN for each power of FAN in the number of
batches) and hold at most one row per key and level. Folders of merged runs stay for readers that still follow an older version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import read_or_none

FAN = 4
BUCKETS = 8
_RUN, _BUCKET = "_run", "_bucket"


_VERSION = "version LONG, runs ARRAY<STRING>, n_new LONG, n_rows LONG"


@dataclass(frozen=True)
class Version:
    """Names (L<level>-<batch>) of the runs that count, and how many rows their batches have added."""

    runs: tuple[str, ...] = ()
    n_rows: int = 0


@dataclass(frozen=True)
class Runs:
    """A table of runs at `path`, keyed by `keys`; `latest` keeps one row of each key in a merge."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    latest: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def newest(self, before: int | None = None) -> Version:
        """The newest version, or the newest one below `before`."""
        versions = read_or_none(self.spark, f"{self.path}/versions", "json", _VERSION)
        if versions is None:
            return Version()
        if before is not None:
            versions = versions.filter(F.col("version") < before)
        row = versions.agg(F.max_by(F.struct("runs", "n_rows"), "version").alias("v")).first().v
        return Version(tuple(row.runs), row.n_rows) if row else Version()

    def _read(self, runs: Sequence[str]) -> DataFrame:
        base = f"{self.path}/runs"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/{_RUN}={r}" for r in runs]).drop(_RUN)

    def _write(self, rows: DataFrame, run: str) -> None:
        """Rows of a bucket meet in one task and lie there by key."""
        dealt = rows.withColumn(_BUCKET, self.bucket()).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/runs/{_RUN}={run}")

    def read(self, version: Version | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of the live runs, one or more of a key (the caller takes its latest); only the named buckets are opened.

        None where there is no run yet.
        """
        version = version or self.newest()
        if not version.runs:
            return None
        rows = self._read(version.runs)
        return (rows if buckets is None else rows.filter(F.col(_BUCKET).isin(list(buckets)))).drop(_BUCKET)

    def add(self, rows: DataFrame, batch: int, before: Version | None = None) -> None:
        """Write a batch as a run, merge where a level is full, and publish the version of the batch."""
        before = before or self.newest(before=batch)
        live = [*before.runs, run := f"L0-{batch}"]
        self._write(rows, run)
        n_new = self._read([run]).count()  # from the footers
        level = 0
        while len(mine := [r for r in live if r.startswith(f"L{level}-")]) >= FAN:
            merged = f"L{level + 1}-{batch}"
            self._write(self.latest(self._read(mine).drop(_BUCKET)), merged)
            live = [r for r in live if r not in mine] + [merged]
            level += 1
        values = [F.lit(batch), F.array(*map(F.lit, live)), F.lit(n_new), F.lit(before.n_rows + n_new)]
        names = [f.split()[0] for f in _VERSION.split(", ")]
        version = self.spark.range(1, numPartitions=1).select(*[v.alias(n) for v, n in zip(values, names, strict=True)])
        version.write.mode("overwrite").json(f"{self.path}/versions/batch={batch}")

    def versions(self) -> DataFrame | None:
        """One row per batch: version, runs, n_new, n_rows (rows added by all batches so far)."""
        return read_or_none(self.spark, f"{self.path}/versions", "json", _VERSION)
