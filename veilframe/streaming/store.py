"""A keyed table on shared storage that grows by micro-batches and stays cheap to look up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.masking import join_null_safe
from veilframe.sources.session import exists, remove

#: bucket of a run that is small and not divided
FLAT = -1


class SortedRuns:
    """A log-structured table: runs of rows, folded as they become many.

    A batch adds one small run. ``fanout`` runs of a level are folded into one run of the
    next, divided into ``buckets`` by the hash of the keys and sorted by them. So a table of n
    batches is about ``fanout * log(n)`` runs, a row is rewritten ``log(n)`` times, and a
    look-up reads the small runs and, of the others, the buckets of the wanted keys only.

    Which runs make up the table after a batch is written down in the batch's manifest. A
    batch reads the manifest of the one before, so a repeated batch sees what it saw the
    first time and writes the same runs under the same names. The last ``keep`` manifests
    and their runs stay for other readers; older ones are removed.

    ``fold``, if rows of one key can be combined, is applied when runs are folded and when
    they are read.
    """

    def __init__(self, base: str, keys: Sequence[str], fanout: int = 8, buckets: int = 64,
                 fold: Callable[[DataFrame], DataFrame] | None = None, keep: int = 4):
        self.base, self.keys, self.fanout, self.buckets = base.rstrip("/"), list(keys), fanout, buckets
        self.fold, self.keep = fold or (lambda rows: rows), keep
        self._manifests: dict[int, list[tuple[int, str]]] = {}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _run(self, name: str) -> str:
        return f"{self.base}/runs/run={name}"

    def manifest(self, spark: SparkSession, batch_id: int) -> list[tuple[int, str]]:
        """``(level, run)`` of the table after a batch; none before the first."""
        if batch_id < 0:
            return []
        if batch_id not in self._manifests:
            rows = spark.read.schema("level int, run string").parquet(f"{self.base}/manifest/batch_id={batch_id}")
            self._manifests[batch_id] = sorted((r.level, r.run) for r in rows.where("run IS NOT NULL").collect())
        return self._manifests[batch_id]

    def last(self, spark: SparkSession) -> int:
        """The last batch that has a manifest."""
        found = spark.read.schema("level int, run string, batch_id long").option(
            "basePath", f"{self.base}/manifest").parquet(f"{self.base}/manifest")
        return found.agg(F.max("batch_id")).first()[0]

    def _read(self, spark: SparkSession, runs: Sequence[str], buckets: Sequence[int] | None = None) -> DataFrame:
        rows = spark.read.option("basePath", f"{self.base}/runs").parquet(*map(self._run, runs))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(FLAT, *buckets))
        return rows.drop("run", "bucket")

    def read(self, spark: SparkSession, batch_id: int, wanted: DataFrame | None = None) -> DataFrame | None:
        """The table after a batch, or its rows with the keys of ``wanted``; ``None`` if nothing was written yet."""
        runs = [run for _, run in self.manifest(spark, batch_id)]
        if not runs:
            return None
        if wanted is None:
            return self.fold(self._read(spark, runs))
        keys = wanted.select(*self.keys).distinct()
        # At most as many rows as there are buckets.
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return self.fold(join_null_safe(self._read(spark, runs, buckets), keys, self.keys, "left_semi"))

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Add the rows of a batch; returns them as written. Nothing refers to a run before
        the manifest is there, which is written last."""
        spark = rows.sparkSession
        runs = list(self.manifest(spark, batch_id - 1))
        own = f"0-{batch_id}"
        rows.write.mode("overwrite").parquet(f"{self._run(own)}/bucket={FLAT}")
        runs.append((0, own))
        level = 0
        while len(full := [run for at, run in runs if at == level]) >= self.fanout:
            folded = f"{level + 1}-{batch_id}"
            self._write_folded(self.fold(self._read(spark, full)), folded)
            runs = [(at, run) for at, run in runs if at != level] + [(level + 1, folded)]
            level += 1
        spark.createDataFrame(runs, "level int, run string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/manifest/batch_id={batch_id}")
        self._manifests[batch_id] = sorted(runs)
        self._forget(spark, batch_id - self.keep)
        return spark.read.schema(rows.schema).parquet(f"{self._run(own)}/bucket={FLAT}")

    def _write_folded(self, rows: DataFrame, name: str) -> None:
        dealt = rows.withColumn("bucket", self._bucket())
        dealt = dealt.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys)
        # No bucket at all is a run without files: an empty flat one is written below it.
        rows.limit(0).write.mode("overwrite").parquet(f"{self._run(name)}/bucket={FLAT}")
        dealt.write.mode("append").partitionBy("bucket").parquet(self._run(name))

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove the manifest of a batch and the runs that the next one no longer has."""
        old = f"{self.base}/manifest/batch_id={batch_id}"
        if batch_id < 0 or not exists(spark, old):  # a repeated batch finds it gone
            return
        now, later = self.manifest(spark, batch_id), self.manifest(spark, batch_id + 1)
        # Runs that the batch wrote and folded at once are in no manifest.
        own = {f"{level}-{batch_id}" for level in range(1 + max(level for level, _ in now))}
        for run in (own | {run for _, run in now}) - {run for _, run in later}:
            remove(spark, self._run(run))
        remove(spark, old)
        self._manifests.pop(batch_id, None)
