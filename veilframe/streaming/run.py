"""Running a stream over what is there now, and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilframe.sources.session import new_folder


def start(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
          **trigger) -> StreamingQuery:
    """Append a stream to files; ``trigger`` as in ``DataStreamWriter.trigger``."""
    return (
        stream.writeStream.format(fmt).outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available, then return the written table. Rows go from the
    executors to the shared folder, never through the driver."""
    spark = stream.sparkSession
    base = new_folder(spark, label)
    start(stream, f"{base}/out", f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class BatchTable:
    """A result that grows by micro-batches and is complete after each of them.

    ``reduce`` turns the rows of a batch into rows that ``merge`` can combine with
    those of other batches: partial counts, or the first row of each key. A batch
    writes them to a folder of its own, which a repeated batch overwrites, so the
    result never depends on how the input was cut or how often a batch ran. There is
    no watermark and no state: late rows count, and nothing waits to be closed.
    """

    def __init__(self, base: str, reduce: Callable[[DataFrame], DataFrame],
                 merge: Callable[[DataFrame], DataFrame]):
        self.base, self.reduce, self.merge = base.rstrip("/"), reduce, merge

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.reduce(batch).write.mode("overwrite").parquet(f"{self.base}/parts/batch_id={batch_id}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(**(trigger or {"processingTime": "1 minute"})).start()
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return self.merge(spark.read.parquet(f"{self.base}/parts").drop("batch_id"))
