"""Putting originals back into answers that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.masking import deanonymize


class AnswerRestorer:
    """Match answers with the turns that were sent, and restore them.

    ``sent`` and ``answers`` are streams of ``scope, turn`` (which may be null), a time
    ``sent_at`` or ``answered_at``, and ``masked`` or ``content``. An answer counts that
    comes within ``max_wait`` of its turn: a stream-stream join with watermarks on both
    sides, whose state holds what may still find a partner. Answers without one, late
    or never asked for, are written as they came to a side table, unrestored, once the
    watermark says that no turn can follow; rows that Spark drops as older than the watermark
    are counted in the stream's progress (:func:`dropped_rows`).

    Matched answers are restored with the mapping as it is when they are written, a static
    table (``mapping(session)``), so that the join with the stream needs no state.
    """

    def __init__(self, base: str, mapping: Callable[[SparkSession], DataFrame], scope: str = "conv_id",
                 turn: str = "turn", style: str = "brackets", max_wait: str = "1 hour",
                 lateness: str = "10 minutes"):
        self.base, self.mapping = base.rstrip("/"), mapping
        self.scope, self.turn, self.style = scope, turn, style
        self.max_wait, self.lateness = max_wait, lateness

    def matched(self, sent: DataFrame, answers: DataFrame) -> DataFrame:
        """``scope, turn, answered_at, content, sent_at, masked``; the last two null without a turn."""
        scope, turn = self.scope, self.turn
        left = answers.select(scope, turn, "answered_at", "content").withWatermark("answered_at", self.lateness)
        right = sent.select(F.col(scope).alias("_scope"), F.col(turn).alias("_turn"), "sent_at", "masked").withWatermark(
            "sent_at", self.lateness)
        on = (F.col(scope).eqNullSafe(F.col("_scope")) & F.col(turn).eqNullSafe(F.col("_turn"))
              & (F.col("answered_at") >= F.col("sent_at"))
              & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"INTERVAL {self.max_wait}")))
        return left.join(right, on, "leftOuter").drop("_scope", "_turn")

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{self.base}/answers/batch_id={batch_id}"
        # Written once, so that no task of the join runs again for the second table.
        batch.withColumn("on_time", F.col("sent_at").isNotNull()).write.mode("overwrite").partitionBy("on_time").parquet(path)
        rows = spark.read.schema(batch.schema.add("on_time", "boolean")).parquet(path)
        restored = deanonymize(rows.where("on_time").drop("on_time"), self.mapping(spark), self.scope,
                               [self.scope, self.turn], "content", self.style)
        restored.write.mode("overwrite").parquet(f"{self.base}/restored/batch_id={batch_id}")
        rows.where("NOT on_time").drop("on_time", "sent_at", "masked").write.mode("overwrite").parquet(
            f"{self.base}/unmatched/batch_id={batch_id}")

    def start(self, sent: DataFrame, answers: DataFrame, **trigger) -> StreamingQuery:
        return (
            self.matched(sent, answers).writeStream.foreachBatch(self._write).outputMode("append")
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(**(trigger or {"processingTime": "1 minute"})).start()
        )

    def restored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/restored").drop("batch_id")

    def unmatched(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/unmatched").drop("batch_id")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over all batches that are reported."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
