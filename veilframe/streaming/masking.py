"""Masking on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.patterns import MaskConfig
from veilframe.operators.detect import Rule, detect_sensitive, span_rows
from veilframe.operators.entities import EntityConfig
from veilframe.operators.masking import (
    TEXT_ID, anonymize, first_entries, identified, join_null_safe, number_entries, place, with_placeholders,
)
from veilframe.streaming.run import BatchTable
from veilframe.streaming.store import SortedRuns


def mask_stream(stream: DataFrame, text_col: str = "text", config: MaskConfig = MaskConfig(),
                rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig()) -> DataFrame:
    """Mask each text of a stream on its own: a projection without state."""
    return anonymize(stream, text_col, config, rules, entities)


def span_figures(base: str, by: Sequence[str], text_col: str = "text", config: MaskConfig = MaskConfig(),
                 rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig(), lg_k: int = 12) -> BatchTable:
    """``span_rollup`` of all texts read so far: spans of a group and category, and an estimate
    (standard error 1.04 / sqrt(2^lg_k)) of their different values, from sketches that are
    united when read. A column of ``by`` must not be called as one of a span."""
    def reduce(batch: DataFrame) -> DataFrame:
        found = detect_sensitive(batch.select(*by, text_col), text_col, config, rules, entities, "_spans")
        return span_rows(found, by, "_spans").groupBy(*by, "category").agg(
            F.count("*").alias("n_spans"), F.hll_sketch_agg(F.lower("value"), lg_k).alias("values"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*by, "category").agg(
            F.sum("n_spans").alias("n_spans"),
            F.hll_sketch_estimate(F.hll_union_agg("values", F.lit(False))).alias("n_values_about"))

    return BatchTable(base, reduce, merge)


class ConversationMasker:
    """Mask turns as they arrive, with one mapping per conversation over all batches.

    Per micro-batch: detect, look up the values already numbered, number the new ones
    after them in turn order, splice, write. Numbers only grow, so a late turn gets
    new ones and never changes old ones. The mapping is a table, not operator state
    keyed by conversation: a conversation that fills a third of the stream is still
    joined and aggregated by ``(conversation, value)`` across the cluster.

    Every table is written per batch and overwritten if the batch is run again;
    a batch only reads what earlier batches wrote. So a restart repeats no number.
    The mapping and its counters are :class:`SortedRuns`: a batch reads the buckets of
    its own values, not all history.

    Scopes and items may be null and items tied, as in ``anonymize_many``.
    """

    def __init__(self, base: str, scope: str = "conv_id", item: str = "turn",
                 text_col: str = "text", config: MaskConfig = MaskConfig(),
                 rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig(),
                 parts: int | None = None, fanout: int = 8, buckets: int = 64):
        self.base = base.rstrip("/")
        self.scope, self.item, self.text_col = scope, item, text_col
        self.config, self.rules, self.entities = config, rules, entities
        self.parts = parts
        self.known = SortedRuns(f"{self.base}/mapping", [scope, "key"], fanout, buckets)
        self.counters = SortedRuns(
            f"{self.base}/counters", [scope], fanout, buckets,
            lambda rows: rows.groupBy(scope, "category").agg(F.sum("_taken").alias("_taken")))

    def _write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        path = f"{self.base}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, scope, style = batch.sparkSession, self.scope, self.config.placeholder_style
        texts = identified(batch, self.item, self.text_col)
        detected = detect_sensitive(
            texts.select(scope, TEXT_ID, self.text_col), self.text_col, self.config, self.rules,
            self.entities, "_spans",
        )
        spans = self._write(span_rows(detected, [scope, TEXT_ID], "_spans"), "spans", batch_id)
        entries = self._write(first_entries(spans, scope, TEXT_ID), "entries", batch_id)
        known = self.known.read(spark, batch_id - 1, entries)
        taken = self.counters.read(spark, batch_id - 1, entries)
        new = entries if known is None else join_null_safe(
            entries, known.select(scope, "key"), [scope, "key"], "left_anti")
        keep = lambda df, label: self._write(df, label, batch_id)
        mapping = self.known.append(number_entries(new, scope, style, self.parts, taken, keep), batch_id)
        self.counters.append(mapping.groupBy(scope, "category").agg(F.count("*").alias("_taken")), batch_id)
        pieces = with_placeholders(spans, mapping if known is None else mapping.unionByName(known), scope)
        masked = place(texts, pieces, [scope, TEXT_ID], self.text_col, "masked")
        self._write(masked.select(*batch.columns, "masked"), "masked", batch_id)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(**(trigger or {"processingTime": "1 minute"})).start()
        )

    def masked(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/masked").drop("batch_id")

    def mapping(self, spark: SparkSession) -> DataFrame:
        """The mapping so far, counting the occurrences of all batches."""
        counts = spark.read.parquet(f"{self.base}/entries").groupBy(self.scope, "key").agg(
            F.sum("count").alias("count"))
        entries = self.known.read(spark, self.known.last(spark)).drop("count")
        return join_null_safe(entries, counts, [self.scope, "key"])
