"""Masking conversations with operator state.

:class:`StatefulMasker` keeps the mapping in the state store of the stream instead of a
table: two operators one after the other, both with ``transformWithState``.

* By ``(conversation, value)``: which category and spelling a value was first seen with.
  A value that fills the stream meets only its own state; the values of a large
  conversation are spread over all tasks.
* By ``(conversation, category)``: the number of each value and the last number given.

State lies in RocksDB, is part of the stream's checkpoint, and expires: a value not
seen for ``ttl`` is forgotten and gets a new number when it comes again; the last number is
kept ``counter_ttl``, so that no number is given twice while its conversation lives.

Against the table of :class:`~veilframe.streaming.masking.ConversationMasker`: no
look-up reads a table and a batch is one job, but the numbers of one category of
one conversation are given by one task, and what expired cannot be looked up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilframe.functions import placeholders as P
from veilframe.functions.patterns import MaskConfig
from veilframe.operators.detect import Rule, detect_sensitive, span_rows
from veilframe.operators.entities import EntityConfig
from veilframe.operators.masking import TEXT_ID, identified, place

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: of a span: its conversation, its text, its place in the order of the conversation, and what was found
_SPAN = "scope string, item string, digest binary, place binary, start_idx int, end_idx int, key string, category string, source string, original string"


class FirstSeen(StatefulProcessor):
    """By (scope, key): every span gets the category, source and spelling of the first one."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "category string, source string, original string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()
        if known is None:
            frames = list(rows)  # the spans of one value in one batch
            first = min((f.sort_values(["place", "start_idx"]).iloc[0] for f in frames), key=lambda r: (r["place"], r["start_idx"]))
            known, rows = (first["category"], first["source"], first["original"]), iter(frames)
        self.first.update(known)  # seen again: lives on
        for frame in rows:
            frame["category"], frame["source"], frame["original"] = known
            yield frame


class Numbers(StatefulProcessor):
    """By (scope, category): the numbers of its values, counting on in order of appearance."""

    def __init__(self, ttl_ms: int | None, counter_ttl_ms: int | None):
        self.ttl_ms, self.counter_ttl_ms = ttl_ms, counter_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "key string", "number long", self.ttl_ms)
        self.last = handle.getValueState("last", "number long", self.counter_ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given: dict[str, int] = {}
        first: dict[str, tuple] = {}
        waiting = []
        for frame in rows:
            for value in frame["key"].unique():
                if value not in given and value not in first and self.numbers.containsKey((value,)):
                    given[value] = self.numbers.getValue((value,))[0]
            known = frame["key"].isin(given.keys())
            if known.any():
                yield self._numbered(frame[known], given, False)
            new = frame[~known]
            if len(new):
                waiting.append(new)
                for value, place_, start in zip(new["key"], new["place"], new["start_idx"], strict=True):
                    first[value] = min(first.get(value, (place_, start)), (place_, start))
        last = self.last.get()
        number = last[0] if last is not None else 0
        for value in sorted(first, key=lambda v: (*first[v], v)):
            number += 1
            given[value] = number
        for value, at in given.items():
            self.numbers.updateValue((value,), (at,))  # seen again: lives on
        self.last.update((number,))
        for new in waiting:
            yield self._numbered(new, given, True)

    @staticmethod
    def _numbered(frame: pd.DataFrame, given: dict[str, int], new: bool) -> pd.DataFrame:
        return frame.assign(number=frame["key"].map(given).astype("int64"), is_new=new)


class StatefulMasker:
    """Mask turns as they arrive; the mapping is the stream's own state.

    Scopes, items and their order are taken as text of their values and as sortable bytes, so
    that any type and nulls go through the state store unchanged. ``scope`` and ``item``
    must be numbers or strings.
    """

    def __init__(self, base: str, scope: str = "conv_id", item: str = "turn", text_col: str = "text",
                 config: MaskConfig = MaskConfig(), rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig(),
                 ttl_ms: int | None = None, counter_ttl_ms: int | None = None):
        self.base, self.scope, self.item, self.text_col = base.rstrip("/"), scope, item, text_col
        self.config, self.rules, self.entities = config, rules, entities
        self.ttl_ms, self.counter_ttl_ms = ttl_ms, counter_ttl_ms

    def pieces(self, stream: DataFrame) -> DataFrame:
        """The spans of a stream of turns with their placeholders: two stateful operators."""
        texts = identified(stream, self.item, self.text_col)
        detected = detect_sensitive(
            texts.select(self.scope, TEXT_ID, self.text_col), self.text_col, self.config, self.rules, self.entities, "_spans")
        rows = span_rows(detected, [self.scope, TEXT_ID], "_spans")
        item, kind = F.col(f"{TEXT_ID}.item"), dict(stream.dtypes)[self.item]
        # Bytes that sort as the items do, nulls first: a number's digits after its sign is turned.
        as_bytes = F.encode(item.cast("string"), "utf-8") if kind == "string" else F.unhex(F.lpad(F.hex(
            (item.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0"))
        place_ = F.concat(F.when(item.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), as_bytes)), F.col(f"{TEXT_ID}.digest"))
        spans = rows.select(
            F.col(self.scope).cast("string").alias("scope"), item.cast("string").alias("item"), F.col(f"{TEXT_ID}.digest").alias("digest"),
            place_.alias("place"), "start_idx", "end_idx", F.lower("value").alias("key"), "category", "source", F.col("value").alias("original"))
        mode = "None" if self.ttl_ms is None and self.counter_ttl_ms is None else "ProcessingTime"
        first = spans.groupBy("scope", "key").transformWithStateInPandas(
            FirstSeen(self.ttl_ms), _SPAN, "append", mode)
        numbered = first.groupBy("scope", "category").transformWithStateInPandas(
            Numbers(self.ttl_ms, self.counter_ttl_ms), f"{_SPAN}, number long, is_new boolean", "append", mode)
        return numbered.withColumn("placeholder", F.expr(P.format_placeholder("category", "number", self.config.placeholder_style)))

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Needs :func:`use_rocksdb`. A batch writes its pieces and turns once, then the masked
        turns; a repeated batch overwrites them."""
        columns = stream.columns
        turns = stream.select(F.struct(*columns).alias("turn"))
        found = self.pieces(stream).select(F.struct("*").alias("piece"))
        rows = turns.unionByName(found, allowMissingColumns=True)

        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            path = f"{self.base}/rows/batch_id={batch_id}"
            batch.withColumn("kind", F.when(F.col("turn").isNotNull(), "turn").otherwise("piece")).write.mode("overwrite").partitionBy("kind").parquet(path)
            both = spark.read.schema(batch.schema.add("kind", "string")).parquet(path)
            texts = identified(both.where("kind = 'turn'").select("turn.*"), self.item, self.text_col)
            keyed = texts.withColumns({"_scope": F.col(self.scope).cast("string"), "_item": F.col(self.item).cast("string"), "_digest": F.col(f"{TEXT_ID}.digest")})
            pieces = both.where("kind = 'piece'").select("piece.*").select(
                F.col("scope").alias("_scope"), F.col("item").alias("_item"), F.col("digest").alias("_digest"), "start_idx", "end_idx", "placeholder")
            masked = place(keyed, pieces, ["_scope", "_item", "_digest"], self.text_col, "masked")
            masked.select(*columns, "masked").write.mode("overwrite").parquet(f"{self.base}/masked/batch_id={batch_id}")

        return (
            rows.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(**(trigger or {"processingTime": "1 minute"})).start()
        )

    def masked(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/masked").drop("batch_id")

    def mapping(self, spark: SparkSession) -> DataFrame:
        """What was given so far: a value once for each number it has had."""
        pieces = spark.read.parquet(f"{self.base}/rows").where("kind = 'piece'").select("piece.*")
        return pieces.groupBy("scope", "key", "placeholder").agg(
            F.first("original").alias("original"), F.first("category").alias("category"),
            F.first("source").alias("source"), F.count("*").alias("count"))


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, and make no
    batches without data: operators with expiry would ask for one after another."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def state_rows(query: StreamingQuery) -> dict[str, int]:
    """Size of the state after the last batch: rows and bytes over all stateful operators."""
    last = query.lastProgress
    operators = last["stateOperators"] if last else []
    return {"rows": sum(o["numRowsTotal"] for o in operators), "bytes": sum(o["memoryUsedBytes"] for o in operators)}
