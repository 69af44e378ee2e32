"""Message tables: listing, paging, lookup, labels and read flags.

A message table has at least ``msg_id, thread_id, labels ARRAY<STRING>, is_read,
subject, body``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default page sizes and platform.
MAX_RESULTS = 100
PAGE_SIZE = 25
PLATFORM = "instagram"


def _mentions(phrase: str, columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(phrase.lower()))
    return hit


def list_messages_by_label(messages: DataFrame, query: str | None = None,
                           label_ids: Sequence[str] = (), max_results: int | None = None,
                           page_token: int | None = None,
                           search_in: Sequence[str] = ("subject", "body")) -> DataFrame:
    """A page of messages that carry all labels and mention the query. Pages follow
    the key: the last ``msg_id`` of a page is the token of the next one, so a deep
    page costs no more than the first."""
    page = messages
    if page_token is not None:
        page = page.where(F.col("msg_id") > page_token)
    for label in label_ids:
        page = page.where(F.array_contains("labels", label))
    if query:
        page = page.where(_mentions(query, search_in))
    return page.orderBy("msg_id").limit(max_results or MAX_RESULTS)


def list_messages_page(messages: DataFrame, filter: str | None = None,  # noqa: A002
                       search: str | None = None, top: int | None = None, skip: int = 0,
                       orderby: Sequence[Column | str] = ("msg_id",),
                       search_in: Sequence[str] = ("subject", "body")) -> DataFrame:
    """``top`` messages (0 or none: 25) after ``skip``, by filter expression and phrase."""
    page = messages.where(filter) if filter else messages
    if search:
        page = page.where(_mentions(search, search_in))
    return page.orderBy(*orderby).offset(skip or 0).limit(top or PAGE_SIZE)


class PageDirectory(NamedTuple):
    """Messages in the order of one key, stored by ranges, and how many each range has.

    A page by number reads the ranges that it touches: the counts, one row a range, say
    which, so page a million costs what the first does. ``list_messages_page`` sorts all
    that it skips; a directory is for listings that are asked for again and again.
    """

    path: str
    key: str

    def page(self, spark: SparkSession, top: int | None = None, skip: int = 0) -> DataFrame:
        """``top`` messages (0 or none: 25) after ``skip``, in the order of the key."""
        size, last = top or PAGE_SIZE, skip + (top or PAGE_SIZE)
        counts = spark.read.schema("_range int, n long").parquet(f"{self.path}/counts")
        # As many rows as there are ranges.
        before, touched, skipped = 0, [], 0
        for r in counts.orderBy("_range").collect():
            if before + r["n"] > skip and before < last:
                touched.append(r["_range"])
            if before + r["n"] <= skip:
                skipped += r["n"]
            before += r["n"]
        rows = spark.read.parquet(f"{self.path}/messages").where(F.col("_range").isin(touched))
        return rows.drop("_range").orderBy(F.asc_nulls_first(self.key)).offset(skip - skipped).limit(size)


def store_pages(messages: DataFrame, path: str, key: str = "msg_id", ranges: int = 200) -> PageDirectory:
    """Write the messages by ranges of a key, and the directory. Equal keys are in one range, so
    the key should be nearly unique, as an id or a time is; nulls come first."""
    dealt = messages.repartitionByRange(ranges, F.asc_nulls_first(key)).withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions(F.asc_nulls_first(key)).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/messages")
    written = messages.sparkSession.read.parquet(f"{path}/messages")
    written.groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return PageDirectory(path, key)


def get_message(messages: DataFrame, msg_id) -> DataFrame:
    return messages.where(F.col("msg_id") == msg_id)


def modify_labels(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes (msg_id, add, remove)``, one row per message: add, then remove."""
    none = F.array().cast("array<string>")
    joined = messages.join(changes, "msg_id", "left")
    labels = F.array_except(
        F.array_union("labels", F.coalesce("add", none)), F.coalesce("remove", none))
    return joined.withColumn("labels", labels).select(*messages.columns)


def mark_read(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes (msg_id, is_read)``, one row per message; a null flag means read."""
    flags = changes.select("msg_id", F.coalesce("is_read", F.lit(True)).alias("_flag"))
    return messages.join(flags, "msg_id", "left").withColumn(
        "is_read", F.coalesce("_flag", "is_read")).select(*messages.columns)


def list_conversations(turns: DataFrame, platform: str | None = None,
                       limit: int | None = None) -> DataFrame:
    """The most recently updated conversations of a platform and who takes part."""
    return (
        turns.where(F.col("platform") == (platform or PLATFORM))
        .groupBy("conv_id")
        .agg(F.max("turn").alias("updated_turn"),
             F.sort_array(F.collect_set("role")).alias("participants"))
        .orderBy(F.desc("updated_turn"), "conv_id")
        .limit(limit or PAGE_SIZE)
    )


def list_conversation_messages(turns: DataFrame, limit: int = PAGE_SIZE) -> DataFrame:
    """At most ``limit`` messages of every conversation, newest first. The rank filter
    is applied within each input partition before the shuffle already."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= limit)
