"""The inquiry log on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.inquiries import (
    accepted, first_of_each_id, log_inquiries, validate_inquiries, with_time,
)
from veilframe.streaming.run import BatchTable

#: a repeated id is spread over this many state partitions first
DEDUP_SALTS = 16


def log_inquiries_stream(inquiries: DataFrame, now: Column | None = None,
                         lateness: str = "1 day") -> DataFrame:
    """Valid inquiries, one per ``external_id`` within the watermark.

    Rows without an id bypass the deduplication. An id is first deduplicated per salt
    and then once more, so that no state partition receives all copies of a hot id; the
    salt is the input partition, which differs between copies of the same message. Which
    copy is kept is open; :func:`inquiry_log` keeps a defined one, without a time limit.
    """
    time = now if now is not None else F.current_timestamp()
    valid = with_time(accepted(validate_inquiries(inquiries)), time).withWatermark(
        "horodatage", lateness)
    salted = valid.where("external_id IS NOT NULL").withColumn(
        "_salt", F.pmod(F.spark_partition_id(), F.lit(DEDUP_SALTS)))
    once_per_salt = salted.dropDuplicatesWithinWatermark(["external_id", "_salt"]).drop("_salt")
    once = once_per_salt.dropDuplicatesWithinWatermark(["external_id"])
    return once.unionByName(valid.where("external_id IS NULL"))


def inquiry_stats_stream(inquiries: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Inquiries per day, channel and source; a day is final once the watermark passed."""
    return (
        inquiries.where("horodatage IS NOT NULL").withWatermark("horodatage", lateness)
        .groupBy(F.window("horodatage", "1 day"), "canal", "source")
        .agg(F.count("*").alias("n_inquiries"))
        .select(F.col("window.start").alias("day"), "canal", "source", "n_inquiries")
    )


def inquiry_log(base: str, now: Column | None = None) -> BatchTable:
    """The log of all inquiries read so far, as ``log_inquiries`` of their whole table: of
    each id the first by time and then all columns."""
    time = now if now is not None else F.current_timestamp()
    return BatchTable(base, lambda batch: log_inquiries(batch, time), first_of_each_id)


def daily_inquiries(base: str) -> BatchTable:
    """Inquiries per day, channel and source, complete for all read so far."""
    def reduce(batch: DataFrame) -> DataFrame:
        timed = batch.where("horodatage IS NOT NULL")
        return timed.groupBy(F.date_trunc("day", "horodatage").alias("day"), "canal", "source").agg(
            F.count("*").alias("n_inquiries"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("day", "canal", "source").agg(F.sum("n_inquiries").alias("n_inquiries"))

    return BatchTable(base, reduce, merge)


#: places of a cardinality sketch, as a power of two: estimates have a standard error of 1.04 / sqrt(2^12), 1.6 %
LG_K = 12


def daily_senders(base: str) -> BatchTable:
    """Inquiries and an estimate of their different senders per day, channel and source, complete for all
    read so far. A group is one sketch a batch, of a bounded size; sketches are united when read."""
    def reduce(batch: DataFrame) -> DataFrame:
        timed = batch.where("horodatage IS NOT NULL")
        return timed.groupBy(F.date_trunc("day", "horodatage").alias("day"), "canal", "source").agg(
            F.count("*").alias("n_inquiries"), F.hll_sketch_agg("expediteur", LG_K).alias("senders"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("day", "canal", "source").agg(
            F.sum("n_inquiries").alias("n_inquiries"),
            F.hll_sketch_estimate(F.hll_union_agg("senders", F.lit(False))).alias("n_senders_about"))

    return BatchTable(base, reduce, merge)


def closed_day_senders(base: str, closed_before: Column) -> BatchTable:
    """The exact number of senders of the days before ``closed_before``: a batch keeps each sender of
    a group once, and the days that are still open are not counted when the table is read."""
    def reduce(batch: DataFrame) -> DataFrame:
        timed = batch.where("horodatage IS NOT NULL")
        return timed.select(F.date_trunc("day", "horodatage").alias("day"), "canal", "source", "expediteur").distinct()

    def merge(parts: DataFrame) -> DataFrame:
        return parts.where(F.col("day") < closed_before).groupBy("day", "canal", "source").agg(
            F.countDistinct("expediteur").alias("n_senders"))

    return BatchTable(base, reduce, merge)
