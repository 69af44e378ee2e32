"""The inquiry log: validation, deduplication and figures, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accepted channels and error codes.
CHANNELS = ("instagram", "email")
INVALID_FIELD = "INVALID_FIELD"
MISSING_FIELDS = "MISSING_FIELDS"

INQUIRY_SCHEMA = (
    "canal string, source string, expediteur string, sujet string, texte string, "
    "reponse_proposee string, horodatage timestamp, external_id string"
)

#: which of several inquiries with one id is logged
SURVIVOR_ORDER = (
    "horodatage", "canal", "expediteur", "texte", "source", "sujet", "reponse_proposee",
)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def validate_inquiries(inquiries: DataFrame) -> DataFrame:
    """Adds ``error_code``: the channel is checked before the required fields."""
    return inquiries.withColumn("error_code", F.when(
        ~F.coalesce(F.col("canal").isin(*CHANNELS), F.lit(False)), INVALID_FIELD,
    ).when(_blank("expediteur") | _blank("texte"), MISSING_FIELDS))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("error_code IS NULL").drop("error_code")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("error_code IS NOT NULL")


def with_time(inquiries: DataFrame, now: Column) -> DataFrame:
    return inquiries.withColumn("horodatage", F.coalesce("horodatage", now))


def log_inquiries(inquiries: DataFrame, now: Column) -> DataFrame:
    """Valid inquiries with their time filled in, one per ``external_id`` (the
    earliest). Inquiries without an id are never duplicates; they bypass the window,
    where their common null key would be one hot partition."""
    valid = with_time(accepted(validate_inquiries(inquiries)), now)
    return first_of_each_id(valid)


def first_of_each_id(logged: DataFrame) -> DataFrame:
    """One row per ``external_id``: the first by time, then by all other columns."""
    order = [F.col(c) for c in SURVIVOR_ORDER if c in logged.columns]
    first = Window.partitionBy("external_id").orderBy(*order)
    known = logged.where("external_id IS NOT NULL").withColumn(
        "_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return known.unionByName(logged.where("external_id IS NULL"))


def in_range(time: Column, range_: str, as_of: Column) -> Column:
    """``today``: the day of ``as_of``; ``week``: the seven days that end with it."""
    if range_ == "all":
        return F.lit(True)
    if range_ not in ("today", "week"):
        raise ValueError("range must be today, week or all")
    start = F.date_trunc("day", as_of)
    if range_ == "week":
        start = start - F.expr("INTERVAL 6 DAYS")
    return (time >= start) & (time <= as_of)


def inquiry_stats(inquiries: DataFrame, as_of: Column, range_: str = "today") -> DataFrame:
    """Inquiries and senders per channel and source within a range up to ``as_of``."""
    return (
        inquiries.where(in_range(F.col("horodatage"), range_, as_of))
        .groupBy("canal", "source")
        .agg(F.count("*").alias("n_inquiries"), F.countDistinct("expediteur").alias("n_senders"))
    )
