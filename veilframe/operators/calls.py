"""Call logs: request lines, response envelopes and retry decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Format of a log line, retryable statuses, backoff.
LOG_LINE = r"^\[([A-Z]+)\] (.*) → (\d+) \((\d+)ms\)$"
RETRYABLE = (429, 500, 502, 503, 504)
BASE_DELAY_MS = 1000
MAX_DELAY_MS = 30000

ENVELOPE_SCHEMA = (
    "ok boolean, error struct<code:string,message:string>, "
    "meta struct<durationMs:bigint,provider:string>"
)


def parse_request_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds ``method, url, status, duration_ms``; null where the line has another form."""
    line = F.col(line_col)

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract(line, LOG_LINE, n), F.lit(""))

    return lines.select(
        "*", group(1).alias("method"), F.when(line.rlike(LOG_LINE), F.regexp_extract(line, LOG_LINE, 2))
        .alias("url"), group(3).cast("int").alias("status"),
        group(4).cast("bigint").alias("duration_ms"),
    )


def parse_envelopes(calls: DataFrame, json_col: str = "envelope") -> DataFrame:
    parsed = calls.withColumn("_e", F.from_json(json_col, ENVELOPE_SCHEMA))
    return parsed.select(
        *calls.columns, F.col("_e.ok").alias("ok"), F.col("_e.error.code").alias("error_code"),
        F.col("_e.meta.provider").alias("provider"),
        F.col("_e.meta.durationMs").alias("duration_ms"),
    )


def call_rollup(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, success rate and durations per provider.

    Calls are counted per duration first, which is one mergeable aggregate; the
    median follows from the running sum of the counts. What a task holds of a
    provider is its different durations in whole milliseconds, sorted and spilled
    by Spark, never its calls.
    """
    group = ["provider", *by]
    counts = calls.groupBy(*group, "duration_ms").agg(
        F.count("*").alias("n"), F.count("ok").alias("n_known"),
        F.sum(F.col("ok").cast("long")).alias("n_ok"),
    )
    timed = F.when(F.col("duration_ms").isNotNull(), F.col("n")).otherwise(F.lit(0))
    upto = Window.partitionBy(*group).orderBy("duration_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({
        "_upto": F.sum(timed).over(upto), "_all": F.sum(timed).over(Window.partitionBy(*group))})
    middle = (F.col("_all") - 1) / 2

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("duration_ms")))

    return ranked.groupBy(*group).agg(
        F.sum("n").alias("n_calls"), (F.sum("n_ok") / F.nullif(F.sum("n_known"), F.lit(0))).alias("ok_rate"),
        (F.sum(F.col("duration_ms") * F.col("n")) / F.nullif(F.sum(timed), F.lit(0))).alias("avg_ms"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("p50_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def error_rollup(calls: DataFrame) -> DataFrame:
    return calls.where("error_code IS NOT NULL").groupBy("provider", "error_code").agg(
        F.count("*").alias("n_errors"))


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))


def retry_delay_ms(attempt: Column) -> Column:
    """Doubling delay without jitter, capped."""
    return F.least(
        F.lit(BASE_DELAY_MS) * F.pow(F.lit(2), attempt), F.lit(float(MAX_DELAY_MS)),
    ).cast("bigint")


def classify_retryable(calls: DataFrame, status_col: str = "status",
                       attempt_col: str = "attempt") -> DataFrame:
    retryable = is_retryable(F.col(status_col))
    return calls.select(
        "*", retryable.alias("retryable"),
        F.when(retryable, retry_delay_ms(F.col(attempt_col))).alias("delay_ms"),
    )
