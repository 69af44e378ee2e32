"""Call-log figures on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.calls import parse_envelopes
from veilframe.streaming.run import BatchTable


def call_rollup_stream(calls: DataFrame, time_col: str = "ts", json_col: str = "envelope",
                       lateness: str = "10 minutes") -> DataFrame:
    """Calls, failures and durations per provider and hour."""
    parsed = parse_envelopes(calls, json_col).withWatermark(time_col, lateness)
    return (
        parsed.groupBy(F.window(time_col, "1 hour"), "provider")
        .agg(
            F.count("*").alias("n_calls"),
            F.count(F.when(~F.col("ok"), 1)).alias("n_failed"),
            F.sum("duration_ms").alias("total_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
        .select(F.col("window.start").alias("hour"), "provider", "n_calls", "n_failed",
                "total_ms", "max_ms")
    )


def hourly_calls(base: str, time_col: str = "ts", json_col: str = "envelope") -> BatchTable:
    """The same figures, complete for all calls read so far, late ones included."""
    def reduce(batch: DataFrame) -> DataFrame:
        parsed = parse_envelopes(batch, json_col).where(F.col(time_col).isNotNull())
        return parsed.groupBy(F.date_trunc("hour", time_col).alias("hour"), "provider").agg(
            F.count("*").alias("n_calls"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"),
            F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))

    def merge(parts: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("n_calls", "n_failed", "total_ms")]
        return parts.groupBy("hour", "provider").agg(*sums, F.max("max_ms").alias("max_ms"))

    return BatchTable(base, reduce, merge)


#: size of a quantile sketch: ranks are within about 1.33 / K of the true ones, 0.2 %, 99 times of 100;
#: groups of fewer than K calls are exact
K = 800
QUANTILES = (0.5, 0.95, 0.99)


def hourly_durations(base: str, time_col: str = "ts", json_col: str = "envelope") -> BatchTable:
    """Calls and ``p50, p95, p99`` of their durations per hour and provider, for all calls read so
    far. A batch keeps a sketch for each of its groups, of a size that does not grow with
    the calls; sketches are merged when they are read. (``call_rollup`` is exact.)"""
    def reduce(batch: DataFrame) -> DataFrame:
        parsed = parse_envelopes(batch, json_col).where(F.col(time_col).isNotNull())
        return parsed.groupBy(F.date_trunc("hour", time_col).alias("hour"), "provider").agg(
            F.count("duration_ms").alias("n_timed"),
            F.kll_sketch_agg_bigint(F.col("duration_ms").cast("long"), K).alias("sketch"))

    def merge(parts: DataFrame) -> DataFrame:
        # Rows of one sketch come before they are merged, so that an hour is few rows wherever it came from.
        merged = parts.where("n_timed > 0").groupBy("hour", "provider").agg(
            F.sum("n_timed").alias("n_timed"), F.kll_merge_agg_bigint("sketch", K).alias("sketch"))
        return merged.select("hour", "provider", "n_timed", *[
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in QUANTILES])

    return BatchTable(base, reduce, merge)
