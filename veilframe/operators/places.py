"""Places of rows inside their groups, at any size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.masking import join_null_safe
from veilframe.sources.session import materialise

#: characters of a text by which ranges are cut; what is equal so far is sorted inside a range
CUT_CHARS = 64


def with_places(rows: DataFrame, group: str, order: Sequence[str], out: str = "place",
                parts: int | None = None) -> DataFrame:
    """``out``: the place of a row in its group, from 0, in the order of the columns, nulls
    first. A null group is a group; rows alike in all columns follow each other.

    Rows are dealt to ranges of (group, order), sorted and written there; a range adds
    the rows of its group in the ranges before it. So a group with a third of all rows is
    many tasks, and the partition that a row came from, the last key, divides rows that are
    all alike.
    """
    kinds = dict(rows.dtypes)
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = [F.substring(c, 1, CUT_CHARS) if kinds[c] == "string" else F.col(c) for c in (group, *order)]
    dealt = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(
        n, *[F.asc_nulls_first(c) for c in (*cut, F.col("_from"))])
    ranged = materialise(
        dealt.sortWithinPartitions(*[F.asc_nulls_first(c) for c in (group, *order, "_from")])
        .select(*rows.columns, F.monotonically_increasing_id().alias("_seq"))
        .withColumn("_range", F.shiftright("_seq", 33).cast("int")), "rows-in-order")
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = join_null_safe(ranged, offsets, [group, "_range"])
    return placed.select(*rows.columns, (F.col("_seq") - F.col("_first") + F.col("_before")).alias(out))
