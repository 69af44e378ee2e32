"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for the nodes of the links
    ``a``, ``b`` (longs; loops and repeats are allowed).

    Each round hangs the greater neighbours of a node on its smallest one, then
    the smaller ones too; a node's neighbours are met by joins and minima only,
    never listed, and the links of a hot node are split like those of any join.
    """
    pairs = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    # Stars: every node hangs on the smallest of its component.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
