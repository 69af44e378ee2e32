"""Chat formatting after cumulative snapshots are collapsed.

A log often holds a conversation again each time it grows. Every prefix of a
conversation gets a rolling hash of its turns; a conversation whose whole hash
is a proper prefix of a longer one is a snapshot and goes by anti-join. Equal
conversations stay once, under the smallest id. What stays is rendered.

The rolling hash combines a hash of (place, role, text) of each turn by xor, so
it can be summed by pieces: a conversation of more than ``hot`` turns is split
at quantiles of its turn numbers, pieces are scanned alone, and the totals of
the pieces before are added. Rendered text comes in parts of ``part_turns``
turns, which joined in order are the whole; no conversation is one group.

Defined cases: turns are ordered by (turn, role, text), nulls first; repeated
rows count once; the null id is a conversation of its own; null and empty texts
differ for the hash and are rendered alike; an empty table gives an empty one;
further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("conv_id", "turn", "role", "text")
PIECES = 256


def _pieces(turns: DataFrame, hot: int) -> DataFrame:
    """The turns and ``piece``: 0 but in conversations of more than ``hot`` turns."""
    sizes = turns.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n")).filter(F.col("n") > hot).drop("n")
    long = turns.select("conv_id", "turn").join(sizes, turns["conv_id"].eqNullSafe(sizes["_conv"]), "left_semi")
    cuts = long.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.percentile_approx("turn", [i / PIECES for i in range(1, PIECES)], 10_000).alias("cuts")
    )
    return turns.join(cuts, turns["conv_id"].eqNullSafe(cuts["_conv"]), "left").select(
        *COLUMNS, F.when(F.col("cuts").isNull() | F.col("turn").isNull(), F.lit(0))
        .otherwise(F.size(F.filter("cuts", lambda c: c < F.col("turn")))).alias("piece"),
    )


def prefix_hashes(turns: DataFrame, hot: int = 4096) -> DataFrame:
    """The turns with ``place`` (from 1), ``n_turns`` and the rolling hashes ``h1``, ``h2``."""
    turns = _pieces(turns.select(*COLUMNS).dropDuplicates(), hot)
    inside = Window.partitionBy("conv_id", "piece").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    before = Window.partitionBy("_conv").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_conv")
    keys = [F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece")]

    def add(rows: DataFrame, totals: DataFrame) -> DataFrame:
        on = rows["conv_id"].eqNullSafe(totals["_conv"]) & (rows["piece"] == totals["_piece"])
        return rows.join(totals, on, "left").drop("_conv", "_piece")

    counts = turns.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = counts.select("_conv", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n_turns"))
    rows = add(turns.withColumn("_place", F.row_number().over(inside)), counts)
    rows = rows.withColumn("place", F.col("_place") + F.col("_before"))
    rows = rows.withColumns({f"_h{i}": F.xxhash64(F.lit(i), "place", "role", "text") for i in (1, 2)})
    running = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    xors = rows.groupBy(*keys).agg(*[F.bit_xor(f"_h{i}").alias(f"_h{i}") for i in (1, 2)])
    xors = xors.select("_conv", "_piece", *[F.coalesce(F.bit_xor(f"_h{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in (1, 2)])
    rows = add(rows.withColumns({f"_r{i}": F.bit_xor(f"_h{i}").over(running) for i in (1, 2)}), xors)
    return rows.select(*COLUMNS, "place", "n_turns", *[F.col(f"_r{i}").bitwiseXOR(F.col(f"_b{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``n_copies`` of the conversations that no longer one begins with."""
    key = ["place", "h1", "h2"]
    whole = hashes.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = hashes.filter("place < n_turns").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, part_turns: int = 256, hot: int = 4096) -> DataFrame:
    """``conv_id``, ``part``, ``n_parts``, ``n_turns``, ``n_copies`` and ``text``."""
    hashes = prefix_hashes(turns, hot)
    kept = maximal(hashes).select(F.col("conv_id").alias("_conv"), "n_copies")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = hashes.join(kept, hashes["conv_id"].eqNullSafe(kept["_conv"])).select(
        "conv_id", "n_turns", "n_copies", ((F.col("place") - 1) / part_turns).cast("long").alias("part"),
        F.struct("place", turn.alias("text")).alias("turn"),
    )
    return rows.groupBy("conv_id", "n_turns", "n_copies", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", "part", F.ceil(F.col("n_turns") / part_turns).cast("long").alias("n_parts"), "n_turns", "n_copies",
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
    )


def query(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
             string_agg(coalesce(md5('r' || role), '-') || coalesce(md5('t' || text), '-'), ',') OVER w AS pre
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM r WHERE place = n_turns GROUP BY pre),
m AS (SELECT * FROM f WHERE pre NOT IN (SELECT pre FROM r WHERE place < n_turns))
SELECT r.conv_id, CAST((r.place - 1) // 256 AS BIGINT) AS part, CAST((r.n_turns + 255) // 256 AS BIGINT) AS n_parts, r.n_turns, m.n_copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM r JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY r.conv_id, 2, 3, r.n_turns, m.n_copies
"""
