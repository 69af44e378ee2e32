"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target over its share of the
corpus, in words. A document is repeated as often as a Poisson variable of that
mean says, drawn by inverting the distribution at a number that is hashed from
the seed and the document id: the same document gets the same count in every
run and on every executor. Copies are then dealt over the whole output by a
hashed key.

Only sums of words by source are shuffled before the copies are; the table of
rates has a row for each source, and a hot source is no group of rows.

Defined cases: the null source is a source of its own; a null or blank text has
no words and is repeated at its source's rate; repeated rows and rows that share
an id, the null id too, get the same count; sources without words, or without
weight, get no copies; a mean over ``MOST * MAX_DRAWS`` copies raises; an empty
table gives an empty one. Columns named ``replica`` or ``mix_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import text_of, words_of

#: A rate above this is drawn as a sum of so many times smaller ones, which has the same distribution.
MOST = 32.0
#: Draws of a document. A source so small for its weight that more were needed ends the job: its copies of one
#: document would be a list too long for a row, and no sensible mix repeats a document 33 million times.
MAX_DRAWS = 1 << 20


def unit(*parts: Column) -> Column:
    """A number from 0 to under 1 hashed from the parts."""
    return hashed(*parts) / F.lit(float(1 << 60))


def hashed(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, weights: Mapping[str, float] | None, epochs: float) -> DataFrame:
    """``source``, the draws for each document and the cumulative distribution of one draw.

    ``weights`` by source; sources not named get none. Without weights all
    sources count alike. The output has ``epochs`` times the words of the input.
    """
    words = docs.groupBy("source").agg(F.sum(F.size(words_of(text_of()))).alias("words"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    words = words.withColumn("weight", weight).filter("words > 0 AND weight > 0")
    share = F.col("weight") / words.agg(F.sum("weight")).scalar()
    rate = F.lit(float(epochs)) * share * words.agg(F.sum("words")).scalar() / F.col("words")
    draws = F.when(F.col("rate") > MOST * MAX_DRAWS, F.raise_error(F.concat(
        F.lit("a document would be repeated more than MOST * MAX_DRAWS times, of source "), F.coalesce("source", F.lit("null")))).cast("int"))
    draws = draws.otherwise(F.greatest(F.ceil(F.least("rate", F.lit(float(MOST * MAX_DRAWS))) / MOST), F.lit(1)).cast("int"))
    one = F.col("rate") / F.col("draws")
    upto = F.ceil(one + 12 * F.sqrt(one) + 20).cast("int")
    first = F.exp(-one)
    cdf = F.aggregate(
        F.sequence(F.lit(1), upto),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, k: F.struct(
            (s["p"] * F.col("rate") / F.col("draws") / k).alias("p"),
            (s["c"] + s["p"] * F.col("rate") / F.col("draws") / k).alias("c"),
            F.concat(s["all"], F.array(s["c"] + s["p"] * F.col("rate") / F.col("draws") / k)).alias("all"),
        ),
        lambda s: s["all"],
    )
    return words.select("source", rate.alias("rate")).withColumn("draws", draws).withColumn("cdf", cdf)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: int = 7) -> DataFrame:
    """The columns of ``docs``, ``replica`` (from 1) and ``mix_key``, in the order of the key."""
    found = rates(docs, weights, epochs).select(F.col("source").alias("name"), "draws", "cdf")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.join(found, F.col("row.source").eqNullSafe(F.col("name")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= unit(F.lit(seed), F.col("row.doc_id"), j))),
    )
    copies = rows.select("row", drawn.alias("n")).filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("replica"))
    copies = copies.withColumn("mix_key", hashed(F.lit(seed), F.lit("order"), F.col("row.doc_id"), F.col("replica")))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("replica", "mix_key")]
    return copies.orderBy("mix_key", "row.doc_id", "replica").select(*own, "replica", "mix_key")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def sql_from(documents: str) -> str:
    """The statement over the rows of ``documents``, a query or table."""
    return rf"""
WITH d AS (SELECT doc_id, text, lang, source, n_chars FROM {documents}),
s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS words FROM d GROUP BY source),
r AS (SELECT source, (1.0 / count(*) OVER ()) * sum(words) OVER () / words AS rate FROM s WHERE words > 0),
p AS (SELECT source, rate, greatest(ceil(rate / 32.0), 1) AS draws FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM p, range(0, 130) AS t(k) WHERE k <= ceil(rate / draws + 12 * sqrt(rate / draws) + 20)),
u AS (SELECT d.*, p.rate, j, CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || j), 1, 15) AS BIGINT) / 1152921504606846976.0 AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, range(1, 1000) AS t(j) WHERE j <= draws),
n AS (SELECT doc_id, text, lang, u.source, n_chars, j, count(c.k) AS n
      FROM (SELECT *, row_number() OVER () AS row FROM u) u LEFT JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY ALL),
t AS (SELECT doc_id, text, lang, source, n_chars, sum(n) AS n FROM n GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS replica FROM t)
SELECT doc_id, text, lang, source, n_chars, replica,
       CAST('0x' || substr(md5('7|order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || replica), 1, 15) AS BIGINT) AS mix_key
FROM e"""


SQL = sql_from("documents")
