"""Ranked keyword search over an inverted index.

The index is a table of postings on shared storage. A row is the postings of one
term in one block of documents: their ids, the score that the term gives each of
them, and the highest of these scores. Rows are divided into buckets by the hash
of the term and sorted by it inside, so a search opens the buckets of its terms.

A search for the k best documents reads the highest scores of its terms' blocks
first. What the terms could give together bounds every document of a block. The
documents of the most promising blocks are scored exactly, which gives a k-th best
score; then only blocks whose bound reaches it are read. The result is that of
scoring every document.

Words are runs of letters and digits, in lower case. Scores are BM25 with the
corpus as it was when the index was built, rounded to six places; ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.pages import FIRST_PAGE, NUM_RESULTS
from veilframe.sources.session import several_a_core

#: BM25: how soon a word's repetitions stop to count, and how much a text's length does
K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"
PLACES = 6
#: blocks scored first, beyond what the wanted number of results needs
FIRST_BLOCKS = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


class Index(NamedTuple):
    """Where an index lies, and how it is divided."""

    path: str
    buckets: int
    blocks: int
    id_type: str

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def postings(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        """The rows of some terms: the scan is cut to their buckets, and sorted files to the terms."""
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = sorted({r[0] for r in asked.select(self._bucket()).collect()})  # as many as terms
        rows = spark.read.schema(
            "term string, lang string, block int, top double, "
            f"docs array<struct<doc_id:{self.id_type},part:double>>, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))


def build_index(documents: DataFrame, path: str, buckets: int = 64, block_docs: int = 1024) -> Index:
    """Write the index of ``doc_id, lang, text``. Rows without id are left out; a repeated id
    must be the same document.

    A block holds about ``block_docs`` documents, told by the hash of their ids, and a row one
    term of one block, so no list grows with the corpus. Texts travel once, to their blocks;
    there words are counted and gathered without a further exchange. What is exchanged then are
    finished rows. How rare a term is belongs to a row, not to each of its documents.
    """
    spark = documents.sparkSession
    known = documents.where("doc_id IS NOT NULL")
    n = known.count()
    blocks = max(1, math.ceil(n / block_docs))
    docs = known.select(
        "doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    docs = docs.repartition(several_a_core(spark), "block").select(
        "block", "doc_id", "lang", words_of(F.col("text")).alias("words"))
    counts = docs.select("block", "doc_id", "lang", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(
        "block", "term", "doc_id", "lang", "length").agg(F.count("*").alias("tf"))
    counted = counts.groupBy("block", "term", "lang").agg(
        F.count("*").alias("n"), F.sum("tf").alias("words"),
        F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("counts"))
    counted.write.mode("overwrite").parquet(f"{path}/counts")
    counted = spark.read.schema(counted.schema).parquet(f"{path}/counts")
    mean = (counted.agg(F.sum("words")).first()[0] or 0) / max(n, 1) or 1.0
    idf = counted.groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    scored = counted.join(idf, "term").select("term", "lang", "block", F.expr(f"""transform(counts, d -> named_struct(
        'doc_id', d.doc_id, 'part', idf * d.tf * {K1 + 1}D / (d.tf + {K1}D * ({1 - B}D + {B}D * d.length / {mean!r}D))))
        """).alias("docs"))
    rows = scored.select("term", "lang", "block", F.array_max("docs.part").alias("top"), "docs")
    index = Index(path, buckets, blocks, dict(documents.dtypes)["doc_id"])
    rows.withColumn("bucket", index._bucket()).repartition("bucket").sortWithinPartitions(
        "bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    return index


def _scored(postings: DataFrame) -> DataFrame:
    """Every document of the rows with its whole score: all terms of a block are there."""
    each = postings.select("lang", F.explode("docs").alias("d"))
    return each.groupBy("d.doc_id", "lang").agg(F.round(F.sum("d.part"), PLACES).alias("score"))


def search_index(spark: SparkSession, index: Index, query: str, language: str | None = None,
                 num_results: int | None = None, page: int | None = None) -> DataFrame:
    """``doc_id, lang, score`` of the page, best first, ties by id."""
    size, number = num_results or NUM_RESULTS, page or FIRST_PAGE
    wanted = size * number
    terms = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(
        F.explode(F.array_distinct(words_of(F.col("q"))))).collect()]
    rows = index.postings(spark, terms)
    if language:
        rows = rows.where(F.col("lang") == language)
    # A document of a block cannot score more than the tops of all terms there.
    bounds = rows.groupBy("block", "term").agg(F.max("top").alias("top")).groupBy("block").agg(
        F.sum("top").alias("bound"))
    first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(
        FIRST_BLOCKS + wanted // 64).collect()]
    best = _scored(rows.where(F.col("block").isin(first))).orderBy(F.desc("score")).select("score").limit(wanted).agg(
        F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = best["least"] if best["n"] == wanted else 0.0
    open_ = bounds.where(F.col("bound") >= least - 10 ** -PLACES).select("block")
    return _scored(rows.join(open_, "block", "left_semi")).select("doc_id", "lang", "score").orderBy(
        F.desc("score"), "doc_id").offset((number - 1) * size).limit(size)
