"""Pages and keyword search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import web

# Default size and number of a result page.
NUM_RESULTS = 10
FIRST_PAGE = 1


def normalize_urls(pages: DataFrame, url_col: str = "url", out: str = "url") -> DataFrame:
    return pages.withColumn(out, web.normalize_url(F.col(url_col)))


def pages_to_markdown(pages: DataFrame, html_col: str = "html", out: str = "markdown") -> DataFrame:
    return pages.withColumn(out, web.page_to_markdown(F.col(html_col)))


def search_documents(documents: DataFrame, query: str, language: str | None = None,
                     num_results: int | None = None, page: int | None = None) -> DataFrame:
    """Documents that contain query words, most different words first, ties by id.

    The text is only tested, never carried: what is sorted is ``(doc_id, score)`` and
    the top ``page * num_results`` of them.
    """
    size, number = num_results or NUM_RESULTS, page or FIRST_PAGE
    found = documents.where(F.col("lang") == language) if language else documents
    lowered = F.lower("text")
    score = F.lit(0)
    for word in dict.fromkeys(query.lower().split()):
        score = score + F.contains(lowered, F.lit(word)).cast("int")
    return (
        found.select("doc_id", "lang", score.alias("score")).where("score > 0")
        .orderBy(F.desc("score"), "doc_id").offset((number - 1) * size).limit(size)
    )
