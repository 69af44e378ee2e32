"""Expressions over URLs and page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.markdown import page_to_markdown  # noqa: F401
from veilframe.functions.patterns import to_java

# Fixed value: what a reader service puts before the page text.
MARKDOWN_MARKER = "Markdown Content:"

_OUTER_BLANKS = to_java(r"^\s+|\s+") + r"\z"

def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, _OUTER_BLANKS, "")


def normalize_url(url: Column) -> Column:
    """Trimmed; ``https://`` in front unless it has an http(s) scheme in any case."""
    trimmed = js_trim(url)
    return F.when(trimmed.rlike(r"(?i)^https?://"), trimmed).otherwise(
        F.concat(F.lit("https://"), trimmed))


def strip_envelope(payload: Column) -> Column:
    """What follows the first marker, trimmed; unchanged without a marker."""
    at = F.instr(payload, MARKDOWN_MARKER)
    rest = F.substring(payload, at + len(MARKDOWN_MARKER), F.length(payload))
    return F.when(at > 0, js_trim(rest)).otherwise(payload)
