"""Expressions over stored model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.lexicon import BLANKS_JAVA

#: answer of a response API: ready text, or outputs made of content parts
RESPONSE_TYPE = (
    "struct<output_text:string,"
    "output:array<struct<content:array<struct<text:string,output_text:string>>>>>"
)


#: closes the array that a candidate is wrapped in; not to be expected in any answer
_END = "--end of candidate--"


def strict_json(candidate: Column) -> Column:
    """The candidate as VARIANT, null unless all of it is one JSON value. The parser
    stops after the first value, so the candidate is parsed as the first of exactly
    two array elements and anything behind it is noticed. Of a repeated key the last one
    counts if the session says so (``sources.session.keep_last_key``); Spark's default is
    to reject such a candidate."""
    wrapped = F.concat(F.lit("["), candidate, F.lit(f',"{_END}"]'))
    pair = F.try_parse_json(wrapped).cast("array<variant>")
    complete = (F.size(pair) == 2) & (
        F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == _END)
    return F.when(F.contains(candidate, F.lit(_END)), F.lit(None)).when(complete, F.get(pair, F.lit(0)))


def json_value(text: Column) -> Column:
    """The JSON in a model answer: from the first ``{`` to the last ``}`` if that
    parses, else from the first ``[`` to the last ``]``, else null."""
    def parsed(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 0)
        return F.when(found != "", strict_json(found))

    return F.coalesce(parsed(r"(?s)\{.*\}"), parsed(r"(?s)\[.*\]"))


def extract_json(text: Column, schema: str | None = None) -> Column:
    """Canonical JSON of an answer, or a struct if a schema is given."""
    canonical = F.to_json(json_value(text))
    return F.from_json(canonical, schema) if schema else canonical


def response_text(response: Column) -> Column:
    """Ready text if there is any, else the part texts joined within an output and
    the outputs joined by newlines; trimmed."""
    def part(p):
        return F.coalesce(F.nullif(p["text"], F.lit("")), p["output_text"], F.lit(""))

    outputs = F.transform(response["output"], lambda o: F.coalesce(
        F.array_join(F.transform(o["content"], part), ""), F.lit(""),
    ))
    text = F.coalesce(
        F.nullif(response["output_text"], F.lit("")), F.array_join(outputs, "\n"), F.lit(""),
    )
    return F.regexp_replace(text, rf"^{BLANKS_JAVA}|{BLANKS_JAVA}\z", "")


def first_text_block(blocks: Column) -> Column:
    """Text of the first content block if that is a text block, else empty."""
    first = F.get(blocks, F.lit(0))
    return F.coalesce(F.when(first["type"] == "text", first["text"]), F.lit(""))
