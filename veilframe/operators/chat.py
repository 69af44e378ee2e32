"""Request bodies for three chat dialects, built from a long conversation table.

A conversation may be larger than one row should be, so a body comes in parts of a
bounded number of turns: ``(conv_id, part, n_parts, body)``. The parts of a
conversation, concatenated in order, are its request body; a conversation of
ordinary length has one part. The first system turn is the system prompt.

Turns are numbered first, in the order of (turn, role, text), nulls first; parts, commas
and the last turn go by these places. So turn numbers may have gaps, be null or tied,
the null conversation is one too, and every body is one JSON value. A null role
is no system turn; a null role or text is left out of its message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.masking import join_null_safe
from veilframe.operators.places import with_places

# Default model names and sampling limits of the three dialects.
SYSTEM_FIRST_MODEL = "gpt-4o-mini"
SYSTEM_FIRST_TEMPERATURE = 0.7
HISTORY_LAST_MODEL = "gemini-2.0-flash"
SYSTEM_FIELD_MODEL = "claude-sonnet-4-20250514"
SYSTEM_FIELD_MAX_TOKENS = 2048

TURNS_PER_PART = 1024


def _message(role: Column, content: Column) -> Column:
    return F.to_json(F.struct(role.alias("role"), content.alias("content")))


def _spoken(role: Column) -> Column:
    return F.coalesce(role, F.lit("")) != "system"


def _parts(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """Turns per ``(conv_id, _part)`` next to the facts about their conversation.

    The facts are mergeable aggregates, partial before the shuffle. Joining them to
    the parts is what AQE may split when one conversation is hot; nothing after the
    join depends on its partitioning.
    """
    turns = with_places(
        turns.select("conv_id", "turn", "role", "text"), "conv_id", ["turn", "role", "text"], "_place",
    ).select("conv_id", F.col("_place").alias("turn"), "role", "text")
    facts = turns.groupBy("conv_id").agg(
        F.min(F.struct("turn", "role", "text")).alias("first"),
        F.max(F.struct("turn", "text")).alias("last"),
        F.min(F.when(_spoken(F.col("role")), F.col("turn"))).alias("_first_spoken"),
    ).select(
        "conv_id", "_first_spoken",
        F.col("last.turn").alias("_last_turn"), F.col("last.text").alias("_last_text"),
        F.when(F.col("first.role") == "system", F.col("first.turn")).alias("_prompt_turn"),
        F.when(F.col("first.role") == "system", F.col("first.text")).alias("_prompt"),
        F.floor(F.col("first.turn") / turns_per_part).alias("_first_part"),
        F.floor(F.col("last.turn") / turns_per_part).alias("_last_part"),
    )
    parts = turns.groupBy(
        "conv_id", F.floor(F.col("turn") / turns_per_part).alias("_part"),
    ).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    return join_null_safe(parts, facts, ["conv_id"])


def _assemble(parts: DataFrame, elements: Column, head: Column, tail: str,
              **extra: Column) -> DataFrame:
    """``head`` before the elements of the first part, ``tail`` after the last one's."""
    first = F.col("_part") == F.col("_first_part")
    last = F.col("_part") == F.col("_last_part")
    return parts.select(
        "conv_id", (F.col("_part") - F.col("_first_part")).alias("part"),
        last.alias("is_last"),
        F.concat(
            F.when(first, head).otherwise(""), F.array_join(elements, ""),
            F.when(last, F.lit(tail)).otherwise(""),
        ).alias("body"),
        *[c.alias(n) for n, c in extra.items()],
    )


def _spoken_after_prompt() -> Column:
    """All turns but the prompt, each with a comma unless it is the last."""
    kept = F.filter("_turns", lambda t: ~F.coalesce(
        t["turn"] == F.col("_prompt_turn"), F.lit(False)))
    return F.transform(kept, lambda t: F.concat(
        _message(t["role"], t["text"]),
        F.when(t["turn"] < F.col("_last_turn"), ",").otherwise(""),
    ))


def chat_payload_system_first(turns: DataFrame, model: str = SYSTEM_FIRST_MODEL,
                              temperature: float = SYSTEM_FIRST_TEMPERATURE,
                              max_tokens: int | None = None, json_mode: bool = False,
                              turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """System prompt as first message, then the turns; ``max_tokens`` only if set."""
    system = F.when(F.col("_prompt") != "", F.concat(
        _message(F.lit("system"), F.col("_prompt")),
        F.when(F.col("_prompt_turn") < F.col("_last_turn"), ",").otherwise(""),
    )).otherwise("")
    head = F.concat(F.lit(f'{{"model":"{model}","messages":['), system)
    tail = f'],"temperature":{temperature}'
    tail += f',"max_tokens":{max_tokens}' if max_tokens else ""
    tail += ',"response_format":{"type":"json_object"}' if json_mode else ""
    return _assemble(_parts(turns, turns_per_part), _spoken_after_prompt(), head, tail + "}")


def chat_payload_system_field(turns: DataFrame, model: str = SYSTEM_FIELD_MODEL,
                              max_tokens: int = SYSTEM_FIELD_MAX_TOKENS,
                              turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """System prompt as a field of its own, turns unchanged; no temperature is sent."""
    as_json = F.to_json(F.struct(F.col("_prompt").alias("system")))
    system = F.when(F.col("_prompt") != "", F.concat(
        F.expr("substring(_j, 2, length(_j) - 2)"), F.lit(","))).otherwise("")
    head = F.concat(
        F.lit(f'{{"model":"{model}","max_tokens":{max_tokens},'), system, F.lit('"messages":['))
    parts = _parts(turns, turns_per_part).withColumn("_j", as_json)
    return _assemble(parts, _spoken_after_prompt(), head, "]}")


def chat_payload_history_last(turns: DataFrame,
                              turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """History of all turns but the last, without system turns, ``assistant`` renamed
    to ``model``. The last turn is sent apart, as ``message`` of the last part; no
    temperature is sent."""
    history = F.filter("_turns", lambda t: (
        _spoken(t["role"]) & (t["turn"] < F.col("_last_turn"))))
    elements = F.transform(history, lambda t: F.concat(
        F.when(t["turn"] > F.col("_first_spoken"), ",").otherwise(""),
        F.to_json(F.struct(
            F.when(t["role"] == "assistant", "model").otherwise(t["role"]).alias("role"),
            F.array(F.struct(t["text"].alias("text"))).alias("parts"),
        )),
    ))
    return _assemble(
        _parts(turns, turns_per_part), elements, F.lit('{"history":['), "]}",
        system_instruction=F.when(F.col("_part") == F.col("_first_part"), F.col("_prompt")),
        message=F.when(F.col("_part") == F.col("_last_part"), F.col("_last_text")),
    )
