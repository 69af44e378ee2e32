"""Masking: consistent placeholders, rewritten text, and the way back.

A scope is what shares one mapping. When the scope is a single text everything
happens inside its row (:func:`anonymize`). When it is a conversation, only the
spans travel: they are numbered with aggregates and joins keyed by
``(scope, value)``, and each text is joined back once by its own key, so neither a
hot value nor a conversation with a third of all rows ends up in one task.

No text may leave unmasked, so every join takes nulls for equal, a text is told by
its item *and* the hash of what it says (:data:`TEXT_ID`), and a span that finds no
placeholder ends the job. Null scopes share one mapping; texts of one item follow
each other in the order of their hashes; repeated rows are masked alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import placeholders as P
from veilframe.functions import spans as S
from veilframe.functions.patterns import SEQ, MaskConfig
from veilframe.operators.detect import RULE_SEQ, Rule, detect_sensitive
from veilframe.operators.entities import ORG_SEQ, PERSON_SEQ, TITLE_SEQ, EntityConfig
from veilframe.operators.scopes import SMALL, divided, in_order, mapping_rows, masked_texts, restored_texts
from veilframe.sources.session import materialise


#: the number of a stored row
_ROW = "_row_id"
#: a text of more characters is stored with the values of its spans
_LONG = 4096
#: what tells a text from all others of its scope, and orders them
TEXT_ID = "_text_id"


def identified(df: DataFrame, item: str, text_col: str) -> DataFrame:
    """``TEXT_ID``: the item, which may be null or tied, and the MD5 of the text."""
    return df.withColumn(TEXT_ID, F.struct(
        F.col(item).alias("item"), F.unhex(F.md5(text_col)).alias("digest")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Join on ``keys``, null to null; the keys of ``left`` stay."""
    other = {k: f"_other_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    joined = left.join(right.withColumnsRenamed(other), reduce(Column.__and__, same), how)
    return joined.drop(*other.values())


def with_placeholders(spans: DataFrame, mapping: DataFrame, scope: str) -> DataFrame:
    """The spans with their ``key`` and ``placeholder``; one that has none raises, so that
    nothing is written instead of an original."""
    known = mapping.select(scope, "key", "placeholder")
    joined = join_null_safe(spans.withColumn("key", F.lower("value")), known, [scope, "key"], "left")
    return joined.withColumn("placeholder", F.coalesce(
        "placeholder", F.raise_error(F.lit("a span has no placeholder")).cast("string")))


class Masked(NamedTuple):
    texts: DataFrame
    mapping: DataFrame
    spans: DataFrame


def anonymize(df: DataFrame, text_col: str = "text", config: MaskConfig = MaskConfig(),
              rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig()) -> DataFrame:
    """Mask each text on its own. Adds ``masked``, ``mapping``, ``spans`` and
    ``collision`` (the text already held something that looks like a placeholder).

    Row-local, so it runs unchanged on a stream and never shuffles.
    """
    keep = df.columns
    style = config.placeholder_style
    found = detect_sensitive(df, text_col, config, rules, entities, "spans")
    # Each step refers more than once to what the one before computed, so Catalyst keeps
    # them apart and nothing is computed per element. A few spans are compared pairwise, more are sorted.
    few = f"size(spans) <= {2 * S.FEW}"
    keyed = found.select(
        "*", F.expr(f"CASE WHEN {few} THEN transform(spans, x -> lower(x.value)) END").alias("_few"),
        F.expr(f"CASE WHEN NOT {few} THEN {S.by_key('spans')} END").alias("_keys"))
    entries = S.let("runs", S.key_runs("_keys"), S.let(
        "entries", P.entries("spans", "_keys", "runs"), P.numbered("entries", style)))
    numbered = keyed.select(
        "*", F.expr(f"CASE WHEN _few IS NOT NULL THEN {P.first_places('_few')} END").alias("_first"),
        F.expr(f"CASE WHEN _keys IS NOT NULL THEN {entries} END").alias("_numbered"))
    named = numbered.select(
        "*", F.expr(f"CASE WHEN _first IS NOT NULL THEN {P.tokens_of_few('spans', '_first', style)} END").alias("_tokens"))
    placed = named.select(
        "*", F.expr(f"""CASE WHEN _tokens IS NOT NULL THEN {P.mapping_of_few('spans', '_few', '_tokens')}
          ELSE {P.mapping_of("_numbered")} END""").alias("mapping"),
        F.expr(f"""CASE WHEN _tokens IS NOT NULL THEN {P.pieces_of_few('spans', '_first', '_tokens')}
          ELSE {P.pieces_of("_numbered", "_keys", "spans")} END""").alias("_pieces"),
    )
    return placed.select(
        *keep,
        F.expr(S.splice(text_col, "_pieces")).alias("masked"),
        "mapping",
        "spans",
        F.expr(f"{text_col} RLIKE {S.quote(P.token_pattern(style))}").alias("collision"),
    )


def restore(df: DataFrame, text_col: str = "masked", mapping_col: str = "mapping",
            style: str = "brackets", out: str = "restored") -> DataFrame:
    """Undo :func:`anonymize` with the mapping that travels in the same row."""
    keep = df.columns
    return df.select("*", F.expr(
        f"map_from_entries(transform({mapping_col}, m -> struct(m.placeholder, m.original)))"
    ).alias("_lookup")).select(
        *keep, F.expr(P.restore_tokens(text_col, "_lookup", style)).alias(out),
    )


def first_entries(spans: DataFrame, scope: str, item: str) -> DataFrame:
    """One row per ``(scope, lower(value))`` with its first occurrence by ``(item,
    start_idx)`` and the number of occurrences. Mergeable aggregates, so a value that
    fills a third of the spans is reduced before the shuffle."""
    return (
        spans.groupBy(scope, F.lower("value").alias("key"))
        .agg(
            F.min(F.struct(F.col(item).alias("item"), "start_idx", "value", "category", "source"))
            .alias("first"),
            F.count("*").alias("count"),
        )
        .select(
            scope, "key", "first.item", "first.start_idx",
            F.col("first.value").alias("original"), "first.category", "first.source", "count",
        )
    )


def number_entries(entries: DataFrame, scope: str, style: str = "brackets",
                   parts: int | None = None, taken: DataFrame | None = None,
                   keep: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """Give entries their placeholders: per scope and category in order of appearance,
    after the numbers already ``taken (scope, category, _taken)``.

    A scope may hold a large share of all rows, so there is no window over a whole
    scope: entries are dealt to ``parts`` ranges of equal size by (scope, category, item,
    place), whatever type and values items have, and ranked inside their range; a range
    adds the number of entries of the ranges before it, of which a scope has at most
    ``parts``. The ranges are written once (by ``keep``): both uses must see the same.
    """
    group = [scope, "category"]
    n = parts or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(entries.repartitionByRange(n, *group, "item", "start_idx", "key").withColumn(
        "_range", F.spark_partition_id()), "entries-in-ranges")
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1,
    )
    offsets = sizes.select(
        *group, "_range", F.sum("_n").over(before).alias("_before"),
    ).where("_before > 0")
    inside = Window.partitionBy(*group, "_range").orderBy("item", "start_idx", "key")
    ranked = join_null_safe(
        ranged.withColumn("_rank", F.row_number().over(inside)), offsets, [*group, "_range"], "left")
    index = "_rank + coalesce(_before, 0)"
    if taken is not None:
        ranked = join_null_safe(ranked, taken, group, "left")
        index += " + coalesce(_taken, 0)"
    return ranked.select(
        scope, "key", "original",
        F.expr(P.format_placeholder("category", f"cast({index} as bigint)", style))
        .alias("placeholder"),
        "category", "source", "count",
        F.col("item").alias("first_item"), F.col("start_idx").alias("first_idx"),
    )


def build_mapping(spans: DataFrame, scope: str, item: str, style: str = "brackets",
                  parts: int | None = None) -> DataFrame:
    """The mapping of every scope. The first occurrence of a value fixes spelling,
    category and source; ``count`` is its number of occurrences."""
    return number_entries(first_entries(spans, scope, item), scope, style, parts)


def place(df: DataFrame, pieces: DataFrame, keys: Sequence[str], text_col: str,
          out: str) -> DataFrame:
    """Splice ``pieces`` (rows of keys, start_idx, end_idx, placeholder) into the
    texts they came from. A group is the pieces of one text; repeated rows bring the
    same pieces, which count once."""
    columns = [c for c in df.columns if c not in keys]
    per_text = pieces.groupBy(*keys).agg(F.array_sort(F.collect_set(
        F.struct("start_idx", "end_idx", "placeholder"),
    )).alias("_pieces"))
    joined = join_null_safe(df, per_text, keys, "left").withColumn(
        "_pieces", F.expr("coalesce(_pieces, cast(array() as "
                          "array<struct<start_idx:int,end_idx:int,placeholder:string>>))"),
    )
    return joined.select(*keys, *columns, F.expr(S.splice(text_col, "_pieces")).alias(out))


def _labels(config: MaskConfig, rules: Sequence[Rule]) -> tuple[dict[int, str], dict[int, str]]:
    """Category and source of the spans, by their ``seq``."""
    kinds = [(SEQ[f.name], f.category, "regex") for f in config.families()]
    kinds += [(PERSON_SEQ, "PERSON", "ner"), (TITLE_SEQ, "PERSON", "ner"), (ORG_SEQ, "COMPANY", "ner")]
    kinds += [(RULE_SEQ + i, r.category, "manual") for i, r in enumerate(rules)]
    return {seq: category for seq, category, _ in kinds}, {seq: source for seq, _, source in kinds}


def _labelled(seq: str, labels: dict[int, str]) -> Column:
    return F.expr(f"CASE {seq} {' '.join(f'WHEN {k} THEN {S.quote(v)}' for k, v in labels.items())} END")


def anonymize_many(df: DataFrame, scope: str, item: str, text_col: str = "text",
                   config: MaskConfig = MaskConfig(), rules: Sequence[Rule] = (),
                   entities: EntityConfig = EntityConfig(),
                   parts: int | None = None, small: int | None = None) -> Masked:
    """Mask texts that share a mapping per ``scope``; ``item`` orders the texts of a scope.

    Scopes and items may be null and items tied, see the module. The texts and the places of
    their spans are written once to the shared folder: the patterns must not run twice. A scope of
    at most ``small`` spans is numbered by a pass over its texts, see
    :mod:`veilframe.operators.scopes`; larger ones, or all if ``parts`` are asked for, by joins.
    """
    if small is None:
        small = SMALL if parts is None else 0
    style = config.placeholder_style
    categories, sources = _labels(config, rules)
    detected = detect_sensitive(df, text_col, config, rules, entities, "_spans")
    # the id is fixed by storing it: pieces of a large scope find their text by it
    found = materialise(detected.select(
        *df.columns, F.monotonically_increasing_id().alias(_ROW),
        F.expr("flatten(transform(_spans, x -> array(x.seq, x.start_idx, x.end_idx)))").alias("_at"),
        # the keys, unless lower case is the same everywhere
        F.expr(f"CASE WHEN length({text_col}) != octet_length({text_col}) THEN transform(_spans, x -> lower(x.value)) END")
        .alias("_keys"),
        # a long text is not searched from its beginning for every value
        F.expr(f"CASE WHEN length({text_col}) > {_LONG} THEN transform(_spans, x -> x.value) END").alias("_values")),
        "texts-and-spans")
    few, many = divided(found, scope, f"1 + size(_at) div 3 + coalesce(length({text_col}), 0) div 256", small)
    ordered = in_order(few.drop(_ROW, "_values"), scope, item, text_col)
    columns = [scope, item, *[c for c in df.columns if c not in (scope, item)]]
    texts = masked_texts(ordered, scope, text_col, categories, style).select(*columns, "masked")
    mapping = mapping_rows(ordered, scope, item, text_col, categories, sources, style)

    def rows(of: DataFrame, *keys: str) -> DataFrame:
        """The spans of the texts as rows."""
        span = f"""named_struct('seq', get(_at, i), 'start_idx', get(_at, i + 1), 'end_idx', get(_at, i + 2), 'value',
          CASE WHEN _values IS NULL THEN substring({text_col}, get(_at, i + 1) + 1, get(_at, i + 2) - get(_at, i + 1))
            ELSE get(_values, cast(i div 3 as int)) END)"""
        at = of.where("size(_at) > 0").select(
            *keys, F.explode(F.expr(f"transform(sequence(0, size(_at) - 3, 3), i -> {span})")).alias("_p"))
        return at.select(
            *keys, "_p.seq", "_p.start_idx", "_p.end_idx", _labelled("_p.seq", categories).alias("category"),
            _labelled("_p.seq", sources).alias("source"), "_p.value")

    if many is not None:
        numbered = build_mapping(rows(identified(many, item, text_col), scope, TEXT_ID), scope, TEXT_ID, style, parts).withColumn(
            "first_item", F.col("first_item.item"))
        spans = rows(many, _ROW, scope).select(_ROW, scope, "start_idx", "end_idx", "value")
        pieces = with_placeholders(spans, numbered, scope).groupBy(_ROW).agg(
            F.sort_array(F.collect_list(F.struct("start_idx", "end_idx", "placeholder"))).alias("_pieces"))
        placed = many.join(pieces.withColumnRenamed(_ROW, "_of"), F.col(_ROW) == F.col("_of"), "left").select(
            *columns, F.expr(f"CASE WHEN _pieces IS NULL THEN {text_col} ELSE {S.splice(text_col, '_pieces')} END").alias("masked"))
        texts = texts.unionByName(placed) if small > 0 else placed
        mapping = mapping.unionByName(numbered) if small > 0 else numbered
    spans = rows(found, scope, item)
    return Masked(texts, mapping, spans)


def deanonymize(df: DataFrame, mapping: DataFrame, scope: str, keys: Sequence[str],
                text_col: str = "text", style: str = "brackets",
                out: str = "restored", small: int = SMALL) -> DataFrame:
    """Put originals back from a mapping *table*. Scopes of up to ``small`` texts and entries are
    restored by a pass over them. In larger ones tokens are joined by ``(scope, placeholder)``, so a
    mapping of any size is never gathered; tokens the mapping does not know stay as they are."""
    pattern = P.token_pattern(style)
    known = mapping.select(scope, F.col("placeholder").alias("_token"), "original")
    done, many, known = restored_texts(df, known, scope, text_col, pattern, out, small)
    columns = [*keys, *[c for c in df.columns if c not in keys], out]
    if many is None:
        return done.select(*columns)
    keyed = many.withColumn(TEXT_ID, F.unhex(F.md5(text_col)))
    text = [*keys, TEXT_ID]
    tokens = keyed.select(
        *dict.fromkeys([*text, scope]),
        F.explode_outer(F.expr(S.find_all(text_col, pattern))).alias("_t"),
    ).where(F.col("_t").isNotNull())
    pieces = join_null_safe(
        tokens.withColumn("_token", F.col("_t.value")), known, [scope, "_token"],
    ).select(*text, F.col("_t.start_idx"), F.col("_t.end_idx"), F.col("original").alias("placeholder"))
    placed = place(keyed, pieces, text, text_col, out).select(*columns)
    return done.select(*columns).unionByName(placed) if small > 0 else placed


def echo(sent: DataFrame) -> DataFrame:
    """The default responder: answers every message with its own masked text."""
    return sent.withColumn("content", F.col("masked"))


def round_trip(df: DataFrame, responder: Callable[[DataFrame], DataFrame] = echo,
               scope: str = "conv_id", turn: str = "turn", role: str = "role",
               text_col: str = "text", config: MaskConfig = MaskConfig(),
               rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig(),
               mask_system: bool = True) -> DataFrame:
    """Mask conversations, hand them to ``responder``, restore what comes back.

    The responder gets ``scope, turn, role, masked`` and returns it with a
    ``content`` column; it never sees an original, and its answers are written once,
    so an expensive one is not asked twice. System prompts take part in the
    numbering first, or go out as they are with ``mask_system=False``. The result
    has what was sent, the raw answer and the restored one.
    """
    is_system = F.coalesce(F.col(role) == "system", F.lit(False))
    ordered = df.withColumn("_item", F.struct((~is_system).alias("spoken"), F.col(turn).alias("turn")))
    to_mask = ordered if mask_system else ordered.where(~is_system)
    masked = anonymize_many(to_mask, scope, "_item", text_col, config, rules, entities)
    sent = masked.texts
    if not mask_system:
        sent = sent.unionByName(ordered.where(is_system).withColumn("masked", F.col(text_col)))
    answers = materialise(
        responder(sent.select(scope, turn, role, "masked", "_item")), "answers",
    )
    restored = deanonymize(
        answers, masked.mapping, scope, [scope, "_item"], "content",
        config.placeholder_style, "restored",
    )
    return restored.select(
        scope, turn, role, F.col("masked").alias("sent"),
        F.col("content").alias("answer"), "restored",
    )


def span_rollup(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spans and distinct values (ignoring case) per group."""
    return spans.groupBy(*by).agg(
        F.count("*").alias("n_spans"),
        F.countDistinct(F.lower("value")).alias("n_values"),
    )
