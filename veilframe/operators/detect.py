"""Detection: pattern families, caller terms, and their merge into disjoint spans.

Every operator adds an array column to the row it found the text in. Nothing is
shuffled, so a scan of any size stays a scan; only a *table* of terms needs a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.patterns import (
    CATEGORIES, FAMILIES, FULL_BOUNDARY, SEQ, Family, MaskConfig, cheap_classes, java_pattern, to_java,
)
from veilframe.operators.entities import EntityConfig, entity_marks, with_located_entities

#: tie-break ranks after the pattern families: entities, then terms in rule order
RULE_SEQ = len(FAMILIES) + 10

_REGEX_META = ".*+?^${}()|[]\\"


@dataclass(frozen=True)
class Rule:
    term: str
    category: str = "CUSTOM"
    case_sensitive: bool = False

    def __post_init__(self):
        if self.category not in CATEGORIES:
            raise ValueError(f"unknown category {self.category}")
        if not self.term:
            raise ValueError("a rule needs a term")


@dataclass(frozen=True)
class Search:
    """One pattern to look for, and how its spans are labelled."""

    pattern: str
    seq: int
    category: str
    source: str
    #: a cheap SQL condition that every text with a match meets
    gate: str | None = None


#: no marked texts, and no spans of any search
_NO_MARKS = "cast(array() as array<struct<seq:int,category:string,source:string,marked:string>>)"
_HITS = f"cast(array() as array<struct<seq:int,spans:{S.SPAN_TYPE}>>)"


def with_matches(df: DataFrame, text_col: str, searches: Sequence[Search], also: dict[str, str] | None = None) -> DataFrame:
    """Add ``_hits``: of each search with a match its ``seq`` and its ``spans``, in the order
    of the searches. ``also`` are other marked texts (SQL over ``_markable``), found in the
    same pass; they are added, and so is ``_markable``.

    The first projection marks the matches: patterns behind gates, compiled, see
    :data:`veilframe.functions.spans.APART`. The other is a lambda, which Spark interprets,
    so it sees only the few searches that found something. It refers more than once to
    what the one before computed, so Catalyst keeps them apart and a pattern runs once.
    """
    also = also or {}
    keep = [*df.columns, *(["_markable", *also] if also else [])]
    if not searches and not also:
        return df.select("*", F.expr(_HITS).alias("_hits"))

    def marked(s: Search) -> str:
        hit = f"""named_struct('seq', {s.seq}, 'category', {S.quote(s.category)}, 'source', {S.quote(s.source)},
            'marked', {S.mark_matches("_markable", s.pattern)})"""
        return f"CASE WHEN {s.gate or '_markable IS NOT NULL'} THEN array({hit}) ELSE {_NO_MARKS} END"

    work = df.select("*", F.expr(S.markable(text_col)).alias("_markable"))
    marks = work.select("*", *[F.expr(sql).alias(name) for name, sql in also.items()],
                        F.expr(f"flatten(array({', '.join([_NO_MARKS, *map(marked, searches)])}))").alias("_marks"),
                        F.expr(S.APART).alias("_apart"))
    spans = S.let("p", f"split(f.marked, '{S.MARK}', -1)", S.locate("p", "f.seq", "f.category", "f.source"))
    return marks.select(*keep, F.expr(f"""CASE WHEN size(_marks) = 0 OR _apart THEN {_HITS} ELSE
        transform(filter(_marks, x -> x.marked != _markable),
                  f -> named_struct('seq', f.seq, 'spans', {spans})) END""").alias("_hits"))


_NINE_DIGITS = "[0-9](?:[^0-9]?[0-9]){8}"


def _gate(family: Family, text_col: str) -> str | None:
    either = "".join(f" OR contains({text_col}, {S.quote(t)})" for t in family.or_any_of)
    tests = {"none": [], "some": ["_some_digits"], "nine": [f"(_nine_digits{either})"]}[family.digits]
    where = "_lower" if family.ignore_case else text_col
    if family.colons:
        tests.append(f"_colons{' + _hyphens' if family.hyphens else ''} >= {family.colons}")
    if family.shape:
        tests.append(f"{text_col} RLIKE {S.quote(cheap_classes(to_java(family.shape)))}")
    if family.any_of:
        tests.append(S.holds_any(where, family.any_of))
    return " AND ".join(tests) or None


def _with_families(df: DataFrame, text_col: str, config: MaskConfig, more: Sequence[Search] = (),
                   also: dict[str, str] | None = None) -> DataFrame:
    """``with_matches`` for the enabled families, and what else is looked for in the same pass.
    What the gates share is computed once per text: its lower case, its colons and hyphens, and
    whether it has digits."""
    families = config.families()
    count = lambda c: f"length({text_col}) - length(replace({text_col}, '{c}', ''))"
    shared = df.select(
        "*", F.expr(f"lower({text_col})").alias("_lower"),
        F.expr(count(":")).alias("_colons"), F.expr(count("-")).alias("_hyphens"),
        F.expr(f"{text_col} RLIKE '[0-9]'").alias("_some_digits"),
        F.expr(f"{text_col} RLIKE {S.quote(_NINE_DIGITS)}").alias("_nine_digits"),
    )
    found = with_matches(shared, text_col, [
        Search(java_pattern(f, config.id_min_length), SEQ[f.name], f.category, "regex", _gate(f, text_col))
        for f in families
    ] + list(more), also)
    return found.drop("_lower", "_colons", "_hyphens", "_some_digits", "_nine_digits")


#: all spans of the searches, in their order
_ALL_SPANS = "flatten(_hits.spans)"


def _spans_of(seqs: str) -> str:
    """The spans of some searches, of those that ``_hits`` has; ``seqs`` are their bits."""
    return f"flatten(transform(filter(_hits, o -> o.seq < 64 AND shiftleft(1L, o.seq) & {seqs} != 0), o -> o.spans))"


def uncancelled(families: Sequence[Family]) -> str:
    """The spans that no raw match of their families' cancelling families touches. Searches are
    bits (families come first): a look at the bits tells whether there are rivals at all."""
    active = {f.name for f in families}
    bits = lambda names: sum(1 << SEQ[n] for n in names)
    rivals = {SEQ[f.name]: bits(n for n in f.cancelled_by if n in active) for f in families}
    of = f"coalesce(get(array({', '.join(f'{rivals.get(seq, 0)}L' for seq in range(len(FAMILIES) + 1))}), h.seq), 0L)"
    kept = S.let("rival", _spans_of("rivals"), S.drop_overlapping("h.spans", ["rival"]))
    spans = S.let("rivals", of, f"CASE WHEN there & rivals = 0 THEN h.spans ELSE {kept} END")
    if "code" in active:
        mails = "NOT exists(mails, m -> m.value = x.value) AND" if "email" in active else ""
        named = f"filter(s, x -> {mails} NOT x.value RLIKE '^[0-9]+$')"
        if mails:
            named = S.let("mails", _spans_of(f"{bits(['email'])}L"), named)
        spans = f"CASE WHEN h.seq = {SEQ['code']} THEN {S.let('s', spans, named)} ELSE {spans} END"
    there = "aggregate(_hits, 0L, (m, o) -> CASE WHEN o.seq < 64 THEN m | shiftleft(1L, o.seq) ELSE m END)"
    return f"""CASE WHEN size(_hits) = 0 THEN {S.NO_SPANS}
        ELSE {S.let("there", there, f"flatten(transform(_hits, h -> {spans}))")} END"""


def _collect(found: DataFrame, keep: Sequence[str], text_col: str, spans: str, out: str) -> DataFrame:
    together = found.select(*keep, F.expr(spans).alias("_together"))
    return together.select(*keep, F.expr(S.own_values(text_col, "_together")).alias(out))


def detect_patterns(df: DataFrame, text_col: str = "text", config: MaskConfig = MaskConfig(),
                    out: str = "spans") -> DataFrame:
    """Spans of the enabled pattern families after cancellation, before the merge."""
    return _collect(_with_families(df, text_col, config), df.columns, text_col, uncancelled(config.families()), out)


def find_all_matches(df: DataFrame, text_col: str = "text",
                     config: MaskConfig = MaskConfig(), out: str = "spans") -> DataFrame:
    """Raw matches of every enabled family: no cancellation, no merge."""
    return _collect(_with_families(df, text_col, config), df.columns, text_col, _ALL_SPANS, out)


def term_pattern(term: str, case_sensitive: bool) -> str:
    """Whole-word pattern of a literal term. Both boundaries are two-sided: a term
    that starts or ends in a symbol only matches beside a word character."""
    literal = "".join("\\" + c if c in _REGEX_META else c for c in term)
    fold = "" if case_sensitive else "(?i)" if term.isascii() else "(?iu)"
    return fold + FULL_BOUNDARY + literal + FULL_BOUNDARY


def _rule_searches(rules: Sequence[Rule], text_col: str) -> list[Search]:
    def gate(rule: Rule) -> str:
        if rule.case_sensitive:
            return f"contains({text_col}, {S.quote(rule.term)})"
        return f"contains(lower({text_col}), {S.quote(rule.term.lower())})"

    return [Search(term_pattern(r.term, r.case_sensitive), RULE_SEQ + i, r.category, "manual", gate(r))
            for i, r in enumerate(rules)]


def detect_terms(df: DataFrame, rules: Sequence[Rule], text_col: str = "text",
                 out: str = "spans") -> DataFrame:
    """Spans of caller terms given with the request, in rule order.

    The terms become literal expressions behind a plain substring gate. For a
    *table* of terms use :func:`veilframe.operators.terms.detect_term_table`.
    """
    found = with_matches(df, text_col, _rule_searches(rules, text_col))
    return _collect(found, df.columns, text_col, _ALL_SPANS, out)


def merge_span_column(df: DataFrame, spans_col: str = "spans", out: str = "spans") -> DataFrame:
    """Reduce a span array to disjoint spans ordered by start."""
    return df.withColumn(out, F.expr(S.merge_spans(spans_col)))


def detect_sensitive(df: DataFrame, text_col: str = "text", config: MaskConfig = MaskConfig(),
                     rules: Sequence[Rule] = (), entities: EntityConfig = EntityConfig(),
                     out: str = "spans") -> DataFrame:
    """Patterns, entities and terms, merged into disjoint spans ordered by start."""
    keep = df.columns
    persons, organizations = config.on("person"), config.on("organization")
    found = _with_families(df, text_col, config, _rule_searches(rules, text_col),
                           entity_marks(entities, persons, organizations, "_markable"))
    together = uncancelled(config.families())
    if persons or organizations:
        found = with_located_entities(found, [*keep, "_hits"], entities, persons, organizations, "_entity_spans")
        together = f"concat({together}, _entity_spans)"
    spans = found.select(*keep, F.expr(together).alias("_all_spans"))
    merged = spans.select(*keep, F.expr(S.merge_spans("_all_spans")).alias("_merged"))
    return merged.select(*keep, F.expr(S.own_values(text_col, "_merged")).alias(out))


def span_rows(df: DataFrame, keys: Sequence[str], spans_col: str = "spans") -> DataFrame:
    """One row per span. The outer form keeps Catalyst from testing the array for
    emptiness below the detection, which would run the whole detection twice."""
    exploded = df.select(*keys, F.explode_outer(spans_col).alias("_s"))
    return exploded.where(F.col("_s").isNotNull()).select(
        *keys, "_s.seq", "_s.start_idx", "_s.end_idx", "_s.category", "_s.source", "_s.value",
    )
