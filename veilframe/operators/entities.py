"""Person and organisation names by pattern, filtered by stop lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import lexicon as L
from veilframe.functions import spans as S
from veilframe.functions.patterns import FAMILIES

PERSON_SEQ = len(FAMILIES) + 1
TITLE_SEQ = len(FAMILIES) + 2
ORG_SEQ = len(FAMILIES) + 3


@dataclass(frozen=True)
class EntityConfig:
    """``first_only`` reports a name once per text instead of at each occurrence;
    ``unicode_names`` lets names start with and contain any accented letter."""

    first_only: bool = False
    unicode_names: bool = False
    stop_words: frozenset[str] = field(default_factory=L.default_stop_words)


def _project(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns in a projection of their own (see ``detect.with_matches``). What a
    lambda needs from another array comes in zipped: a column that is referenced once,
    inside a lambda, would be inlined there and evaluated for every element."""
    return df.select("*", *[F.expr(sql).alias(name) for name, sql in columns.items()])


def entity_marks(config: EntityConfig, persons: bool, organizations: bool, work: str) -> dict[str, str]:
    """``_x_name``, ``_x_title``, ``_x_org``: the text with the matches of a pattern marked, each
    followed by its groups; null if the text has not what stands in every match."""
    marks = {}
    if persons:
        marks["_x_name"] = S.mark_matches(work, L.PERSON_UNICODE_JAVA if config.unicode_names else L.PERSON_JAVA, 2)
        marked = S.mark_matches(work, L.TITLE_UNICODE_JAVA if config.unicode_names else L.TITLE_JAVA, 1)
        marks["_x_title"] = f"CASE WHEN {work} RLIKE {S.quote(L.TITLE_GATE)} THEN {marked} END"
    if organizations:
        marks["_x_org"] = f"CASE WHEN {work} RLIKE {S.quote(L.ORG_GATE)} THEN {S.mark_matches(work, L.ORG_JAVA, 1)} END"
    return marks


def _located(p: str, seq: int, category: str, n_groups: int, keep: str, found: str = "x") -> str:
    """Of the pieces ``p`` (gap, match, its groups, gap, ...) the spans ``x`` that meet ``keep``,
    as ``found``; ``groups`` are the groups of all matches, ``i`` is the number of a match."""
    step = 2 + n_groups
    spans = S.let("q", f"filter({p}, (y, j) -> j % {step} < 2)", S.locate("q", str(seq), S.quote(category), "'ner'"))
    kept = f"filter(transform({spans}, (x, i) -> CASE WHEN {keep} THEN {found} END), x -> x IS NOT NULL)"
    return f"""CASE WHEN {p} IS NULL THEN {S.NO_SPANS}
      ELSE {S.let("groups", f"filter({p}, (y, j) -> j % {step} >= 2)", kept)} END"""


def with_located_entities(df: DataFrame, keep: Sequence[str], config: EntityConfig, persons: bool,
                          organizations: bool, out: str) -> DataFrame:
    """The columns ``keep``, and in ``out`` the spans of what ``entity_marks`` has marked."""
    stop = lambda word: L.is_stop_word(word, config.stop_words)
    once = S.first_of_each_key if config.first_only else lambda spans: spans
    parts, names = [], [f"_{kind}" for kind, on in (("name", persons), ("title", persons), ("org", organizations)) if on]
    df = df.select(*keep, *[F.expr(S.split_marked(f"_x{n}", "_markable")).alias(f"_p{n}") for n in names])
    if persons:
        titled = S.let("name", "get(groups, i)", """named_struct(
            'start_idx', x.start_idx + instr(x.value, name) - 1, 'seq', x.seq,
            'end_idx', x.start_idx + instr(x.value, name) - 1 + length(name),
            'category', x.category, 'source', x.source, 'value', name)""")
        df = _project(
            df,
            _names=_located("_p_name", PERSON_SEQ, "PERSON", 2, f"""NOT ({stop("get(groups, 2 * i)")}
              OR {stop("get(groups, 2 * i + 1)")} OR {L.is_stop_phrase("x.value")})"""),
            _titled=_located("_p_title", TITLE_SEQ, "PERSON", 1, "true", titled),
        )
        new = f"""filter(_titled, x -> NOT (array_contains(seen, lower(x.value))
            OR forall(split(x.value, {S.quote(L.BLANKS_JAVA)}, -1), w -> {stop("w")})
            OR {L.is_stop_phrase("x.value")}))"""
        df = _project(df, _titled_new=f"""CASE WHEN size(_titled) = 0 THEN _titled
          ELSE {S.let("seen", "transform(_names, n -> lower(n.value))", new)} END""")
        parts += [once("_names"), once("_titled_new")]
    if organizations:
        df = _project(df, _orgs=_located("_p_org", ORG_SEQ, "COMPANY", 1, "get(groups, i) != ''"))
        parts.append(once("_orgs"))
    return df.select(*keep, F.expr(S.concat_spans(parts)).alias(out))


def with_entity_spans(df: DataFrame, text_col: str, config: EntityConfig, persons: bool,
                      organizations: bool, out: str) -> DataFrame:
    keep = df.columns
    work = _project(df, _markable=S.markable(text_col))
    marks = _project(work, **entity_marks(config, persons, organizations, "_markable"), _apart=S.APART)
    found = with_located_entities(marks, keep, config, persons, organizations, "_found_entities")
    together = found.select(*keep, F.expr("sort_array(_found_entities)").alias("_together"))
    return together.select(*keep, F.expr(S.own_values(text_col, "_together")).alias(out))


def detect_persons(df: DataFrame, text_col: str = "text",
                   config: EntityConfig = EntityConfig(), out: str = "spans") -> DataFrame:
    """Two-word names with an optional particle, then names after a title."""
    return with_entity_spans(df, text_col, config, True, False, out)


def detect_orgs(df: DataFrame, text_col: str = "text",
                config: EntityConfig = EntityConfig(), out: str = "spans") -> DataFrame:
    """Capitalised words that end in a company suffix; no stop list applies."""
    return with_entity_spans(df, text_col, config, False, True, out)


def detect_entities(df: DataFrame, text_col: str = "text", config: EntityConfig = EntityConfig(),
                    persons: bool = True, organizations: bool = True,
                    out: str = "spans") -> DataFrame:
    """Persons, then organisations, ordered by start."""
    return with_entity_spans(df, text_col, config, persons, organizations, out)
