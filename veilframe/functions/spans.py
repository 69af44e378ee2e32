"""Expressions over spans.

A span is ``STRUCT<start_idx INT, seq INT, end_idx INT, category, source, value>``:
0-based, end-exclusive code points. ``start_idx, seq`` lead so that the natural
struct order is the order in which overlaps are decided. Everything here stays
inside one row: no shuffle, no UDF.

The functions return Spark SQL text and take column names or SQL text. Detection has
dozens of higher-order expressions, and one parsed string each is far cheaper to
build than nested ``Column`` calls.
"""

from __future__ import annotations

from collections.abc import Sequence

SPAN_STRUCT = (
    "struct<start_idx:int,seq:int,end_idx:int,category:string,source:string,value:string>"
)
SPAN_TYPE = f"array<{SPAN_STRUCT}>"
NO_SPANS = f"cast(array() as {SPAN_TYPE})"
NO_STRINGS = "cast(array() as array<string>)"

#: U+FFFF, not a character: marks both ends of every match
MARK = "\uffff"
#: U+FFFE, likewise: stands in for a U+FFFF of the text itself
STAND_IN = "\ufffe"


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def extract_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, {group})"


def markable(text: str) -> str:
    """The text without the mark. Code points and matches stay where they are."""
    return f"CASE WHEN contains({text}, '{MARK}') THEN translate({text}, '{MARK}', '{STAND_IN}') ELSE {text} END"


def mark_matches(text: str, pattern: str, groups: int = 0) -> str:
    """The text with every match of a Java pattern between marks, its first ``groups`` groups
    behind it and a mark behind each: one pass that both tests and locates, under codegen and
    with the pattern compiled once."""
    marked = MARK + "".join(f"${k}{MARK}" for k in range(groups + 1))
    return f"regexp_replace({text}, {quote(pattern)}, '{marked}')"


def holds_any(text: str, words: Sequence[str]) -> str:
    """Whether one of the words, taken literally, stands anywhere in the text."""
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def split_marked(marked: str, text: str) -> str:
    """Gap, match, gap, ... or null without a match."""
    return f"CASE WHEN {marked} != {text} THEN split({marked}, '{MARK}', -1) END"


#: up to so many matches are located, and spans merged, without slices
FEW = 8

#: elements of a slice: lists grow by folding inside one slice only, so the work on a
#: long list stays in proportion to its length
SLICE = 128


def let(name: str, value: str, body: str) -> str:
    """``body`` with a lambda variable bound to ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def slices(array: str, j: str) -> str:
    """A non-empty array cut into slices; ``j`` is a free variable name."""
    return (f"transform(sequence(0, cast((size({array}) - 1) div {SLICE} as int)), "
            f"{j} -> slice({array}, {j} * {SLICE} + 1, {SLICE}))")


#: A column with a lambda, which keeps its projection out of whole-stage code. There dozens
#: of patterns would be one method, too long (8,000 bytes) for the JVM to compile, and be
#: interpreted; apart, each is a method of its own.
APART = "exists(array(0), x -> x > 0)"


def locate(pieces: str, seq: str, category: str, source: str) -> str:
    """Spans from the pieces of a marked text: every second piece is a match, and the
    length of what stands before it is its offset. Slices are located alone and moved by
    the length of the slices before them; the others are SQL text of what a span says."""
    def span(at: str, value: str) -> str:
        return f"""named_struct('start_idx', {at}, 'seq', {seq}, 'end_idx', {at} + length({value}),
            'category', {category}, 'source', {source}, 'value', {value})"""

    before = "aggregate(slice(lengths, 1, i), base, (m, y) -> m + y)"
    each = let("base", "aggregate(slice(sums, 1, k), 0, (m, y) -> m + y)", let(
        "lengths", "transform(q, y -> length(y))", f"""filter(transform(q, (x, i) ->
          CASE WHEN i % 2 = 1 THEN {let("at", before, span("at", "x"))} END), s -> s IS NOT NULL)"""))
    sums = "transform(cut, q -> aggregate(q, 0, (m, y) -> m + length(y)))"
    found = let("cut", slices(pieces, "j"), let("sums", sums, f"flatten(transform(cut, (q, k) -> {each}))"))
    single = f"array({span(f'length(get({pieces}, 0))', f'get({pieces}, 1)')})"
    few_before = f"aggregate(slice({pieces}, 1, i), 0, (m, y) -> m + length(y))"
    few = f"""filter(transform({pieces}, (x, i) ->
        CASE WHEN i % 2 = 1 THEN {let("at", few_before, span("at", "x"))} END), s -> s IS NOT NULL)"""
    return f"""CASE WHEN {pieces} IS NULL THEN {NO_SPANS} WHEN size({pieces}) = 3 THEN {single}
      WHEN size({pieces}) <= {2 * FEW + 1} THEN {few} ELSE {found} END"""


def find_all(text: str, pattern: str) -> str:
    """Every non-overlapping match of a Java pattern, as spans with an empty category."""
    return f"""get(transform(array({markable(text)}), t ->
      get(transform(array({mark_matches('t', pattern)}), m ->
        get(transform(array({split_marked('m', 't')}), p -> {locate('p', '0', "''", "''")}), 0)), 0)), 0)"""


def own_values(text: str, spans: str) -> str:
    """Values as they stand in a text that held the mark itself."""
    return f"""CASE WHEN contains({text}, '{MARK}') THEN transform({spans}, x -> named_struct(
        'start_idx', x.start_idx, 'seq', x.seq, 'end_idx', x.end_idx, 'category', x.category,
        'source', x.source,
        'value', substring({text}, x.start_idx + 1, x.end_idx - x.start_idx)))
      ELSE {spans} END"""


def drop_overlapping(spans: str, rivals: list[str]) -> str:
    """The spans that no span of the rival columns touches."""
    rival = rivals[0] if len(rivals) == 1 else f"concat({', '.join(rivals)})"
    return f"""
      CASE WHEN size({rival}) = 0 THEN {spans} ELSE filter({spans}, x -> NOT exists({rival},
        o -> x.start_idx < o.end_idx AND o.start_idx < x.end_idx)) END"""


def concat_spans(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if parts else NO_SPANS


def merge_spans(spans: str) -> str:
    """Keep disjoint spans of a column. In order of start (ties: lower ``seq``), a
    span that overlaps the last kept one replaces it if strictly longer and is
    dropped otherwise. The decision is local: what a replaced span had removed stays
    removed. Spans that start where all before them have ended begin a cluster, and
    clusters are decided alone."""
    starts = f"""flatten(transform(cut, (q, k) -> aggregate(q,
        named_struct('top', coalesce(array_max(slice(tops, 1, k)), -1), 'i', k * {SLICE},
                     'at', cast(array() as array<int>)),
        (acc, x) -> named_struct(
          'top', greatest(acc.top, x.end_idx), 'i', acc.i + 1,
          'at', CASE WHEN acc.top <= x.start_idx THEN concat(acc.at, array(acc.i)) ELSE acc.at END),
        acc -> acc.at)))"""
    fold = f"""aggregate(c,
        named_struct('done', {NO_SPANS}, 'kept', cast(null as {SPAN_STRUCT})),
        (acc, x) -> CASE
          WHEN acc.kept IS NULL THEN named_struct('done', acc.done, 'kept', x)
          WHEN acc.kept.end_idx <= x.start_idx
            THEN named_struct('done', concat(acc.done, array(acc.kept)), 'kept', x)
          WHEN x.end_idx - x.start_idx > acc.kept.end_idx - acc.kept.start_idx
            THEN named_struct('done', acc.done, 'kept', x)
          ELSE acc END,
        acc -> concat(acc.done, array(acc.kept)))"""
    length = "(coalesce(get(starts, n + 1), size(ordered)) - a)"
    decided = f"""CASE WHEN {length} = 1 THEN array(get(ordered, a))
      ELSE {let("c", f"slice(ordered, a + 1, {length})", fold)} END"""
    # the end of the last span, or null as soon as one begins before the end of the one before it
    apart = "aggregate(ordered, 0, (top, x) -> CASE WHEN x.start_idx >= top THEN x.end_idx END) IS NOT NULL"
    tops = "transform(cut, q -> array_max(transform(q, y -> y.end_idx)))"
    clusters = let("cut", slices("ordered", "j"), let("tops", tops, let(
        "starts", starts, f"flatten(transform(starts, (a, n) -> {decided}))")))
    merged = let("ordered", f"sort_array({spans})", f"CASE WHEN {apart} THEN ordered ELSE {clusters} END")
    return f"CASE WHEN size({spans}) > 1 THEN {merged} ELSE {spans} END"


def splice(text: str, pieces: str) -> str:
    """Replace the disjoint, ordered ``pieces`` (a column of ``start_idx, end_idx,
    placeholder``) in a text column. A slice of pieces cuts its own part of the text,
    so that no piece looks for its place from the beginning of a long text."""
    part = f"substring({text}, base + 1, get(q, size(q) - 1).end_idx - base)"
    filled = """array_join(transform(q, (x, i) -> concat(
          substring(part, coalesce(get(q, i - 1).end_idx, base) - base + 1,
                    x.start_idx - coalesce(get(q, i - 1).end_idx, base)),
          x.placeholder)), '')"""
    each = let("base", f"coalesce(get({pieces}, k * {SLICE} - 1).end_idx, 0)", let("part", part, filled))
    return f"""
      CASE WHEN size({pieces}) > 0 THEN concat(
        array_join(transform({slices(pieces, "j")}, (q, k) -> {each}), ''),
        substring({text}, get({pieces}, size({pieces}) - 1).end_idx + 1, length({text}))
      ) ELSE {text} END"""


def by_key(spans: str) -> str:
    """Of every span its key (lower-cased value) ``k`` and place ``i``, in order of both:
    the spans of one key are neighbours, the first one in front."""
    return f"sort_array(transform({spans}, (x, i) -> named_struct('k', lower(x.value), 'i', i)))"


def key_runs(sorted_keys: str) -> str:
    """Of ``by_key`` the first place ``i`` of each key and where its run begins, ``p``."""
    return f"""filter(transform({sorted_keys}, (y, p) ->
      CASE WHEN p = 0 OR get({sorted_keys}, p - 1).k != y.k
        THEN named_struct('i', y.i, 'p', p) END), r -> r IS NOT NULL)"""


def first_of_each_key(spans: str) -> str:
    """The spans whose key appears for the first time, in their order."""
    return let("keyed", by_key(spans), let(
        "places", f"sort_array(transform({key_runs('keyed')}, r -> r.i))",
        f"transform(places, i -> get({spans}, i))"))
