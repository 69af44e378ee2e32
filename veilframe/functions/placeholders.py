"""Expressions for placeholders: numbering inside one row, and putting originals back."""

from __future__ import annotations

from veilframe.functions.spans import let, quote

#: format of a placeholder and the pattern that finds one, by style
STYLES = {
    "brackets": ("[%s_%d]", r"\[[A-Z_]+_[0-9]+\]"),
    "curly": ("{%s_%d}", r"\{[A-Z_]+_[0-9]+\}"),
}


def format_placeholder(category: str, index: str, style: str = "brackets") -> str:
    opening, closing = STYLES[style][0][0], STYLES[style][0][-1]
    return f"concat('{opening}', {category}, '_', {index}, '{closing}')"


def token_pattern(style: str = "brackets") -> str:
    return STYLES[style][1]


def entries(spans: str, sorted_keys: str, runs: str) -> str:
    """One element per different key, in order of appearance: its first span, where its
    spans are in ``by_key`` (from ``p``, ``n`` of them)."""
    return f"""transform(sort_array(transform({runs}, (r, q) -> named_struct(
        'i', r.i, 'p', r.p, 'n', coalesce(get({runs}, q + 1).p, size({sorted_keys})) - r.p))),
      e -> named_struct('x', get({spans}, e.i), 'p', e.p, 'n', e.n))"""


def numbered(entries_: str, style: str) -> str:
    """The entries with their placeholders: each category counts up on its own. Sorted by
    category and place, a category is a run, and the place in its run is the number."""
    entry = f"""named_struct(
          'first_idx', y.e.x.start_idx, 'key', lower(y.e.x.value), 'original', y.e.x.value,
          'placeholder', {format_placeholder('y.e.x.category', 'q + 1', style)},
          'category', y.e.x.category, 'source', y.e.x.source, 'count', y.e.n, 'p', y.e.p)"""
    ordered = (f"sort_array(transform({entries_}, e -> "
               "named_struct('c', e.x.category, 'f', e.x.start_idx, 'e', e)))")
    runs = """filter(transform(ordered, (y, p) ->
        CASE WHEN p = 0 OR get(ordered, p - 1).c != y.c THEN p END), p -> p IS NOT NULL)"""
    each = f"""transform(slice(ordered, r + 1, coalesce(get(runs, k + 1), size(ordered)) - r),
        (y, q) -> {entry})"""
    return let("ordered", ordered, let(
        "runs", runs, f"sort_array(flatten(transform(runs, (r, k) -> {each})))"))


def mapping_of(numbered_: str) -> str:
    fields = ("first_idx", "key", "original", "placeholder", "category", "source", "count")
    listed = ", ".join(f"'{f}', e.{f}" for f in fields)
    return f"transform({numbered_}, e -> named_struct({listed}))"


def pieces_of(numbered_: str, sorted_keys: str, spans: str) -> str:
    """What to put where: the spans of every entry, back in their order."""
    return f"""transform(sort_array(flatten(transform({numbered_}, e ->
        transform(slice({sorted_keys}, e.p + 1, e.count), y ->
          named_struct('i', y.i, 'placeholder', e.placeholder))))),
      z -> named_struct('start_idx', get({spans}, z.i).start_idx,
                        'end_idx', get({spans}, z.i).end_idx, 'placeholder', z.placeholder))"""


def tokens_of_few(spans: str, first: str, style: str) -> str:
    """For a few spans, compared pairwise: of each the placeholder if it is the first of its key, or null.
    ``first`` has of each span the place of the first one with its key."""
    number = f"size(filter(slice({spans}, 1, i), (y, j) -> get({first}, j) = j AND y.category = x.category)) + 1"
    return f"""transform({spans}, (x, i) -> CASE WHEN get({first}, i) = i
        THEN {format_placeholder('x.category', number, style)} END)"""


def first_places(keys: str) -> str:
    return f"transform({keys}, k -> cast(array_position({keys}, k) as int) - 1)"


def mapping_of_few(spans: str, keys: str, tokens: str) -> str:
    return f"""filter(transform({spans}, (x, i) -> CASE WHEN get({tokens}, i) IS NOT NULL THEN named_struct(
        'first_idx', x.start_idx, 'key', get({keys}, i), 'original', x.value, 'placeholder', get({tokens}, i),
        'category', x.category, 'source', x.source, 'count', size(filter({keys}, k -> k = get({keys}, i)))) END),
      m -> m IS NOT NULL)"""


def pieces_of_few(spans: str, first: str, tokens: str) -> str:
    return f"""transform({spans}, (x, i) -> named_struct('start_idx', x.start_idx, 'end_idx', x.end_idx,
        'placeholder', get({tokens}, get({first}, i))))"""


def restore_tokens(text: str, lookup: str, style: str = "brackets") -> str:
    """Replace every known token once, from a ``placeholder -> original`` map column.
    What was put in is never looked at again and is taken literally."""
    rx = quote(token_pattern(style))
    return f"""CASE WHEN size({lookup}) = 0 THEN {text} ELSE array_join(zip_with(
      split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0),
      (gap, token) -> concat(gap, coalesce({lookup}[token], token, ''))), '') END"""
