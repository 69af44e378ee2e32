"""DuckDB statements of the detection and masking queries.

They are written from the contract, not from the Spark expressions: original
patterns under RE2 (no rewritten boundaries, no gates), range anti-joins instead of
array filters, window functions instead of folds where possible.
"""

from __future__ import annotations

from veilframe.functions.lexicon import (
    ORG_PATTERN, PERSON_PATTERN, STOP_PHRASES, TITLE_PATTERN, default_stop_words,
)
from veilframe.functions.patterns import (
    _ID_QUALIFIER, FAMILIES, SEQ, Family, MaskConfig, ecma_pattern, to_re2,
)
from veilframe.operators.detect import RULE_SEQ
from veilframe.operators.entities import ORG_SEQ, PERSON_SEQ, TITLE_SEQ

#: families with a look-ahead, which RE2 lacks, by the statement that finds them
_QUALIFIERS = 6


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(family: Family) -> str:
    pattern = ecma_pattern(family)
    if family.name == "price":
        # (?!\w) is \B after a symbol and \b after a letter or digit
        pattern = pattern.replace(
            r"(?:€|\$|£|EUR|USD|CAD|GBP|CHF)(?!\w)",
            r"(?:(?:€|\$|£)\B|(?:EUR|USD|CAD|GBP|CHF)\b)",
        ).replace(r"(?!\w)", r"\b")
    return to_re2(pattern, family.ignore_case)


def matches(src: str, rx: str, columns: str, groups: dict[str, int] | None = None) -> str:
    """Rows ``scope, item, <columns>, s, e, v`` of one pattern over ``src``."""
    groups = groups or {}
    lists = "".join(f", regexp_extract_all(text, {lit(rx)}, {g}) AS {n}s" for n, g in groups.items())
    picks = "".join(f", {n}s[i] AS {n}" for n in groups)
    carried = "".join(f", {n}s" for n in groups)
    return f"""
  SELECT scope, item, {columns}, s, s + length(m[i]) AS e, m[i] AS v{picks} FROM (
    SELECT scope, item, i, m{carried},
      list_sum(list_transform(g[1:i], lambda x: length(x)))::INTEGER
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::INTEGER AS s
    FROM (
      SELECT scope, item, m, g{carried}, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT scope, item, regexp_extract_all(text, {lit(rx)}) AS m,
          regexp_split_to_array(text, {lit(rx)}) AS g{lists}
        FROM {src} WHERE regexp_matches(text, {lit(rx)}))))"""


def _apart(found: str, columns: str) -> str:
    """Of candidates ``scope, item, s, e, v`` the leftmost ones that do not overlap."""
    return f"""
  SELECT scope, item, {columns}, k.s AS s, k.e AS e, k.v AS v FROM (
    SELECT scope, item, unnest(kept) AS k FROM (
      SELECT scope, item, list_reduce(list([struct_pack(s := s, e := e, v := v)] ORDER BY s),
        lambda acc, x: CASE WHEN acc[-1].e <= x[1].s THEN list_concat(acc, x) ELSE acc END) AS kept
      FROM ({found}) GROUP BY scope, item))"""


def _numbered_ids(src: str, keyword: str, most: int, columns: str) -> str:
    """A keyword, qualifiers, and an id with a digit in its run. Every keyword is a start;
    with as many qualifiers as possible first, the id after them is taken if its run of
    letters, digits and hyphens has a digit."""
    blank, qualifier = to_re2(r"\s"), to_re2(_ID_QUALIFIER)[:-1]  # without its repetition
    tries = []
    for n in range(_QUALIFIERS, -1, -1):
        head = to_re2(keyword) + f"{qualifier}{{{n}}}{blank}*:?{blank}*"
        whole = lit(f"^(?i)({head})[A-Z0-9](?:[A-Z0-9-]{{4,{most}}}[A-Z0-9])?\\b")
        tries.append(f"""CASE WHEN regexp_matches(substring(tail, length(regexp_extract(tail, {whole}, 1)) + 1),
          '^(?i)[A-Z0-9-]*[0-9]') THEN nullif(regexp_extract(tail, {whole}, 0), '') END""")
    starts = matches(src, "(?i)\\b" + to_re2(keyword), "1 AS one")
    found = f"""SELECT scope, item, s, (s + length(v))::INTEGER AS e, v FROM (
      SELECT scope, item, s, coalesce({", ".join(tries)}) AS v FROM (
        SELECT scope, item, s, substring(text, s + 1) AS tail FROM ({starts}) JOIN {src} USING (scope, item)))
      WHERE v IS NOT NULL"""
    return _apart(found, columns)


def _codes(src: str, low: int, columns: str) -> str:
    """Codes inside runs of letters, digits, underscores and hyphens: every word of a run is a
    start; joined pieces come before one long word."""
    runs = matches(src, "[A-Za-z0-9_-]+", "1 AS one")
    joined = lit(r"^(?i)[A-Z][A-Z0-9]*[-_][A-Z0-9]+(?:[-_][A-Z0-9]+)*\b")
    found = f"""SELECT scope, item, (s + o)::INTEGER AS s, (s + o + length(v))::INTEGER AS e, v FROM (
      SELECT scope, item, s, o, coalesce(
        CASE WHEN length(rest) >= 6 AND regexp_matches(rest, '[0-9]')
          THEN nullif(regexp_extract(rest, {joined}), '') END,
        CASE WHEN regexp_matches(rest, '^[A-Za-z]*[0-9]') AND regexp_matches(rest, '^[0-9]*[A-Za-z]')
          THEN nullif(regexp_extract(rest, '^[A-Za-z0-9]{{{low},}}\\b'), '') END) AS v
      FROM (SELECT scope, item, s, o, substring(run, o + 1) AS rest FROM (
        SELECT scope, item, s, v AS run, unnest(range(0, length(v))) AS o FROM ({runs})
        WHERE length(v) >= 6 AND regexp_matches(v, '[0-9]'))
        WHERE (o = 0 OR run[o] = '-') AND regexp_matches(run[o + 1], '[A-Za-z0-9]')))
      WHERE v IS NOT NULL"""
    return _apart(found, columns)


def family_matches(family: Family, src: str, config: MaskConfig) -> str:
    columns = f"{lit(family.name)} AS fam, {SEQ[family.name]} AS seq, {lit(family.category)} AS category"
    if family.name == "passport":
        return _numbered_ids(src, "(?:passport|passeport)", 18, columns)
    if family.name == "driver_licence":
        return _numbered_ids(src, r"(?:permis|driver'?s?\s+licen[cs]e|DL)", 20, columns)
    if family.name == "code":
        return _codes(src, config.id_min_length, columns)
    return matches(src, re2(family), columns)


def raw_cte(config: MaskConfig, src: str = "src") -> str:
    parts = [family_matches(f, src, config) for f in config.families()]
    return "raw AS MATERIALIZED (" + "\n  UNION ALL".join(parts) + ")"


def pattern_cte(config: MaskConfig) -> str:
    rivals = ", ".join(
        f"({lit(f.name)}, {lit(r)})" for f in FAMILIES for r in f.cancelled_by
    )
    return f"""{raw_cte(config)},
rivals(fam, rival) AS (VALUES {rivals}),
pattern_spans AS (
  SELECT scope, item, seq, s, e, category, 'regex' AS source, v FROM raw r
  WHERE NOT (fam = 'code' AND EXISTS (SELECT 1 FROM raw o WHERE o.fam = 'email'
      AND o.scope = r.scope AND o.item = r.item AND o.v = r.v)) AND NOT EXISTS (
    SELECT 1 FROM rivals JOIN raw o ON o.fam = rivals.rival
    WHERE rivals.fam = r.fam AND o.scope = r.scope AND o.item = r.item
      AND r.s < o.e AND o.s < r.e))"""


_STOP = "lower({0}) IN (" + ", ".join(lit(w) for w in sorted(default_stop_words())) + ")"
_PHRASE = (
    r"trim(regexp_replace(regexp_replace(lower({0}), '[.,;:!?]+$', ''), '\s+', ' ', 'g')) IN ("
    + ", ".join(lit(p) for p in STOP_PHRASES) + ")"
)


def entity_cte() -> str:
    name_rx, title_rx, org_rx = to_re2(PERSON_PATTERN), to_re2(TITLE_PATTERN), to_re2(ORG_PATTERN)
    blank = to_re2(r"\s+")
    return f"""names AS MATERIALIZED (
  SELECT * FROM ({matches("src", name_rx, "1 AS one", {"g1": 1, "g2": 2})})
  WHERE NOT ({_STOP.format("g1")} OR {_STOP.format("g2")} OR {_PHRASE.format("v")})),
titled AS (
  SELECT scope, item, s + instr(v, g1) - 1 AS s, s + instr(v, g1) - 1 + length(g1) AS e, g1 AS v
  FROM ({matches("src", title_rx, "1 AS one", {"g1": 1})})),
entity_spans AS (
  SELECT scope, item, {PERSON_SEQ} AS seq, s, e, 'PERSON' AS category, 'ner' AS source, v FROM names
  UNION ALL
  SELECT scope, item, {TITLE_SEQ}, s, e, 'PERSON', 'ner', v FROM titled t
  WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.scope = t.scope AND n.item = t.item
                    AND lower(n.v) = lower(t.v))
    AND NOT {_PHRASE.format("t.v")}
    AND EXISTS (SELECT 1 FROM (SELECT unnest(regexp_split_to_array(t.v, {lit(blank)})) AS w)
                WHERE NOT {_STOP.format("w")})
  UNION ALL
  SELECT scope, item, {ORG_SEQ}, s, e, 'COMPANY', 'ner', v FROM ({matches("src", org_rx, "1 AS one")}))"""


def term_cte(rules) -> str:
    parts = []
    for i, rule in enumerate(rules):
        escaped = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in rule.term)
        rx = ("" if rule.case_sensitive else "(?i)") + rf"\b{escaped}\b"
        parts.append(matches("src", rx, f"{RULE_SEQ + i} AS seq, {lit(rule.category)} AS category"))
    return f"""term_spans AS (
  SELECT scope, item, seq, s, e, category, 'manual' AS source, v FROM ({" UNION ALL ".join(parts)}))"""


def merged_cte(parts: list[str], out: str = "merged") -> str:
    together = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return f"""all_spans AS ({together}),
{out} AS (
  SELECT scope, item, unnest(kept, recursive := true) FROM (
    SELECT scope, item, list_reduce(
      list([struct_pack(s := s, seq := seq, e := e, category := category, source := source, v := v)]
           ORDER BY s, seq),
      lambda acc, x: CASE
        WHEN acc[-1].e <= x[1].s THEN list_concat(acc, x)
        WHEN x[1].e - x[1].s > acc[-1].e - acc[-1].s THEN list_concat(acc[:-2], x)
        ELSE acc END) AS kept
    FROM all_spans GROUP BY scope, item))"""


def mapping_cte(style: tuple[str, str] = ("[", "]")) -> str:
    opening, closing = style
    return f"""firsts AS (
  SELECT *, lower(v) AS key, count(*) OVER (PARTITION BY scope, lower(v)) AS n,
    row_number() OVER (PARTITION BY scope, lower(v) ORDER BY item, s) AS occurrence
  FROM merged),
mapping AS (
  SELECT scope, key, v AS original, category, source, n, item, s,
    '{opening}' || category || '_'
      || row_number() OVER (PARTITION BY scope, category ORDER BY item, s) || '{closing}' AS placeholder
  FROM firsts WHERE occurrence = 1)"""


def masked_cte() -> str:
    return """pieces AS (
  SELECT f.scope, f.item, f.s, f.e, m.placeholder,
    lag(f.e, 1, 0) OVER (PARTITION BY f.scope, f.item ORDER BY f.s) AS after
  FROM firsts f JOIN mapping m ON m.scope = f.scope AND m.key = f.key),
joined AS (
  SELECT scope, item, max(e) AS tail,
    string_agg(substring(text, after + 1, s - after) || placeholder, '' ORDER BY s) AS head
  FROM pieces JOIN src USING (scope, item) GROUP BY scope, item),
masked AS (
  SELECT src.scope, src.item, coalesce(head || substring(text, tail + 1), text) AS masked
  FROM src LEFT JOIN joined USING (scope, item))"""


def statement(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def src_cte(select: str) -> str:
    """``scope, item, text``"""
    return f"src AS MATERIALIZED ({select})"
