"""Registered masking and restoring queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions.patterns import MaskConfig
from veilframe.operators import detect as D
from veilframe.operators import masking as M
from veilframe.plans import oracle as O
from veilframe.plans.detection import DEFAULT, RULES, _DOCS, _NOTES, documents
from veilframe.sources.session import materialise
from veilframe.sources.tables import order_notes, order_notes_sql, text_table

CURLY = MaskConfig(placeholder_style="curly")

_BY_CUSTOMER = O.src_cte(
    f"SELECT custkey AS scope, note_id AS item, text FROM ({order_notes_sql()})")
_FEW_SCOPES = O.src_cte(
    f"SELECT custkey % 3 AS scope, note_id AS item, text FROM ({order_notes_sql()})")
_CONVERSATIONS = O.src_cte("SELECT conv_id AS scope, turn AS item, text FROM conversations")
_MAPPING = "key, original, placeholder, category, source, n AS count"


def _ctes(src: str, rules=(), style=("[", "]")) -> list[str]:
    parts = ["pattern_spans", "entity_spans"] + (["term_spans"] if rules else [])
    return [
        src, O.pattern_cte(DEFAULT), O.entity_cte(), *([O.term_cte(rules)] if rules else []),
        O.merged_cte(parts), O.mapping_cte(style), O.masked_cte(),
    ]


def _masked_sql(src: str, select: str, rules=(), style=("[", "]")) -> str:
    return O.statement(_ctes(src, rules, style), select)


def anonymize_documents(spark, sf_dir):
    return M.anonymize(documents(spark, sf_dir), config=DEFAULT).select(
        "doc_id", "masked", F.size("mapping").alias("n_entries"), "collision")


_DOCUMENTS_SQL = _masked_sql(_DOCS, r"""
SELECT scope AS doc_id, masked, coalesce(n_entries, 0)::INTEGER AS n_entries,
  regexp_matches(text, '\[[A-Z_]+_[0-9]+\]') AS collision
FROM masked JOIN src USING (scope, item)
LEFT JOIN (SELECT scope, count(*) AS n_entries FROM mapping GROUP BY scope) USING (scope)""")


def anonymize_all_families(spark, sf_dir):
    """The default configuration, as a caller gets it who passes none."""
    return M.anonymize(documents(spark, sf_dir)).select("doc_id", "masked")


def anonymize_notes_with_rules(spark, sf_dir):
    return M.anonymize(order_notes(spark, sf_dir), config=DEFAULT, rules=RULES).select(
        "note_id", "masked")


def mapping_rows_notes(spark, sf_dir):
    """The mapping of each note, in curly style."""
    found = M.anonymize(order_notes(spark, sf_dir), config=CURLY)
    return found.select("note_id", F.explode_outer("mapping").alias("m")).where(
        "m IS NOT NULL").select(
        "note_id", "m.key", "m.original", "m.placeholder", "m.category", "m.source", "m.count")


def restore_notes(spark, sf_dir):
    """Mask and restore in the same row; repeats come back in their first spelling."""
    masked = M.anonymize(order_notes(spark, sf_dir), config=DEFAULT)
    return M.restore(masked).select("note_id", "restored")


_RESTORED = """restored_pieces AS (
  SELECT f.scope, f.item, f.s, f.e, m.original,
    lag(f.e, 1, 0) OVER (PARTITION BY f.scope, f.item ORDER BY f.s) AS after
  FROM firsts f JOIN mapping m ON m.scope = f.scope AND m.key = f.key),
restored_head AS (
  SELECT scope, item, max(e) AS tail,
    string_agg(substring(text, after + 1, s - after) || original, '' ORDER BY s) AS head
  FROM restored_pieces JOIN src USING (scope, item) GROUP BY scope, item),
restored AS (
  SELECT src.scope, src.item, coalesce(head || substring(text, tail + 1), text) AS restored
  FROM src LEFT JOIN restored_head USING (scope, item))"""


def _notes_by_customer(spark, sf_dir):
    return order_notes(spark, sf_dir)


def build_mapping_by_customer(spark, sf_dir):
    detected = D.detect_sensitive(_notes_by_customer(spark, sf_dir), config=DEFAULT)
    spans = materialise(D.span_rows(detected, ["custkey", "note_id"]), "spans")
    return M.build_mapping(spans, "custkey", "note_id").drop("first_item", "first_idx")


def build_mapping_few_scopes(spark, sf_dir):
    """Three scopes hold everything, numbered in many ranges."""
    notes = order_notes(spark, sf_dir).withColumn("scope", F.col("custkey") % 3)
    spans = materialise(
        D.span_rows(D.detect_sensitive(notes, config=DEFAULT), ["scope", "note_id"]), "spans")
    return M.build_mapping(spans, "scope", "note_id", parts=64).drop(
        "first_item", "first_idx")


def anonymize_many_by_customer(spark, sf_dir):
    masked = M.anonymize_many(
        _notes_by_customer(spark, sf_dir), "custkey", "note_id", config=DEFAULT)
    return masked.texts.select("custkey", "note_id", "masked")


#: conversations and places that are null or shared by several notes
ODD_SCOPE = "CASE WHEN custkey % 7 <> 0 THEN custkey % 50 END"
ODD_ITEM = "CASE WHEN note_id % 11 <> 0 THEN note_id % 40 END"
_ODD_KEYS = O.src_cte(f"""SELECT *, row_number() OVER (
    PARTITION BY scope ORDER BY slot NULLS FIRST, md5(text)) AS item
  FROM (SELECT coalesce({ODD_SCOPE}, -1) AS scope, {ODD_ITEM} AS slot, text FROM ({order_notes_sql()}))""")


def _odd_notes(spark, sf_dir):
    return order_notes(spark, sf_dir).selectExpr(f"{ODD_SCOPE} AS scope", f"{ODD_ITEM} AS slot", "text")


def anonymize_many_odd_keys(spark, sf_dir):
    """Null conversations, null and tied places: every text is masked at its own spans."""
    return M.anonymize_many(_odd_notes(spark, sf_dir), "scope", "slot", config=DEFAULT).texts.select(
        "scope", "slot", "masked")


def restore_odd_keys(spark, sf_dir):
    masked = M.anonymize_many(_odd_notes(spark, sf_dir), "scope", "slot", config=DEFAULT)
    sent = masked.texts.select("scope", "slot", "masked")
    return M.deanonymize(sent, masked.mapping, "scope", ["scope", "slot"], "masked").select(
        "scope", "slot", "restored")


def anonymize_many_conversations(spark, sf_dir):
    turns = text_table(spark, sf_dir, "conversations")
    masked = M.anonymize_many(turns, "conv_id", "turn", config=DEFAULT)
    return masked.texts.select("conv_id", "turn", "role", "masked")


def deanonymize_by_customer(spark, sf_dir):
    masked = M.anonymize_many(
        _notes_by_customer(spark, sf_dir), "custkey", "note_id", config=DEFAULT)
    sent = masked.texts.select("custkey", "note_id", "masked")
    return M.deanonymize(
        sent, masked.mapping, "custkey", ["custkey", "note_id"], "masked",
    ).select("custkey", "note_id", "restored")


def round_trip_conversations(spark, sf_dir):
    turns = text_table(spark, sf_dir, "conversations")
    return M.round_trip(turns, config=DEFAULT)


_ROUND_TRIP_SQL = O.statement(_ctes(_CONVERSATIONS) + [_RESTORED], """
SELECT conv_id, turn, role, masked AS sent, masked AS answer, restored
FROM conversations JOIN masked ON masked.scope = conv_id AND masked.item = turn
JOIN restored ON restored.scope = conv_id AND restored.item = turn""")


def span_rollup_sources(spark, sf_dir):
    found = D.detect_sensitive(documents(spark, sf_dir), config=DEFAULT)
    renamed = found.withColumnRenamed("source", "doc_source")
    return M.span_rollup(D.span_rows(renamed, ["doc_source"]), ["doc_source", "category"])


_ROLLUP_SOURCES_SQL = O.statement([
    _DOCS, O.pattern_cte(DEFAULT), O.entity_cte(),
    O.merged_cte(["pattern_spans", "entity_spans"]),
], """SELECT d.source AS doc_source, category, count(*) AS n_spans,
  count(DISTINCT lower(v)) AS n_values
FROM merged m JOIN documents d ON doc_id = scope GROUP BY ALL""")


QUERIES = {
    "anonymize_documents": (anonymize_documents, _DOCUMENTS_SQL),
    "anonymize_all_families": (anonymize_all_families, _masked_sql(
        _DOCS, "SELECT scope AS doc_id, masked FROM masked")),
    "anonymize_notes_with_rules": (anonymize_notes_with_rules, _masked_sql(
        _NOTES, "SELECT scope AS note_id, masked FROM masked", RULES)),
    "mapping_rows_notes": (mapping_rows_notes, _masked_sql(
        _NOTES, f"SELECT scope AS note_id, key, original, placeholder, category, source, "
        "n::INTEGER AS count FROM mapping", style=("{", "}"))),
    "restore_notes": (restore_notes, O.statement(
        _ctes(_NOTES) + [_RESTORED], "SELECT scope AS note_id, restored FROM restored")),
    "build_mapping_by_customer": (build_mapping_by_customer, _masked_sql(
        _BY_CUSTOMER, f"SELECT scope AS custkey, {_MAPPING} FROM mapping")),
    "build_mapping_few_scopes": (build_mapping_few_scopes, _masked_sql(
        _FEW_SCOPES, f"SELECT scope, {_MAPPING} FROM mapping")),
    "anonymize_many_by_customer": (anonymize_many_by_customer, _masked_sql(
        _BY_CUSTOMER, "SELECT scope AS custkey, item AS note_id, masked FROM masked")),
    "anonymize_many_conversations": (anonymize_many_conversations, _masked_sql(
        _CONVERSATIONS, "SELECT conv_id, turn, role, masked FROM masked JOIN conversations "
        "ON conv_id = scope AND turn = item")),
    "anonymize_many_odd_keys": (anonymize_many_odd_keys, _masked_sql(
        _ODD_KEYS, "SELECT nullif(masked.scope, -1) AS scope, slot, masked FROM masked "
        "JOIN src USING (scope, item)")),
    "restore_odd_keys": (restore_odd_keys, O.statement(
        _ctes(_ODD_KEYS) + [_RESTORED], "SELECT nullif(scope, -1) AS scope, slot, restored "
        "FROM restored JOIN src USING (scope, item)")),
    "deanonymize_by_customer": (deanonymize_by_customer, O.statement(
        _ctes(_BY_CUSTOMER) + [_RESTORED],
        "SELECT scope AS custkey, item AS note_id, restored FROM restored")),
    "round_trip_conversations": (round_trip_conversations, _ROUND_TRIP_SQL),
    "span_rollup_sources": (span_rollup_sources, _ROLLUP_SOURCES_SQL),
}
