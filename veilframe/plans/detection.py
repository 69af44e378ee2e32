"""Registered detection queries with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import lexicon as L
from veilframe.functions.patterns import MaskConfig
from veilframe.operators import detect as D
from veilframe.operators import entities as E
from veilframe.operators.masking import span_rollup
from veilframe.operators.terms import detect_term_table
from veilframe.plans import oracle as O
from veilframe.sources.tables import order_notes, order_notes_sql, table, text_table

#: what a caller gets who says nothing: all 35 families
DEFAULT = MaskConfig()
RULES = (
    D.Rule("Acme Solutions", "CLIENT"),
    D.Rule("contact", "PROJECT"),
    D.Rule("REF", "INTERNAL_CODE", case_sensitive=True),
    D.Rule("the", "CUSTOM", case_sensitive=True),
    D.Rule("n°", "CUSTOM"),
)

_DOCS = O.src_cte("SELECT doc_id AS scope, 0 AS item, text FROM documents")
_NOTES = O.src_cte(f"SELECT note_id AS scope, 0 AS item, text FROM ({order_notes_sql()})")
_COLUMNS = "seq, s AS start_idx, e AS end_idx, category, source, v AS value"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents")


def _rows(df: DataFrame, key: str) -> DataFrame:
    return D.span_rows(df, [key])


def find_all_documents(spark, sf_dir):
    return _rows(D.find_all_matches(documents(spark, sf_dir), config=DEFAULT), "doc_id")


def find_all_notes(spark, sf_dir):
    return _rows(D.find_all_matches(order_notes(spark, sf_dir), config=DEFAULT), "note_id")


def _find_all_sql(src: str, key: str) -> str:
    return O.statement(
        [src, O.raw_cte(DEFAULT)],
        f"SELECT scope AS {key}, seq, s AS start_idx, e AS end_idx, category, 'regex' AS source, "
        "v AS value FROM raw",
    )


def detect_patterns_documents(spark, sf_dir):
    return _rows(D.detect_patterns(documents(spark, sf_dir), config=DEFAULT), "doc_id")


def detect_patterns_notes(spark, sf_dir):
    return _rows(D.detect_patterns(order_notes(spark, sf_dir), config=DEFAULT), "note_id")


def _patterns_sql(src: str, key: str) -> str:
    return O.statement([src, O.pattern_cte(DEFAULT)],
                       f"SELECT scope AS {key}, {_COLUMNS} FROM pattern_spans")


def detect_patterns_all_families(spark, sf_dir):
    """The default configuration, as a caller gets it who passes none."""
    return _rows(D.detect_patterns(order_notes(spark, sf_dir)), "note_id")


def detect_terms_documents(spark, sf_dir):
    return _rows(D.detect_terms(documents(spark, sf_dir), RULES), "doc_id")


def detect_terms_notes(spark, sf_dir):
    return _rows(D.detect_terms(order_notes(spark, sf_dir), RULES), "note_id")


def _terms_sql(src: str, key: str) -> str:
    return O.statement([src, O.term_cte(RULES)],
                       f"SELECT scope AS {key}, {_COLUMNS} FROM term_spans")


def term_table_notes(spark, sf_dir):
    """Every customer name is a term."""
    terms = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("term"), F.lit("CLIENT").alias("category"),
        F.lit(False).alias("case_sensitive"),
    )
    return detect_term_table(order_notes(spark, sf_dir), terms, "note_id")


_TERM_TABLE_SQL = f"""
WITH notes AS ({order_notes_sql()})
SELECT note_id, (strpos(lower(text), lower(c_name)) - 1)::INTEGER AS start_idx,
  (strpos(lower(text), lower(c_name)) - 1 + length(c_name))::INTEGER AS end_idx, 'CLIENT' AS category,
  'manual' AS source, substring(text, strpos(lower(text), lower(c_name)), length(c_name)) AS value
FROM notes JOIN customer ON c_custkey = custkey
WHERE contains(lower(text), lower(c_name))
"""


def merge_spans_notes(spark, sf_dir):
    raw = D.find_all_matches(order_notes(spark, sf_dir), config=DEFAULT)
    return _rows(D.merge_span_column(raw), "note_id")


_MERGE_SQL = O.statement([
    _NOTES, O.raw_cte(DEFAULT),
    "found AS (SELECT scope, item, seq, s, e, category, 'regex' AS source, v FROM raw)",
    O.merged_cte(["found"]),
], f"SELECT scope AS note_id, {_COLUMNS} FROM merged")


def detect_persons_documents(spark, sf_dir):
    return _rows(E.detect_persons(documents(spark, sf_dir)), "doc_id")


def detect_persons_notes(spark, sf_dir):
    return _rows(E.detect_persons(order_notes(spark, sf_dir)), "note_id")


def detect_orgs_notes(spark, sf_dir):
    return _rows(E.detect_orgs(order_notes(spark, sf_dir)), "note_id")


#: the documents, half of them signed by a firm: the prose itself names none
_SIGNED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' Signed: Acme Blue Solutions, and Nord Tech.'
  WHEN 1 THEN 'Duval SARL Group ' || text ELSE text END AS text FROM {documents}"""
_SIGNED_DOCS = O.src_cte(
    f"SELECT doc_id AS scope, 0 AS item, text FROM ({_SIGNED.format(documents='documents')})")


def detect_orgs_documents(spark, sf_dir):
    signed = spark.sql(_SIGNED, documents=documents(spark, sf_dir))
    return _rows(E.detect_orgs(signed), "doc_id")


def detect_entities_documents(spark, sf_dir):
    return _rows(E.detect_entities(documents(spark, sf_dir)), "doc_id")


def detect_entities_notes(spark, sf_dir):
    return _rows(E.detect_entities(order_notes(spark, sf_dir)), "note_id")


def persons_first_only_notes(spark, sf_dir):
    """One span per name and text."""
    found = E.detect_persons(order_notes(spark, sf_dir), config=E.EntityConfig(first_only=True))
    return _rows(found, "note_id")


def _entities_sql(src: str, key: str, where: str = "") -> str:
    return O.statement([src, O.entity_cte()],
                       f"SELECT scope AS {key}, {_COLUMNS} FROM entity_spans {where}")


_FIRST_ONLY_SQL = O.statement([_NOTES, O.entity_cte()], f"""
SELECT scope AS note_id, {_COLUMNS} FROM entity_spans WHERE category = 'PERSON'
QUALIFY row_number() OVER (PARTITION BY scope, seq, lower(v) ORDER BY s) = 1""")


def stop_filters(spark, sf_dir):
    """Which capitalised words of the notes are on the stop lists."""
    words = order_notes(spark, sf_dir).select(F.explode(F.expr(
        "regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)?', 0)")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select(
        "word", "n",
        F.expr(L.is_stop_word("word")).alias("stop_word"),
        F.expr(L.is_stop_phrase("word")).alias("stop_phrase"),
    )


_STOP_SQL = f"""
WITH words AS (
  SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)?')) AS word
  FROM ({order_notes_sql()}))
SELECT word, count(*) AS n, {O._STOP.format("word")} AS stop_word,
  {O._PHRASE.format("word")} AS stop_phrase
FROM words GROUP BY word
"""


def clean_entities(spark, sf_dir):
    """Supplier names as people write them, reduced to the bare name."""
    written = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("""
      CASE s_suppkey % 4 WHEN 0 THEN concat('Dr. ', s_name, ' (nation ', s_nationkey, ')')
        WHEN 1 THEN concat(s_name, ';:! ') WHEN 2 THEN concat('Madame  ', s_name, ',!')
        ELSE concat(s_name, ' [old\\n]') END""").alias("raw"))
    return written.select("s_suppkey", F.expr(L.clean_entity("raw")).alias("name"))


_CLEAN_SQL = r"""
SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(CASE s_suppkey % 4
    WHEN 0 THEN 'Dr. ' || s_name || ' (nation ' || s_nationkey || ')'
    WHEN 1 THEN s_name || ';:! ' WHEN 2 THEN 'Madame  ' || s_name || ',!'
    ELSE s_name || ' [old' || chr(10) || ']' END,
  '\s*[(\[][^\n\r]*\z', ''), '[,;:!?]+\z', ''),
  '^(?:M\.|Mme|Mlle|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Maitre|Maître|Monsieur|Madame|Mademoiselle)\s+', '')) AS name
FROM supplier
"""


def detect_sensitive_documents(spark, sf_dir):
    found = D.detect_sensitive(documents(spark, sf_dir), config=DEFAULT, rules=RULES)
    return _rows(found, "doc_id")


def detect_sensitive_notes(spark, sf_dir):
    found = D.detect_sensitive(order_notes(spark, sf_dir), config=DEFAULT, rules=RULES)
    return _rows(found, "note_id")


def _sensitive_sql(src: str, key: str) -> str:
    return O.statement([
        src, O.pattern_cte(DEFAULT), O.entity_cte(), O.term_cte(RULES),
        O.merged_cte(["pattern_spans", "entity_spans", "term_spans"]),
    ], f"SELECT scope AS {key}, {_COLUMNS} FROM merged")


def spans_by_category(spark, sf_dir):
    """The flagship: what kinds of sensitive text the documents hold, by language."""
    found = D.detect_sensitive(documents(spark, sf_dir), config=DEFAULT)
    return span_rollup(D.span_rows(found, ["lang"]), ["lang", "category", "source"])


_ROLLUP_SQL = O.statement([
    _DOCS, O.pattern_cte(DEFAULT), O.entity_cte(),
    O.merged_cte(["pattern_spans", "entity_spans"]),
], """SELECT lang, category, m.source, count(*) AS n_spans, count(DISTINCT lower(v)) AS n_values
FROM merged m JOIN documents ON doc_id = scope GROUP BY ALL""")


QUERIES = {
    "find_all_documents": (find_all_documents, _find_all_sql(_DOCS, "doc_id")),
    "find_all_notes": (find_all_notes, _find_all_sql(_NOTES, "note_id")),
    "detect_patterns_documents": (detect_patterns_documents, _patterns_sql(_DOCS, "doc_id")),
    "detect_patterns_notes": (detect_patterns_notes, _patterns_sql(_NOTES, "note_id")),
    "detect_patterns_all_families": (
        detect_patterns_all_families, _patterns_sql(_NOTES, "note_id")),
    "detect_terms_documents": (detect_terms_documents, _terms_sql(_DOCS, "doc_id")),
    "detect_terms_notes": (detect_terms_notes, _terms_sql(_NOTES, "note_id")),
    "term_table_notes": (term_table_notes, _TERM_TABLE_SQL),
    "merge_spans_notes": (merge_spans_notes, _MERGE_SQL),
    "detect_persons_documents": (
        detect_persons_documents, _entities_sql(_DOCS, "doc_id", "WHERE category = 'PERSON'")),
    "detect_persons_notes": (
        detect_persons_notes, _entities_sql(_NOTES, "note_id", "WHERE category = 'PERSON'")),
    "persons_first_only_notes": (persons_first_only_notes, _FIRST_ONLY_SQL),
    "detect_orgs_documents": (
        detect_orgs_documents, _entities_sql(_SIGNED_DOCS, "doc_id", "WHERE category = 'COMPANY'")),
    "detect_orgs_notes": (
        detect_orgs_notes, _entities_sql(_NOTES, "note_id", "WHERE category = 'COMPANY'")),
    "detect_entities_documents": (detect_entities_documents, _entities_sql(_DOCS, "doc_id")),
    "detect_entities_notes": (detect_entities_notes, _entities_sql(_NOTES, "note_id")),
    "stop_filters": (stop_filters, _STOP_SQL),
    "clean_entities": (clean_entities, _CLEAN_SQL),
    "detect_sensitive_documents": (detect_sensitive_documents, _sensitive_sql(_DOCS, "doc_id")),
    "detect_sensitive_notes": (detect_sensitive_notes, _sensitive_sql(_NOTES, "note_id")),
    "spans_by_category": (spans_by_category, _ROLLUP_SQL),
}
