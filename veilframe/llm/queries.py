"""The registered queries of the numbered operators, and their DuckDB statements."""

from __future__ import annotations

from veilframe.llm import chats, extraction, leaks, mixing, neardup, pii, quality, recompression, repairs, suffixes, toxicity, tries, urlrules
from veilframe.llm.common import table

#: name: (query of (spark, sf_dir), DuckDB statement or None)
CATALOG = {
    "op1_quality_rules": (lambda spark, d: quality.query(table(spark, d, "documents")), quality.SQL),
    "op2_mix_sources": (lambda spark, d: mixing.query(table(spark, d, "documents")), mixing.SQL),
    "op3_benchmark_decontamination": (
        lambda spark, d: leaks.query(table(spark, d, "documents"), table(spark, d, "benchmark")), None,
    ),
    "op4_chat_formatting": (lambda spark, d: chats.query(table(spark, d, "conversations")), chats.SQL),
    "op5_html_extraction": (lambda spark, d: extraction.query(table(spark, d, "pages")), None),
    "op6_minhash_near_dedup": (lambda spark, d: neardup.query(table(spark, d, "documents")), neardup.SQL),
    "op7_pii": (lambda spark, d: pii.query(table(spark, d, "documents")), None),
    "op8_substring_dedup": (lambda spark, d: recompression.query(table(spark, d, "documents")), recompression.SQL),
    "op9_suffix_array_dedup": (lambda spark, d: suffixes.query(table(spark, d, "documents")), None),
    "op10_toxicity": (lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")), None),
    "op11_url_filters": (lambda spark, d: urlrules.query(table(spark, d, "pages")), None),
    "op12_prefix_trie": (lambda spark, d: tries.query(table(spark, d, "conversations")), tries.SQL),
    "op13_structure_repair": (lambda spark, d: repairs.query(table(spark, d, "conversations")), None),
}
