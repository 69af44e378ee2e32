"""Quality rules as a bitmask ledger.

Each rule looks at a document once. The ledger keeps the measurements and one
long of failure bits; a policy is a versioned set of rules, applied as a mask,
so policies can change, and be compared, without reading a text again.
Ablations count bit patterns: one aggregate by the failure bits, at most
2^rules rows, then bitwise sums over those.

Defined cases: a null or blank text has no words and fails ``few_words``; null
ids and repeated rows keep a ledger row each; an empty table gives an empty
ledger; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GAP_CHARS, text_of, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


#: The place of a rule is its bit; a rule is never moved, new ones come last.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 40 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 16 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("exclamations", "100 * n_exclamations > 40 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(n) for n in {*BASE, *self.rules})


POLICIES = {
    "v1": Policy("v1", ("symbols", "repeated_lines")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each text.

    Repeated three-word windows are found by sorting each text's windows: the
    neighbours that are equal are repeats, and the words they cover follow from
    the gaps between their places. No text is spread over rows.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0)
    step = docs.select("doc_id", text_of().alias("text"))
    step = step.select(
        "doc_id", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        _without(F.col("text"), GAP_CHARS).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_exclamations"),
    )
    kept = ("doc_id", "word_chars", "n_symbols", "n_exclamations")
    counts = ("n_words", "n_lines", "n_dup_lines")
    step = step.select(
        *kept, F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.greatest(F.size("h") - 2, F.lit(0))
    three = F.zip_with(
        F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), lambda a, b: F.xxhash64(a, b)),
        F.slice("h", F.lit(3), n), lambda ab, c: F.xxhash64(ab, c),
    )
    step = step.select(*kept, *counts, three.alias("three"))
    step = step.select(*kept, *counts, F.sort_array(F.transform("three", lambda x, i: F.struct(x.alias("h"), i.alias("i")))).alias("three"))
    pairs = F.greatest(F.size("three") - 1, F.lit(0))
    equal = F.zip_with(
        F.slice("three", F.lit(1), pairs), F.slice("three", F.lit(2), pairs),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    step = step.select(*kept, *counts, F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))).alias("at"))
    return step.select(*kept, *counts, F.coalesce(F.aggregate(
        "at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    ), F.lit(0)).alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failures``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("failures", bits)


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    failed = lambda mask: F.col("failures").bitwiseAND(F.lit(mask).cast("long")) != 0
    return ledger.withColumns({
        "base_failed": failed(Policy("", ()).mask), "kept": ~failed(policy.mask), "policy": F.lit(policy.version),
    })


def ablate(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that
    the policy without it keeps."""
    patterns = ledger.groupBy("failures").agg(F.count("*").alias("n"))
    hit = F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
        for i, r in enumerate(RULES) if policy.mask >> i & 1
    ])).alias("r")
    out = patterns.select("n", hit.alias("hit"), rules).groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return out.agg(
        count(F.col("hit").bitwiseAND(F.col("r.bit")) != 0).alias("fail"),
        count(F.col("hit") == F.col("r.bit")).alias("fail_alone"),
        count(F.col("hit").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
        F.bit_or("hit").alias("fails_with"),
    )


def query(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs), POLICIES["v2"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failures", "n_lines", "n_exclamations", "policy",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
three AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
          FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM three) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w.lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(d.text, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END)
       + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars > 16 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
       + (CASE WHEN 100 * n_exclamations > 40 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, n_lines, n_exclamations, 'v2' AS policy FROM f
"""
