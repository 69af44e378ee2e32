"""Terms that come as a table rather than with the request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.operators import bloom

_WORD = r"\w+"
_CHUNK = 4096
#: up to so many first words of terms are looked for one by one
_FEW = 32
#: between the two words of a key; no word holds it
_BETWEEN = "\u0001"


def detect_term_table(df: DataFrame, terms: DataFrame, key: str,
                      text_col: str = "text") -> DataFrame:
    """Span rows of every term of ``terms (term, category, case_sensitive)``.

    Text words meet the terms that begin with the same word, or the same two words:
    an equi-join instead of a cross join of texts and terms. Because a term match is
    bounded by ``\\b``, the first two words of a term are whole words of the text. What
    travels with a word is a window as long as the longest term, never the text, and a
    word travels only if a Bloom filter of the terms' beginnings has it: the test is part
    of the scan, so the shuffle is in proportion to the hits. If all terms begin with few different
    words, texts without any of them end before they are taken apart, and only these words are tested:
    the filter is full with millions of terms.
    Terms without any word character cannot be found this way and are rejected.

    Occurrences of one term do not overlap (leftmost first), as with a regex.
    """
    first, second = (F.lower(F.expr(f"coalesce(get(regexp_extract_all(term, '\\\\w+', 0), {i}), '')")) for i in (0, 1))
    prepared = terms.select(
        "term", "category", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"),
        F.when(first == "", F.raise_error("a term needs a word character")).when(second == "", first)
        .otherwise(F.concat(first, F.lit(_BETWEEN), second)).alias("_word"),
        first.alias("_first"), (F.expr("instr(term, regexp_extract(term, '\\\\w+', 0))") - 1).alias("_lead"),
        F.length("term").alias("_len"),
    )
    beginnings = bloom.build(prepared, F.col("_word"))
    firsts = sorted(r["_first"] for r in prepared.select("_first").distinct().limit(_FEW + 1).collect())
    few = firsts if 0 < len(firsts) <= _FEW else []
    # two numbers, one row: the reach of a window to either side of a word
    reach = prepared.agg(F.max("_lead").alias("_lead"), F.max("_len").alias("_len")).first()
    lead, length = (reach["_lead"] or 0), (reach["_len"] or 0)

    # Long texts are cut into chunks by word start; a chunk reaches one window further
    # on both sides, and one character more for the boundaries.
    reach_back, reach_on = lead + 1, length + 1
    chunks = df.select(key, F.expr(f"concat(repeat(' ', {reach_back}), {text_col})").alias("_padded"),
                       F.expr(f"length({text_col})").alias("_n")).select(
        key, "_padded", F.explode(F.expr(f"sequence(0, greatest(_n - 1, 0) div {_CHUNK})")).alias("_c"),
    ).select(key, (F.col("_c") * _CHUNK).cast("int").alias("_from"), F.expr(
        f"substring(_padded, cast(_c * {_CHUNK} as int) + 1, {reach_back + _CHUNK + reach_on})",
    ).alias("_chunk"))
    # One beginning for each word, and one for each two; those that no term has end here.
    if few:
        chunks = chunks.where(S.holds_any("lower(_chunk)", few))
    words = chunks.select(key, "_from", "_chunk", F.expr(S.find_all("_chunk", _WORD)).alias("_w"))
    keys = F.transform("_w", lambda t, i: F.struct(
        t["start_idx"].alias("at"), F.lower(t["value"]).alias("one"),
        F.concat(F.lower(t["value"]), F.lit(_BETWEEN), F.lower(F.get("_w", i + 1)["value"])).alias("two")))
    keys = words.select(key, "_from", "_chunk", keys.alias("_k"))
    begins = (lambda k: k["one"].isin(few)) if few else (lambda k: F.lit(True))
    both = lambda name: F.transform(
        F.filter("_k", lambda k: begins(k) & (k["at"] >= reach_back) & (k["at"] < reach_back + _CHUNK) & beginnings.test(k[name])),
        lambda k: F.struct(k["at"].alias("at"), k[name].alias("word")))
    begun = keys.select(key, "_from", "_chunk", F.concat(both("one"), both("two")).alias("_t"))
    # The outer form: a test for emptiness would be pushed below all of this and run it again.
    tokens = begun.select(key, "_from", "_chunk", F.explode_outer("_t").alias("_t")).where(F.col("_t").isNotNull())
    around = tokens.select(
        key, F.col("_t.word").alias("_word"), (F.col("_from") + F.col("_t.at") - reach_back).alias("_at"),
        F.expr(f"substring(_chunk, _t.at - {reach_back} + 1, {lead + length + 2})").alias("_around"),
    )
    met = around.join(prepared.drop("_first"), "_word")
    # offset of the term inside the window, and its neighbours
    here = met.select(
        key, "term", "category", "case_sensitive", "_len",
        (F.col("_at") - F.col("_lead")).alias("start_idx"),
        F.expr(f"substring(_around, {lead} + 2 - _lead, _len)").alias("value"),
        F.expr(f"substring(_around, {lead} + 1 - _lead, 1)").alias("_before"),
        F.expr(f"substring(_around, {lead} + 2 - _lead + _len, 1)").alias("_after"),
    )
    same = F.expr("CASE WHEN case_sensitive THEN value = term ELSE lower(value) = lower(term) END")
    edge = lambda inside, outside: (  # noqa: E731  a boundary: exactly one side is a word character
        inside.rlike(r"^\w$") != outside.rlike(r"^\w$"))
    hits = here.where(
        same
        & edge(F.expr("substring(value, 1, 1)"), F.col("_before"))
        & edge(F.expr("substring(value, -1, 1)"), F.col("_after"))
    )
    # a group is the occurrences of one term in one text
    kept = hits.groupBy(key, "term", "category", "_len").agg(
        F.array_sort(F.collect_list(F.struct("start_idx", "value"))).alias("_hits"),
    ).select(key, "category", "_len", F.explode(F.expr("""aggregate(
      _hits, cast(array() as array<struct<start_idx:int,value:string>>),
      (acc, x) -> CASE WHEN size(acc) > 0 AND x.start_idx < acc[size(acc) - 1].start_idx + _len
        THEN acc ELSE concat(acc, array(x)) END)""")).alias("_h"))
    return kept.select(
        key, "_h.start_idx", (F.col("_h.start_idx") + F.col("_len")).alias("end_idx"),
        "category", F.lit("manual").alias("source"), "_h.value",
    )
