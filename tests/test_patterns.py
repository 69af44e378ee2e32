import re

import pytest

import plain
from veilframe.functions.patterns import (
    FAMILIES, MaskConfig, SEQ, java_pattern, to_java, to_re2,
)
from veilframe.operators.detect import detect_patterns, find_all_matches, span_rows


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(16, "id")


def test_rewriting_to_java():
    assert to_java(r"\bab\b") == r"(?<!\w)ab(?!\w)"
    assert "(?<=\\w)" in to_java(r"\ba-\b", open_tail=True)
    assert to_java(r"né", ignore_case=True) == "(?i)n[éÉ]"
    assert to_java(r"[ée]", ignore_case=True) == "(?i)[Éée]"
    assert to_java(r"[ø-ÿ' -]", ignore_case=True).startswith("(?i)[")
    assert "Ÿ" in to_java(r"[ø-ÿ' -]", ignore_case=True)
    assert to_java(r"[^\s)]").startswith("[^\\t-\\r ")
    assert to_re2(r"\bZIP\b", True) == r"(?i)\bZIP\b"


def test_push_order_and_counts():
    assert len(FAMILIES) == 35
    assert SEQ["email"] == 1 and SEQ["price"] == 34 and SEQ["code"] == 35


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_every_family_equals_plain_python(spark, seed):
    """The rewritten, gated, linear-time JVM forms against the original patterns in
    ``re``: fixtures and random texts, all 35 families, every position."""
    texts = plain.FIXTURES if seed is None else plain.random_texts(400, seed)
    found = span_rows(find_all_matches(rows(spark, texts)), ["id"]).collect()
    got = {(r.id, r.seq, r.start_idx, r.end_idx, r.value) for r in found}
    want = {
        (i, SEQ[name], *m) for i, t in enumerate(texts)
        for name, ms in plain.raw_matches(t).items() for m in ms
    }
    assert got == want
    if seed is None:
        assert {r.seq for r in found} == set(SEQ.values())


def test_cancellation_equals_plain_python(spark):
    texts = plain.FIXTURES + plain.random_texts(300, 7) + [
        "exp 10/20/2024", "call +33 612345678 at 1.22.33.44", "a@b.example @ab x@y.example1@c.example",
        "FR40 303265045 FRABDE40XXX", "0612345678 EUR 06 12 34 56 78", "1234567890AB 1234567890",
    ]
    found = span_rows(detect_patterns(rows(spark, texts)), ["id"]).collect()
    got = {(r.id, r.start_idx, r.seq, r.end_idx, r.category, r.source, r.value) for r in found}
    assert got == {(i, *s) for i, t in enumerate(texts) for s in plain.pattern_spans(t)}


def test_near_misses(spark):
    texts = ["a@b", "CARD 4111 1111 1111 111", "256.1.1.1", "2024-13-01", "ab:cd:ef:gh:ij:kl", "eyJa.eyJb",
             "ABCDEFG", "password hunter", "ref-abc", "ZIP 1234", "@x"]
    found = span_rows(detect_patterns(rows(spark, texts)), ["id"]).collect()
    assert {(r.id, r.value) for r in found} == {
        (i, s[5]) for i, t in enumerate(texts) for s in plain.pattern_spans(t)}
    assert not [r for r in found if r.id in (0, 4, 5, 6, 7, 8, 9, 10)]


def test_linear_forms_survive_hostile_text(spark):
    """Quadratic time or recursion per repetition would not end or overflow here."""
    texts = [
        "a" * 300_000 + "@", "Ab-" + "1a-" * 60_000, "paid 1" + " " * 100_000 + "x",
        "1" * 60_000 + "x", "Name " * 60_000, "Ab_" * 60_000 + "9",
    ]
    from veilframe.operators.detect import detect_sensitive
    assert detect_sensitive(rows(spark, texts)).count() == 6


def test_config():
    merged = MaskConfig.from_partial({"detectors": {"email": False, "phone": True}, "placeholderStyle": "curly"})
    assert not merged.on("email") and merged.on("phone") and merged.on("date")
    assert merged.id_min_length == 10 and merged.placeholder_style == "curly"
    assert MaskConfig.from_partial(None) == MaskConfig()
    assert [f.name for f in MaskConfig.only("email").families()] == ["email"]
    with pytest.raises(ValueError):
        MaskConfig.from_partial({"detectors": {"nope": False}})


def test_toggle_switches_cancellation_off(spark):
    """Raw ranges of a detector that is off cancel nothing."""
    df = rows(spark, ["mail a@bcd.example now"])
    handles = span_rows(detect_patterns(df, config=MaskConfig.only("socialHandle")), ["id"]).collect()
    assert [r.value for r in handles] == ["@bcd.example"]
    assert not span_rows(detect_patterns(df, config=MaskConfig.only("socialHandle", "email")), ["id"]).where(
        "category = 'HANDLE'").collect()


def test_id_min_length(spark):
    df = rows(spark, ["key AB12CD"])
    short = MaskConfig.only("internalCode", id_min_length=6)
    assert [r.value for r in span_rows(detect_patterns(df, config=short), ["id"]).collect()] == ["AB12CD"]
    assert not span_rows(detect_patterns(df, config=MaskConfig.only("internalCode")), ["id"]).collect()


def test_patterns_compile_for_java(spark):
    for family in FAMILIES:
        assert re.search(r"\\b", java_pattern(family)) is None


def test_cheap_classes_hold_the_same_characters(spark):
    from veilframe.functions.patterns import _CLASSES, _CLASSES_ANY_CASE
    from veilframe.functions.spans import quote
    chars = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").selectExpr(
        "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    pairs = [("", *p) for p in _CLASSES] + [("(?i)", *p) for p in _CLASSES_ANY_CASE]
    same = " AND ".join(f"(c RLIKE {quote(flag + old)}) = (c RLIKE {quote(flag + new)})" for flag, old, new in pairs)
    assert not chars.where(f"NOT ({same})").collect()


def test_notes_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    """As on a cluster, where the session asks for no spread."""
    from veilframe.sources import tables
    monkeypatch.setattr(tables, "asked_spread", lambda _: None)
    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1000).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    notes = tables.order_notes(spark, str(tmp_path))
    assert notes.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert notes.count() == 1000
