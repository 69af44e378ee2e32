import random
import time

import plain
from pyspark.sql import functions as F
from veilframe.functions import spans as S
from veilframe.functions.patterns import DETECTORS, MaskConfig
from veilframe.operators import detect as D
from veilframe.operators import masking as M
from veilframe.operators.detect import Rule, detect_terms, find_all_matches, span_rows
from veilframe.operators.entities import EntityConfig, detect_orgs, detect_persons
from veilframe.functions.lexicon import ORG_PATTERN
from veilframe.operators.terms import detect_term_table

PATTERNS_ONLY = MaskConfig().without("person", "organization")


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8, "id")


def test_worked_example(spark):
    text = "Bonjour, je suis Marie Lefebvre (marie.lefebvre@example.fr). Dossier REF-2024-789, devis de 12 500 EUR."
    got = M.restore(M.anonymize(rows(spark, [text]))).first()
    assert got.masked == "Bonjour, je suis [PERSON_1] ([EMAIL_1]). Dossier [ID_1], devis de [PRICE_1]."
    assert got.restored == text and not got.collision


def test_merge_equals_plain_python(spark):
    rng = random.Random(5)
    cases = []
    for i in range(200):
        spans = []
        for seq in range(rng.randint(0, 14)):
            s = rng.randint(0, 30)
            spans.append((s, seq, s + rng.randint(1, 9), "URL", "regex", f"v{seq}"))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, f"id int, spans {S.SPAN_TYPE}")
    got = {r.id: [tuple(x) for x in r.m] for r in df.select("id", F.expr(S.merge_spans("spans")).alias("m")).collect()}
    assert got == {i: plain.merge(spans) for i, spans in cases}


def test_anonymize_equals_plain_python(spark):
    texts = plain.FIXTURES + plain.random_texts(300, 11) + [None, ""]
    found = {r.id: r for r in M.anonymize(rows(spark, texts), config=PATTERNS_ONLY).collect()}
    for i, text in enumerate(texts):
        spans = plain.merge(plain.pattern_spans(text)) if text else []
        mapping = plain.mapping_of(spans)
        assert found[i].masked == (plain.splice(text, spans, mapping) if text else text)
        assert [(m.original, m.placeholder, m.category, m.source, m["count"]) for m in found[i].mapping] == [
            tuple(m[k] for k in ("original", "placeholder", "category", "source", "count")) for m in mapping.values()]
        for s in found[i].spans:
            assert text[s.start_idx:s.end_idx] == s.value


def test_many_values_in_one_text(spark):
    """More distinct values than are ranked by comparison."""
    text = " ".join(f"user{i}@mail.example 10.0.{i}.1" for i in range(120)) + " USER7@mail.example"
    got = M.anonymize(rows(spark, [text]), config=PATTERNS_ONLY).first()
    mapping = plain.mapping_of(plain.merge(plain.pattern_spans(text)))
    assert [m.placeholder for m in got.mapping] == [m["placeholder"] for m in mapping.values()]
    assert got.masked.endswith("[EMAIL_120] [IP_120] [EMAIL_8]")


def test_restore_is_literal_and_single_pass(spark):
    mapping = spark.createDataFrame(
        [(1, "[EMAIL_1]", "$&$1[EMAIL_2]"), (1, "[EMAIL_2]", "b"), (1, "[EMAIL_10]", "ten")],
        "conv_id int, placeholder string, original string")
    texts = spark.createDataFrame(
        [(1, 0, "x [EMAIL_1] [[EMAIL_10] [EMAIL_2][PHONE_9]"), (2, 0, "[EMAIL_1]")],
        "conv_id int, turn int, text string")
    got = {r.conv_id: r.restored for r in M.deanonymize(texts, mapping, "conv_id", ["conv_id", "turn"]).collect()}
    assert got == {1: "x $&$1[EMAIL_2] [ten b[PHONE_9]", 2: "[EMAIL_1]"}


def test_first_spelling_wins_and_collision_flag(spark):
    text = "Bob@x.io BOB@X.IO [EMAIL_1]"
    got = M.restore(M.anonymize(rows(spark, [text]), config=PATTERNS_ONLY)).first()
    # the code family takes the inside of an existing placeholder, which protects it
    spans = plain.merge(plain.pattern_spans(text))
    assert got.masked == plain.splice(text, spans, plain.mapping_of(spans))
    assert got.masked == "[EMAIL_1] [EMAIL_1] [[ID_1]]"
    assert got.restored == "Bob@x.io Bob@x.io [EMAIL_1]" and got.collision
    # without it the placeholder is restored wrongly; the flag tells
    got = M.restore(M.anonymize(rows(spark, [text]), config=MaskConfig.only("email"))).first()
    assert got.restored == "Bob@x.io Bob@x.io Bob@x.io" and got.collision


def test_curly_style(spark):
    got = M.restore(M.anonymize(rows(spark, ["a@b.example"]), config=MaskConfig(placeholder_style="curly")),
                    style="curly").first()
    assert (got.masked, got.restored) == ("{EMAIL_1}", "a@b.example")


def _conversation_turns(n_turns, n_scopes, seed=3):
    rng = random.Random(seed)
    # one conversation holds most turns
    return [(0 if rng.random() < .6 else rng.randint(1, n_scopes), turn, "user",
             f"mail u{rng.randint(0, 40)}@mail.example and 10.0.0.{rng.randint(0, 30)} U{rng.randint(0, 40)}@mail.example")
            for turn in range(n_turns)]


def _masked_plainly(turns):
    by_scope = {}
    for conv, turn, _, text in sorted(turns, key=lambda t: t[1]):
        by_scope.setdefault(conv, []).append((turn, text, plain.merge(plain.pattern_spans(text))))
    masked, mappings = {}, {}
    for conv, items in by_scope.items():
        mappings[conv] = plain.mapping_of([s for _, _, spans in items for s in spans])
        for turn, text, spans in items:
            masked[conv, turn] = plain.splice(text, spans, mappings[conv])
    return masked, mappings


def test_shared_mapping_of_a_hot_conversation(spark):
    """Numbering in small buckets equals numbering in one go, for a hot scope too."""
    turns = _conversation_turns(400, 12)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY, parts=16)
    masked, mappings = _masked_plainly(turns)
    assert {(r.conv_id, r.turn): r.masked for r in got.texts.collect()} == masked
    assert {(r.conv_id, r.key): (r.original, r.placeholder, r["count"]) for r in got.mapping.collect()} == {
        (c, k): (m["original"], m["placeholder"], m["count"]) for c, ms in mappings.items() for k, m in ms.items()}


def test_round_trip_with_responder(spark):
    turns = spark.createDataFrame([
        (1, 1, "user", "I am a@b.example"), (1, 0, "system", "Admin z@b.example"),
        (1, 2, "user", "again A@B.example"), (2, 5, "system", "late prompt y@b.example"), (2, 3, "user", "x@b.example"),
    ], "conv_id long, turn long, role string, text string")

    def responder(sent):
        return sent.withColumn("content", F.concat(F.lit("you wrote "), "masked"))

    got = {(r.conv_id, r.turn): r for r in M.round_trip(turns, responder, config=PATTERNS_ONLY).collect()}
    assert got[1, 0].sent == "Admin [EMAIL_1]" and got[1, 1].sent == "I am [EMAIL_2]"
    assert got[1, 2].restored == "you wrote again a@b.example"
    assert got[2, 5].sent == "late prompt [EMAIL_1]" and got[2, 3].sent == "[EMAIL_2]"
    raw = {(r.conv_id, r.turn): r for r in
           M.round_trip(turns, responder, config=PATTERNS_ONLY, mask_system=False).collect()}
    assert raw[1, 0].sent == "Admin z@b.example" and raw[1, 1].sent == "I am [EMAIL_1]"


ODD_TURNS = [
    (None, 0, "user", "mail c@d.example now"), (None, None, "user", "then E@d.example"), (2, None, "user", "mail e@f.example now"),
    (2, 1, "user", "x a@b.example"), (2, 1, "user", "longer text g@h.example here"), (2, 1, "user", "x a@b.example"),
    (None, 1, None, "c@d.example again"), (3, 1, "user", None), (3, 2, "user", ""), (3, 2, "user", "none"),
]


def _odd_masked_plainly():
    """Texts of a scope in order of item (null first) and hash, equal rows once for the mapping."""
    import hashlib
    masked = {}
    for scope in {t[0] for t in ODD_TURNS}:
        digest = lambda text: hashlib.md5(text.encode()).digest()
        texts = sorted(((t[1] is not None, t[1] or 0, digest(t[3]), t[3]) for t in ODD_TURNS if t[0] == scope and t[3] is not None))
        spans = [plain.merge(plain.pattern_spans(x[3])) for x in texts]
        mapping = plain.mapping_of([s for each in spans for s in each])
        for x, own in zip(texts, spans):
            masked[scope, x[1] if x[0] else None, x[3]] = plain.splice(x[3], own, mapping)
    return masked


def test_null_and_tied_keys_are_masked(spark):
    df = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").repartition(4)
    want = _odd_masked_plainly()
    for parts in (1, 8):
        got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY, parts=parts)
        rows_ = got.texts.collect()
        assert len(rows_) == len(ODD_TURNS) and got.texts.columns == ["conv_id", "turn", "role", "text", "masked"]
        for r in rows_:
            assert r.masked == (want[r.conv_id, r.turn, r.text] if r.text is not None else None)
            assert "@" not in (r.masked or "")
        back = M.deanonymize(got.texts, got.mapping, "conv_id", ["conv_id", "turn"], "masked").collect()
        assert sorted(str(r.restored).lower() for r in back) == sorted(str(t[3]).lower() for t in ODD_TURNS)


def test_round_trip_of_null_and_tied_keys(spark):
    df = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    got = M.round_trip(df, config=PATTERNS_ONLY).collect()
    assert len(got) == len(ODD_TURNS) and not [r for r in got if "@" in (r.sent or "")]
    assert sorted(str(r.restored).lower() for r in got) == sorted(str(t[3]).lower() for t in ODD_TURNS)


def test_a_span_without_placeholder_raises(spark):
    spans = spark.createDataFrame([(1, "a@b.example")], "conv_id int, value string")
    mapping = spark.createDataFrame([], "conv_id int, key string, placeholder string")
    import pytest
    with pytest.raises(Exception, match="a span has no placeholder"):
        M.with_placeholders(spans, mapping, "conv_id").collect()


def test_terms(spark):
    rules = [Rule("C++", "PROJECT"), Rule("acme", "CLIENT"), Rule("Été", "CUSTOM"), Rule("IT", "INTERNAL_CODE", True)]
    got = span_rows(detect_terms(rows(spark, [
        "C++ xC++y Acme acmes ACME. it IT été", "aC++b ￿ acme"]), rules), ["id"]).collect()
    assert sorted((r.id, r.start_idx, r.value) for r in got) == [
        (0, 10, "Acme"), (0, 21, "ACME"), (0, 30, "IT"), (1, 8, "acme")]


def test_term_table_equals_regex(spark):
    import re
    terms = ["acme", "C++", "@joe", "a-a", "Marie Lefebvre", "REF-2024", "x", "Dupont", "12", "EUR 5"]
    texts = plain.random_texts(150, 21, 60) + [
        "xC++y C++ C++z a-a-a @joe z@joe x@joe. MARIE LEFEBVRE ", "word " * 2500 + "acme " + "word " * 2500 + "Dupont"]
    texts = [t.replace("Jean-Luc", "a-a-a").replace("Group", "C++a").replace("Tech", "x@joe ") for t in texts]
    df = rows(spark, texts)
    table = spark.createDataFrame([(t, "CUSTOM", False) for t in terms],
                                  "term string, category string, case_sensitive boolean")
    got = sorted((r.id, r.start_idx, r.end_idx) for r in detect_term_table(df, table, "id").collect())
    want = sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for term in terms
                  for m in re.finditer(rf"\b{re.escape(term)}\b", t, re.A | re.I))
    assert got == want


def test_orgs_equal_plain_python(spark):
    rx = plain.python_pattern(ORG_PATTERN, False)
    words = ["Acme", "Group", "SA", "SAé", "Co", "Corp", "Tech", "Technologies", "blue", "B", "Élan", "Inc.", "IncX", "\n", "Ltd"]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    got = span_rows(detect_orgs(rows(spark, texts)), ["id"]).collect()
    assert sorted((r.id, r.start_idx, r.value) for r in got) == sorted(
        (i, m.start(), m.group()) for i, t in enumerate(texts) for m in rx.finditer(t))


def test_persons(spark):
    texts = ["Dr Marie Curie met Jean Dupont. Dr Jean Dupont left.", "Bonjour Marie New York", "Mr. Smith XDr Smith",
             "Élodie Martin et Marie André x", "Prof Prof"]
    found = [(r.id, r.value) for r in span_rows(detect_persons(rows(spark, texts)), ["id"]).collect()]
    assert (0, "Jean Dupont") in found and found.count((0, "Jean Dupont")) == 1
    assert (0, "Dr Marie") in found and (0, "Marie Curie") in found and (0, "Dr Jean") in found
    assert not [f for f in found if f[0] == 1 and "New York" in f[1]]
    assert [v for i, v in found if i == 2] == ["Smith"]
    assert [v for i, v in found if i == 3] == ["Marie Andr"]
    wide = detect_persons(rows(spark, texts), config=EntityConfig(unicode_names=True))
    assert {r.value for r in span_rows(wide, ["id"]).where("id = 3").collect()} == {"Élodie Martin", "Marie André"}


def test_detection_runs_each_pattern_once(spark, tmp_path):
    """No pattern may appear twice in the plan: Catalyst must not inline a column of
    matches into its consumers."""
    rows(spark, ["x"]).write.parquet(str(tmp_path / "t"))
    df = M.anonymize(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("@[a-zA-Z0-9.-]+") == 1
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan


def test_patterns_are_not_one_method(spark, tmp_path):
    """In whole-stage code (a star in the plan) all patterns would be one method, which the JVM does not compile."""
    rows(spark, ["x"]).write.parquet(str(tmp_path / "t"))
    df = D.detect_patterns(spark.read.parquet(str(tmp_path / "t")))
    marking = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "regexp_replace" in line]
    assert len(marking) == 1 and not marking[0].lstrip(" +-:").startswith("*(")


def test_texts_without_hits_have_no_spans_but_are_not_null(spark):
    found = D.detect_sensitive(rows(spark, ["plain", "a@b.example", None]), rules=[D.Rule("nowhere"), D.Rule("plain")])
    assert sorted([s.value for s in r.spans] for r in found.collect()) == [[], ["a@b.example"], ["plain"]]


def test_time_grows_with_the_matches_of_a_text(spark):
    """50,000 matches in one text: twice as many take at most about twice as long."""
    def seconds(run, n):
        text = " ".join(f"user{i % 9973}@mail.example Jean Dupont" for i in range(n))
        df = spark.createDataFrame([(1, text)], "id int, text string").cache()
        df.count()
        start = time.perf_counter()
        run(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    only = MaskConfig().without(*(d for d in DETECTORS if d != "email"))
    persons = MaskConfig().without(*(d for d in DETECTORS if d != "person"))
    first = EntityConfig(first_only=True)
    for run in (
        lambda df: find_all_matches(df, config=only),
        lambda df: detect_terms(df, [Rule("mail")]),
        lambda df: detect_persons(df, config=first),
        lambda df: M.anonymize(df, config=only),
        lambda df: M.anonymize(df, config=persons),
    ):
        seconds(run, 1000)
        short, long = seconds(run, 25_000), seconds(run, 50_000)
        print(short, long)
        assert long < 2.6 * short + 1, (short, long)
