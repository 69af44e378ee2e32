from pyspark.sql import functions as F
from test_masking import ODD_TURNS, PATTERNS_ONLY, _conversation_turns, _masked_plainly, _odd_masked_plainly
from veilframe.operators import masking as M

SCHEMA = "conv_id long, turn long, role string, text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_scopes_travel_once(spark):
    """Texts and places of spans in one exchange by scope: no join, no row per span, no original but the text."""
    df = spark.createDataFrame(_conversation_turns(200, 12), SCHEMA)
    got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY)
    for frame in (got.texts, got.mapping):
        plan = _plan(frame).split("Initial Plan")[0]
        assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
    assert "value" not in _plan(got.texts)


def test_small_and_large_scopes(spark):
    turns = _conversation_turns(400, 12) + [(13, 1, "user", "😀 é Zé@x.example ÉTÉ@mail.example été@mail.example"), (None, 1, "user", "a@b.example")]
    df = spark.createDataFrame(turns, SCHEMA).repartition(8)
    masked, mappings = _masked_plainly(turns)
    for small in (0, 100, 10_000):
        got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY, small=small)
        assert {(r.conv_id, r.turn): r.masked for r in got.texts.collect()} == masked
        assert {(r.conv_id, r.key): (r.original, r.placeholder, r.category, r.source, r["count"]) for r in got.mapping.collect()} == {
            (c, k): tuple(m[x] for x in ("original", "placeholder", "category", "source", "count"))
            for c, ms in mappings.items() for k, m in ms.items()}
        assert got.spans.count() == sum(m["count"] for ms in mappings.values() for m in ms.values())
        back = M.deanonymize(got.texts, got.mapping, "conv_id", ["conv_id", "turn"], "masked", small=small)
        assert {(r.conv_id, r.turn): r.restored.lower() for r in back.collect()} == {(t[0], t[1]): t[3].lower() for t in turns}


def test_null_and_tied_keys_in_small_scopes(spark):
    df = spark.createDataFrame(ODD_TURNS, SCHEMA).repartition(4)
    want = _odd_masked_plainly()
    got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY)
    rows = got.texts.collect()
    assert len(rows) == len(ODD_TURNS) and got.texts.columns == ["conv_id", "turn", "role", "text", "masked"]
    for r in rows:
        assert r.masked == (want[r.conv_id, r.turn, r.text] if r.text is not None else None)
    back = M.deanonymize(got.texts, got.mapping, "conv_id", ["conv_id", "turn"], "masked").collect()
    assert sorted(str(r.restored).lower() for r in back) == sorted(str(t[3]).lower() for t in ODD_TURNS)


def test_restoring_small_scopes_is_literal(spark):
    mapping = spark.createDataFrame([(1, "[EMAIL_1]", "\\1$&[EMAIL_2]"), (1, "[EMAIL_2]", "b")], "s long, placeholder string, original string")
    texts = spark.createDataFrame([(1, 0, "[EMAIL_1][EMAIL_2][PHONE_9]"), (2, 0, "[EMAIL_1]"), (2, 1, None)], "s long, i int, text string")
    got = M.deanonymize(texts, mapping, "s", ["s", "i"]).withColumn("n", F.lit(1)).collect()
    assert {(r.s, r.i): r.restored for r in got} == {(1, 0): "\\1$&[EMAIL_2]b[PHONE_9]", (2, 0): "[EMAIL_1]", (2, 1): None}


def test_words_that_begin_no_term_do_not_travel_past_a_full_filter(spark, monkeypatch):
    """Millions of terms fill the filter, and every word passes it."""
    from veilframe.operators import bloom, terms
    monkeypatch.setattr(bloom.Bloom, "test", lambda self, key: key.isNotNull())
    df = spark.createDataFrame([(1, "to Customer#000000012, of CUSTOMER#000000013 now"), (2, "one two three " * 700 + "customer#12"),
                                (3, "no such word"), (4, None)], "id int, text string")
    table = spark.createDataFrame([(f"Customer#{i:09d}", "CLIENT", False) for i in range(40)],
                                  "term string, category string, case_sensitive boolean")
    joined = []
    real = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *a, **k: joined.append(self) or real(self, *a, **k))
    found = terms.detect_term_table(df, table, "id").collect()
    assert sorted((r.id, r.start_idx, r.value) for r in found) == [(1, 3, "Customer#000000012"), (1, 26, "CUSTOMER#000000013")]
    assert joined[0].count() == 6  # two beginnings of each of three names, not of every word


def test_shapes_stand_in_every_match():
    import plain
    from veilframe.functions.patterns import FAMILIES
    shaped = {f.name: plain.python_pattern(f.shape, False) for f in FAMILIES if f.shape}
    assert set(shaped) == {"address_fr", "address_en", "date_fr_long", "date_en"}
    for text in plain.FIXTURES + plain.random_texts(3000, 31):
        for name, found in plain.raw_matches(text).items():
            assert not found or name not in shaped or shaped[name].search(text), (name, text)


def test_few_and_many_spans_of_a_text_are_numbered_alike(spark):
    """Few are compared pairwise and many sorted: every number of spans around the border, repeats included."""
    import plain
    texts = [" ".join(f"{'U' if i % 5 == 0 else 'u'}{i % 7}@mail.example 10.0.0.{i % 4}" for i in range(n)) for n in range(14)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in M.anonymize(df, config=PATTERNS_ONLY).collect()}
    for i, text in enumerate(texts):
        spans = plain.merge(plain.pattern_spans(text))
        mapping = plain.mapping_of(spans)
        assert got[i].masked == plain.splice(text, spans, mapping)
        assert [(m.key, m.original, m.placeholder, m["count"]) for m in got[i].mapping] == [
            (k, m["original"], m["placeholder"], m["count"]) for k, m in mapping.items()]
    plan = M.anonymize(df)._jdf.queryExecution().executedPlan().toString()
    assert "_tokens" in plan and "Python" not in plan


def test_spans_of_a_large_scope_find_their_text_by_its_number(spark):
    """Long texts and repeated rows too; neither hash nor item travels back with a piece."""
    long = " ".join(f"é user{i % 300}@mail.example" for i in range(1500))
    turns = [(1, 1, "user", long), (1, 2, "user", "USER7@mail.example"), (1, 1, "user", long), (1, 3, "user", "none")]
    df = spark.createDataFrame(turns, SCHEMA)
    got = M.anonymize_many(df, "conv_id", "turn", config=PATTERNS_ONLY, small=10)
    masked, _ = _masked_plainly(turns)
    assert sorted((r.turn, r.masked) for r in got.texts.collect()) == sorted((t[1], masked[1, t[1]]) for t in turns)
    assert got.spans.where("value NOT LIKE '%@mail.example'").count() == 0 and got.spans.count() == 3001
    back = _plan(got.texts.select("turn", "masked")).split("Initial Plan")[0]
    assert "hashpartitioning(_row_id" in back
