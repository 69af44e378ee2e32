"""Operator state, watermarks and joins of streams."""

import time

import pytest
from pyspark.sql import functions as F
from test_masking import ODD_TURNS, PATTERNS_ONLY, _conversation_turns, _masked_plainly, _odd_masked_plainly
from test_streaming import TURN_SCHEMA, read_stream, write_files
from veilframe.operators import masking as M
from veilframe.streaming.answers import AnswerRestorer, dropped_rows
from veilframe.streaming.calls import call_rollup_stream
from veilframe.streaming.run import drain
from veilframe.streaming.state import StatefulMasker, state_rows, use_rocksdb


def more_files(spark, path, n, rows):
    write_files(spark, f"{path}/later{n}", TURN_SCHEMA, [rows])
    import os
    os.rename(f"{path}/later{n}/in0", f"{path}/in{100 + n}")


def run(spark, path, **settings):
    masker = StatefulMasker(f"{path}/state", config=PATTERNS_ONLY, **settings)
    query = masker.start(read_stream(use_rocksdb(spark), path, TURN_SCHEMA), availableNow=True)
    query.awaitTermination()
    return masker, query


def test_state_over_batches_equals_one_batch_and_survives_a_restart(spark, tmp_path):
    turns = _conversation_turns(90, 5)
    write_files(spark, tmp_path, TURN_SCHEMA, [[t for t in turns if t[1] // 30 == k] for k in range(2)])
    run(spark, tmp_path)
    more_files(spark, tmp_path, 0, [t for t in turns if t[1] // 30 == 2])
    masker, query = run(spark, tmp_path)  # another object, the same checkpoint
    masked, mappings = _masked_plainly(turns)
    assert {(r.conv_id, r.turn): r.masked for r in masker.masked(spark).collect()} == masked
    assert {(int(r.scope), r.key): (r.placeholder, r.original, r["count"]) for r in masker.mapping(spark).collect()} == {
        (c, k): (m["placeholder"], m["original"], m["count"]) for c, ms in mappings.items() for k, m in ms.items()}
    size = state_rows(query)
    values = sum(map(len, mappings.values()))
    assert size["rows"] >= 2 * values and size["bytes"] > 0
    late = [(0, -1, "user", f"new@late.example and {turns[0][3].split()[1]}")]
    more_files(spark, tmp_path, 1, late)
    masker, _ = run(spark, tmp_path)
    got = masker.masked(spark).where("turn = -1").first().masked
    emails = sum(m["category"] == "EMAIL" for m in mappings[0].values())
    assert got.startswith(f"[EMAIL_{emails + 1}] and [EMAIL_")  # a late turn counts on and changes nothing
    assert {(r.conv_id, r.turn): r.masked for r in masker.masked(spark).where("turn >= 0").collect()} == masked


def test_state_of_null_and_tied_keys(spark, tmp_path):
    write_files(spark, tmp_path, TURN_SCHEMA, [ODD_TURNS])
    masker, _ = run(spark, tmp_path)
    got, want = masker.masked(spark).collect(), _odd_masked_plainly()
    assert len(got) == len(ODD_TURNS)
    assert all(r.masked == (want[r.conv_id, r.turn, r.text] if r.text is not None else None) for r in got)


def test_values_expire_and_numbers_do_not_repeat(spark, tmp_path):
    write_files(spark, tmp_path, TURN_SCHEMA, [[(1, 0, "user", "a@x.example b@x.example")]])
    ttl = dict(ttl_ms=4000, counter_ttl_ms=600_000)
    run(spark, tmp_path, **ttl)
    time.sleep(5)
    more_files(spark, tmp_path, 0, [(1, 1, "user", "b@x.example")])
    masker, _ = run(spark, tmp_path, **ttl)
    assert {r.turn: r.masked for r in masker.masked(spark).collect()} == {0: "[EMAIL_1] [EMAIL_2]", 1: "[EMAIL_3]"}


def test_answers_are_matched_and_restored(spark, tmp_path):
    sent_schema = "conv_id long, turn long, sent_at timestamp, masked string"
    answer_schema = "conv_id long, turn long, answered_at timestamp, content string"
    at = lambda h, m=0: F.to_timestamp(F.lit(f"2024-01-01 {h:02d}:{m:02d}:00"))

    def write(name, n, schema, rows):
        df = spark.createDataFrame([(c, t, x) for c, t, _, x in rows], "conv_id long, turn long, x string")
        time_of = F.create_map(*[y for c, t, (h, m), _ in rows for y in (F.lit(f"{c},{t}"), at(h, m))])
        key = F.concat_ws(",", F.coalesce(F.col("conv_id").cast("string"), F.lit("None")), F.coalesce(F.col("turn").cast("string"), F.lit("None")))
        named = schema.split(", ")
        df.select("conv_id", "turn", time_of[key].alias(named[2].split()[0]), F.col("x").alias(named[3].split()[0])).coalesce(1).write.parquet(f"{tmp_path}/{name}/in{n}")

    write("sent", 0, sent_schema, [(1, 0, (8, 0), "[A_1]"), (1, 1, (8, 5), "x"), (None, None, (8, 0), "[A_1]"), (2, 0, (8, 0), "y"), (9, 9, (14, 0), "end")])
    write("answers", 0, answer_schema, [(1, 0, (8, 30), "to [A_1]"), (1, 1, (9, 30), "too late [A_1]"), (None, None, (8, 1), "null [A_1] [A_7]"),
                                        (3, 0, (8, 0), "never asked"), (9, 9, (14, 1), "[A_1]")])
    mapping = spark.createDataFrame([(1, "[A_1]", "Ann"), (None, "[A_1]", "Nil"), (9, "[A_1]", "End")], "conv_id long, placeholder string, original string")
    restorer = AnswerRestorer(str(tmp_path / "out"), lambda _: mapping)
    streams = [spark.readStream.schema(s).parquet(f"{tmp_path}/{n}/in*") for n, s in (("sent", sent_schema), ("answers", answer_schema))]
    restorer.start(*streams, availableNow=True).awaitTermination()
    assert {(r.conv_id, r.turn): r.restored for r in restorer.restored(spark).collect()} == {
        (1, 0): "to Ann", (None, None): "null Nil [A_7]", (9, 9): "End"}
    assert {(r.conv_id, r.turn): r.content for r in restorer.unmatched(spark).collect()} == {(1, 1): "too late [A_1]", (3, 0): "never asked"}
    # A row behind the watermark is not joined any more; the progress tells of it.
    write("answers", 1, answer_schema, [(2, 0, (8, 1), "behind")])
    query = restorer.start(*streams, availableNow=True)
    query.awaitTermination()
    assert dropped_rows(query) == 1
    assert restorer.restored(spark).count() == 3


def test_hours_are_closed_by_the_watermark(spark, tmp_path):
    envelope = '{"ok": true, "data": 1, "meta": {"durationMs": 5, "provider": "p"}}'
    for i, hour in enumerate(("08", "09", "12", "08")):  # the last one comes when its hour is closed
        spark.createDataFrame([(f"2024-01-01 {hour}:10:00", envelope)] * (i + 1), "ts string, envelope string").select(
            F.to_timestamp("ts").alias("ts"), "envelope").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        import os
        for name in os.listdir(f"{tmp_path}/in{i}"):
            os.utime(f"{tmp_path}/in{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    out = drain(call_rollup_stream(read_stream(spark, tmp_path, "ts timestamp, envelope string")), "test")
    assert {(str(r.hour)[11:13], r.n_calls) for r in out.collect()} == {("08", 1), ("09", 2)}


def test_sketches_keep_their_errors_over_batches(spark, tmp_path):
    from veilframe.streaming.calls import K, hourly_durations
    from veilframe.streaming.inquiries import daily_senders
    n = 30_000
    calls = spark.range(n).select(
        F.to_timestamp(F.lit("2024-01-01 08:10:00")).alias("ts"), (F.col("id") * 7919 % n).alias("d"), F.lit("p").alias("p"))
    calls = calls.select("ts", F.format_string('{"ok": true, "meta": {"durationMs": %d, "provider": "%s"}}', "d", "p").alias("envelope"))
    table = hourly_durations(str(tmp_path / "durations"))
    for k in range(3):
        table.process(calls.where(F.pmod(F.hash("envelope"), F.lit(3)) == k), k)
    table.process(calls.where(F.pmod(F.hash("envelope"), F.lit(3)) == 2), 2)  # the same batch again
    got = table.read(spark).collect()
    assert len(got) == 1 and got[0].n_timed == n
    for q, value in ((.5, got[0].p50), (.95, got[0].p95), (.99, got[0].p99)):
        assert abs(value / n - q) < 4 * 1.33 / K
    inquiries = spark.range(20_000).select(
        F.to_timestamp(F.lit("2024-01-01 08:10:00")).alias("horodatage"), F.lit("email").alias("canal"), F.lit("s").alias("source"), (F.col("id") % 5000).cast("string").alias("expediteur"))
    senders = daily_senders(str(tmp_path / "senders"))
    senders.process(inquiries.where("expediteur < '3'"), 0)
    senders.process(inquiries.where("expediteur >= '25'"), 1)
    row = senders.read(spark).first()
    assert row.n_inquiries > 20_000 and abs(row.n_senders_about - 5000) < 5 * .0163 * 5000
