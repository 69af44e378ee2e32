import plain
from pyspark.sql import functions as F
from test_masking import ODD_TURNS, PATTERNS_ONLY, _conversation_turns, _masked_plainly, _odd_masked_plainly
from veilframe.operators import inquiries as IQ
from veilframe.streaming.inquiries import (
    daily_inquiries, inquiry_log, inquiry_stats_stream, log_inquiries_stream,
)
from veilframe.streaming.masking import ConversationMasker, mask_stream
from veilframe.streaming.run import drain

TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def write_files(spark, path, schema, batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/in{i}")
        # file streams take files in order of modification time
        import os
        for name in os.listdir(f"{path}/in{i}"):
            os.utime(f"{path}/in{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))


def read_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")


def test_mask_stream_equals_batch(spark, tmp_path):
    texts = plain.FIXTURES + plain.random_texts(60, 31)
    write_files(spark, tmp_path, "id int, text string", [
        [(i, t) for i, t in enumerate(texts) if i % 3 == k] for k in range(3)])
    out = drain(mask_stream(read_stream(spark, tmp_path, "id int, text string"), config=PATTERNS_ONLY)
                .select("id", "masked"), "test")
    got = {r.id: r.masked for r in out.collect()}
    for i, text in enumerate(texts):
        spans = plain.merge(plain.pattern_spans(text))
        assert got[i] == plain.splice(text, spans, plain.mapping_of(spans))


def test_conversation_stream_over_batches_equals_one_batch(spark, tmp_path):
    turns = _conversation_turns(120, 5)
    write_files(spark, tmp_path, TURN_SCHEMA, [
        [t for t in turns if t[1] // 40 == k] for k in range(3)])
    masker = ConversationMasker(str(tmp_path / "state"), config=PATTERNS_ONLY, parts=8)
    masker.start(read_stream(spark, tmp_path, TURN_SCHEMA), availableNow=True).awaitTermination()
    masked, mappings = _masked_plainly(turns)
    assert {(r.conv_id, r.turn): r.masked for r in masker.masked(spark).collect()} == masked
    assert {(r.conv_id, r.key): (r.placeholder, r["count"]) for r in masker.mapping(spark).collect()} == {
        (c, k): (m["placeholder"], m["count"]) for c, ms in mappings.items() for k, m in ms.items()}


def test_late_turn_and_repeated_batch(spark, tmp_path):
    masker = ConversationMasker(str(tmp_path / "state"), config=PATTERNS_ONLY)
    frame = lambda *turns: spark.createDataFrame(turns, TURN_SCHEMA)
    masker.process(frame((1, 5, "user", "a@x.example b@x.example")), 0)
    late = frame((1, 2, "user", "c@x.example a@x.example"), (2, 0, "user", "z@x.example"))
    masker.process(late, 1)
    masker.process(late, 1)  # the same batch again after a failure
    got = {(r.conv_id, r.turn): r.masked for r in masker.masked(spark).collect()}
    assert got == {(1, 5): "[EMAIL_1] [EMAIL_2]", (1, 2): "[EMAIL_3] [EMAIL_1]", (2, 0): "[EMAIL_1]"}
    counts = {(r.conv_id, r.key): r["count"] for r in masker.mapping(spark).collect()}
    assert counts[1, "a@x.example"] == 2 and counts[1, "c@x.example"] == 1


def test_stream_masks_null_and_tied_keys(spark, tmp_path):
    masker = ConversationMasker(str(tmp_path / "state"), config=PATTERNS_ONLY)
    masker.process(spark.createDataFrame(ODD_TURNS, TURN_SCHEMA), 0)
    want = _odd_masked_plainly()
    got = masker.masked(spark).collect()
    assert len(got) == len(ODD_TURNS)
    assert all(r.masked == (want[r.conv_id, r.turn, r.text] if r.text is not None else None) for r in got)
    again = (None, 9, "user", "C@d.example and new@d.example"), (2, 9, "user", "new@d.example")
    masker.process(spark.createDataFrame(again, TURN_SCHEMA), 1)
    late = {r.conv_id: r.masked for r in masker.masked(spark).where("turn = 9").collect()}
    assert late == {None: late[None], 2: "[EMAIL_4]"} and "@" not in late[None] and late[None].endswith("[EMAIL_3]")


def test_mapping_is_folded_and_looked_up_by_bucket(spark, tmp_path):
    """Forty batches in runs that double: the same table as without folding, few runs, and few files read."""
    from veilframe.streaming.store import SortedRuns
    store = SortedRuns(str(tmp_path / "store"), ["scope", "key"], fanout=2, buckets=16, keep=3)
    want = {}
    for b in range(40):
        rows = [(None if i == 0 else i % 3, f"k{b}-{i}", b * 10 + i) for i in range(5)]
        store.append(spark.createDataFrame(rows, "scope long, key string, n long"), b)
        if b % 10 == 5:
            store.append(spark.createDataFrame(rows, "scope long, key string, n long"), b)  # a repeated batch
        want |= {(s, k): n for s, k, n in rows}
        assert len(store.manifest(spark, b)) <= 7
    fresh = SortedRuns(str(tmp_path / "store"), ["scope", "key"], fanout=2, buckets=16, keep=3)  # after a restart
    assert fresh.last(spark) == 39
    assert {(r.scope, r.key): r.n for r in fresh.read(spark, 39).collect()} == want
    wanted = spark.createDataFrame([(None, "k7-0"), (1, "k20-1"), (1, "none")], "scope long, key string")
    found = fresh.read(spark, 39, wanted)
    assert {(r.scope, r.key): r.n for r in found.collect()} == {(None, "k7-0"): 70, (1, "k20-1"): 201}
    import glob
    runs = [run for _, run in fresh.manifest(spark, 39)]
    files = [f for run in runs for f in glob.glob(f"{tmp_path}/store/runs/run={run}/*/*.parquet")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    touched = {r[0] for r in fresh._read(spark, runs, [3]).select(F.input_file_name()).distinct().collect()}
    assert len(touched) < len(files) / 2
    kept = {name for name in __import__("os").listdir(tmp_path / "store" / "runs")}
    assert len(kept) < 15 and len(__import__("os").listdir(tmp_path / "store" / "manifest")) == 3


def _inquiry(canal="email", sender="s", text="t", time="2024-01-01 00:00:00", key=None):
    return (canal, "gmail", sender, None, text, None, time, key)


def _inquiries(spark, *rows):
    df = spark.createDataFrame(rows, IQ.INQUIRY_SCHEMA.replace("timestamp", "string"))
    return df.withColumn("horodatage", F.col("horodatage").cast("timestamp"))


def test_inquiries_batch(spark):
    df = _inquiries(
        spark, _inquiry("fax"), _inquiry(sender=""), _inquiry(text=None), _inquiry(None),
        _inquiry(key="k", time="2024-01-02 00:00:00"), _inquiry(key="k"), _inquiry(), _inquiry(),
        _inquiry(time=None, key="n"))
    codes = [r.error_code for r in IQ.rejected(IQ.validate_inquiries(df)).collect()]
    assert sorted(codes) == ["INVALID_FIELD"] * 2 + ["MISSING_FIELDS"] * 2
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    logged = IQ.log_inquiries(df, now).collect()
    assert sorted(str(r.external_id) for r in logged) == ["None", "None", "k", "n"]
    assert {str(r.horodatage) for r in logged} == {"2024-01-01 00:00:00", "2030-01-01 00:00:00"}


def test_inquiries_stream_deduplicates_across_batches(spark, tmp_path):
    schema = _inquiries(spark, _inquiry()).schema
    batches = [
        _inquiries(spark, _inquiry(key="a"), _inquiry(key="a", text="other"), _inquiry(), _inquiry("fax")).collect(),
        _inquiries(spark, _inquiry(key="a", text="third"), _inquiry(key="b"), _inquiry()).collect(),
    ]
    write_files(spark, tmp_path, schema, batches)
    out = drain(log_inquiries_stream(read_stream(spark, tmp_path, schema)), "test")
    assert sorted(str(r.external_id) for r in out.collect()) == ["None", "None", "a", "b"]


def test_inquiry_stats_stream_closes_days(spark, tmp_path):
    schema = _inquiries(spark, _inquiry()).schema
    days = [_inquiries(spark, *[_inquiry(time=f"2024-01-{d:02d} 10:00:00")] * d).collect() for d in (1, 2, 5)]
    write_files(spark, tmp_path, schema, days)
    out = drain(inquiry_stats_stream(read_stream(spark, tmp_path, schema)), "test")
    assert {(str(r.day)[:10], r.n_inquiries) for r in out.collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}


def test_inquiry_log_is_that_of_the_whole_table(spark, tmp_path):
    schema = _inquiries(spark, _inquiry()).schema
    batches = [
        _inquiries(spark, _inquiry(key="a", time="2024-01-03 00:00:00"), _inquiry(key="a", text="z"), _inquiry()).collect(),
        _inquiries(spark, _inquiry(key="a", text="b"), _inquiry(key="b"), _inquiry("fax"), _inquiry()).collect(),
        _inquiries(spark, _inquiry(key="b", sender="r")).collect(),
    ]
    write_files(spark, tmp_path, schema, batches)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    log = inquiry_log(str(tmp_path / "log"), now)
    log.start(read_stream(spark, tmp_path, schema), availableNow=True).awaitTermination()
    want = IQ.log_inquiries(spark.createDataFrame(sum(batches, []), schema), now)
    assert sorted(map(str, log.read(spark).collect())) == sorted(map(str, want.collect()))
    log.process(spark.createDataFrame(batches[2], schema), 2)  # the same batch again
    assert log.read(spark).count() == want.count()


def test_daily_inquiries_are_complete(spark, tmp_path):
    schema = _inquiries(spark, _inquiry()).schema
    days = [_inquiries(spark, *[_inquiry(time=f"2024-01-{d:02d} 10:00:00")] * d).collect() for d in (5, 1, 2, 5)]
    write_files(spark, tmp_path, schema, days)
    daily = daily_inquiries(str(tmp_path / "daily"))
    daily.start(read_stream(spark, tmp_path, schema), availableNow=True).awaitTermination()
    assert {(str(r.day)[:10], r.n_inquiries) for r in daily.read(spark).collect()} == {
        ("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-05", 10)}


def test_tables_of_several_files_and_of_one_are_streamed(spark, tmp_path):
    import glob
    import os

    from veilframe.sources.tables import stream
    turns = spark.range(30).select("id", F.lit("a@x.example").alias("text"))
    turns.repartition(3).write.parquet(str(tmp_path / "turns.parquet"))
    turns.coalesce(1).write.parquet(str(tmp_path / "made"))
    os.rename(glob.glob(str(tmp_path / "made" / "*.parquet"))[0], tmp_path / "single.parquet")
    for name in ("turns", "single"):
        out = drain(stream(spark, str(tmp_path), name), "test")
        assert sorted(r.id for r in out.collect()) == list(range(30))
