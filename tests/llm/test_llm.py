"""The numbered operators against DuckDB, plain versions, or held-out rows."""

import itertools
import random
import re
import time

import brute
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from veilframe.llm import chats, extraction, leaks, mixing, neardup, pii, quality, recompression, repeats, suffixes, toxicity
from veilframe.llm.dom import parse

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x y z " * 30, "en", None, 1),
    (None, None, None, None, None), (3, "", "en", "s", 0), (4, " \t\n\x0b", "en", "t", 4), (5, "the the the " * 2000, "en", "t", 9),
    (6, "é" * 3000 + " ü\nü\nü\n\nü", "de", "t", 2), (7, "x y z " * 30, "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit("!") for c in ("words", "h", "_n", "home", "payload", "score", "kept", "failures", "component_id", "rep")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con, sql


def arrow(frame, *columns):
    return frame.select(*columns).toArrow()


@pytest.mark.parametrize("module,name", [(quality, "documents"), (mixing, "documents"), (chats, "conversations")])
def test_native_operators_equal_sql(spark, module, name):
    frame = spark.read.parquet(f"{SF}/{name}.parquet")
    assert compare(module.query(frame), connect(SF), module.SQL) is None


def test_quality_and_mixing_of_odd_rows(odd, nothing):
    plain = arrow(odd, "doc_id", "text", "lang", "source", "n_chars")
    assert compare(quality.query(odd), *duck(quality.SQL, documents=plain)) is None
    once = odd.select(*plain.column_names).distinct()
    assert compare(mixing.query(once), *duck(mixing.SQL, documents=once.toArrow())) is None
    assert mixing.mix(odd).columns == [*odd.columns, "replica", "mix_key"]
    for module in (quality, mixing):
        assert module.query(nothing).count() == 0


def test_ablation_counts_rules(spark, odd):
    ledger = quality.ledger(odd).cache()
    policy = quality.POLICIES["v2"]
    rows = [r.failures for r in ledger.collect()]
    for r in quality.ablate(ledger, policy).collect():
        assert r.fail == sum(f & r.bit != 0 for f in rows)
        assert r.fail_alone == sum(f & policy.mask == r.bit for f in rows)
        assert r.kept_without == sum(f & policy.mask & ~r.bit == 0 for f in rows)


def test_mixing_means_and_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    got = mixing.mix(docs, {"x": 3.0, "y": 1.0}).groupBy("source").count()
    count = {r["source"]: r["count"] for r in got.collect()}
    assert abs(count["x"] - 3000) < 250 and abs(count["y"] - 1000) < 150
    many = mixing.mix(docs.filter("source = 'x'").limit(300), {"x": 1.0}, epochs=80.0).count()  # over MOST: sums of draws
    assert abs(many / 300 - 80) < 2.5
    keys = [r.mix_key for r in mixing.mix(docs).collect()]
    assert keys == sorted(keys)
    assert mixing.mix(docs, {"z": 1.0}).count() == 0


def test_chats_collapse_snapshots(spark):
    rows = [(c, t, r, x) for c, turns in {
        1: "ab", 2: "abc", 3: "abd", 4: "abc", 5: "x", None: "xy", 7: "xyz"}.items() for t, (r, x) in enumerate(("u", k) for k in turns)]
    rows += [(1, 0, "u", "a"), (8, None, None, None), (8, None, "u", None), (9, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(0), "h1": F.lit("?"), "_conv": F.lit(1)})
    for hot in (4096, 1):  # with hot conversations split in pieces too
        con, sql = duck(chats.SQL, conversations=arrow(frame, "conv_id", "turn", "role", "text"))
        assert compare(chats.format_chats(frame, hot=hot), con, sql) is None
    kept = {r.conv_id: r.n_copies for r in chats.format_chats(frame).collect()}
    assert kept == {2: 2, 3: 1, 7: 1, 8: 1}
    long = spark.range(3000).selectExpr("1L AS conv_id", "id * 1000003 AS turn", "'u' AS role", "cast(id AS string) AS text")
    parts = chats.format_chats(long, part_turns=100, hot=50).orderBy("part").collect()
    assert len(parts) == 30 and all(p.n_parts == 30 and p.n_turns == 3000 for p in parts)
    assert "".join(p.text for p in parts) == "".join(f"<|u|>\n{i}<|end|>\n" for i in range(3000))
    assert chats.query(frame.limit(0)).count() == 0


def plain_spans(kind, text):
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
    for m in re.finditer(pattern, text):
        digits = re.sub("[^0-9]", "", m.group())
        if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
            continue
        if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
            continue
        if kind == "phone" and not 9 <= len(digits) <= 15:
            continue
        yield m.span()


def test_plain_personal_data_equals_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("0123456789..@@ab-+ ()%1.1. \n") for _ in range(rng.randint(0, 45)))
        for kind, finder in pii.FINDERS.items():
            assert list(finder(text)) == list(plain_spans(kind, text)), (kind, text)


DISGUISED = {
    "mail john.doe [at] example [dot] com now": "john.doe [at] example [dot] com",
    "john at example dot com": "john at example dot com",
    "call plus one five five five one two three four five six seven": "plus one five five five one two three four five six seven",
    "ip one nine two dot one six eight dot one dot one ok": "one nine two dot one six eight dot one dot one",
    "jоhn@exаmple.com x": "jоhn@exаmple.com", "card ４１１１ １１１１ １１１１ １１１１": "４１１１ １１１１ １１１１ １１１１",
    "mary(at)mail.example.org": "mary(at)mail.example.org", "a​b@x​y.com": "a​b@x​y.com",
}


def test_disguised_personal_data_maps_to_the_source():
    for text, want in DISGUISED.items():
        base, added = pii.find(text)
        assert not base and [text[a:b] for _, a, b in added] == [want]
    for clean in ("look at the example. So", "one two and three", "Привет мир, как дела?", "at one dot", "[a] note", "é at è dot"):
        assert pii.find(clean) == ([], [])


def test_spoken_at_before_a_dotted_domain():
    for text, want in {
        "ask jane.doe at example.com now": "jane.doe at example.com", "jane_doe7 at mail.example.org.": "jane_doe7 at mail.example.org",
        "or mary-jane arroba example.es": "mary-jane arroba example.es", "mail: jane at example.com": "jane at example.com",
        "contact jane at example.com, please": "jane at example.com", "JANE.DOE AT EXAMPLE.COM": "JANE.DOE AT EXAMPLE.COM",
    }.items():
        base, added = pii.find(text)
        assert not base and [(k, text[a:b]) for k, a, b in added] == [("email", want)], text
        assert pii.masked(text) == text.replace(want, "[EMAIL]")
    for clean in (
        "look at example.com", "contact us at example.com", "the 5th at example.com", "COVID-19 at who.int", "version 2.0 at example.com",
        "we met at noon.Then we left", "jane.doe at home", "see a.b at c.1",
    ):
        assert pii.find(clean) == ([], []), clean
    big = "a.b at c.de " * 100_000
    start = time.time()
    assert len(pii.find(big)[1]) == 100_000 and time.time() - start < 20


def test_personal_data_is_linear():
    for big in ("a" * 10**6, "1" * 10**6, "1." * 500_000, "one " * 200_000, "@" * 500_000, "a at " * 200_000, "[at] " * 100_000, "+1 " * 200_000):
        start = time.time()
        pii.find(big)
        assert time.time() - start < 20


def test_personal_data_of_rows(odd, nothing):
    rows = pii.detect(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" for r in rows)
    assert pii.detect(nothing).count() == 0
    masked = pii.redact(odd.withColumn("text", F.lit("at a@b.co and 1.2.3.4, jоhn@exаmple.com"))).select("text", "home").distinct().collect()
    assert [(r.text, r.home) for r in masked] == [("at [EMAIL] and [IP], [EMAIL]", "!")]


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[-1] + 1))
    return min(row)


def test_leaks_equal_brute_force(spark, odd, nothing):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(12)] + [(50, "short one"), (51, None), (52, "  ")]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if i % 2:
            leak = list(rng.choice(items[:13])[1])
            for _ in range(rng.choice((0, 0, 1, 4, 9, 20))):
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice(([], ["z"], [leak[k], "y"]))
            text += ("\n" if i % 3 else " ") + ("".join(leak).upper() if i % 5 == 0 else "".join(leak)) + "  " + word()
        docs.append((i, text))
    want = {}
    for d, t in docs:
        for k, item in items:
            f = leaks.fold(item or "")
            most = int(leaks.ERROR_RATE * len(f)) if len(f) >= leaks.MIN_CHARS else 0
            if f and (best := least_edits(f, leaks.fold(t))) <= most:
                want[d, k] = best
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (leaks.BLOCK_CHARS, 200):
        got = leaks.find_leaks(frame, table, block_chars=block).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want)
    for r in got:
        if r.distance == 0:
            assert leaks.fold(dict(docs)[r.doc_id][r.start : r.end]) == leaks.fold(dict(items)[r.item_id])
    clean = leaks.without_leaks(frame, table, block_chars=200)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks.find_leaks(odd, table).count() == 0 and leaks.without_leaks(odd, table).count() == len(ODD)
    assert leaks.find_leaks(nothing, table).count() == 0 and leaks.find_leaks(odd, table.limit(0)).count() == 0


def test_items_without_an_id_or_with_the_same(spark):
    a, b, c = ("what is the height of the tower %s in metres above the sea" % w for w in ("alpha", "of beta town", "gamma"))
    docs = spark.createDataFrame([(1, f"x {a} y {b}"), (2, f"so {c}"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (7, b), (None, c), (None, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in leaks.find_leaks(docs, items).collect()}
    at = 2 + len(a) + 3
    exact = {(1, 7, 0, 2, 2 + len(a)), (1, 7, 0, at, at + len(b)), (2, None, 0, 3, 3 + len(c))}
    assert exact == {r for r in got if r[2] == 0}
    assert {r.doc_id for r in leaks.without_leaks(docs, items).collect()} == {3}


def varied(seed, n, vocabulary):
    """Documents with shared passages, repeats, runs and near copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghéij") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 70))] for _ in range(8)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            c = rng.random()
            if c < 0.5:
                w += [rng.choice(words) for _ in range(rng.randint(0, 60))]
            elif c < 0.8:
                p = rng.choice(passages)
                w += p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
            elif c < 0.9:
                w += [rng.choice(words)] * rng.randint(1, 60)
            else:
                w += [rng.choice(words) for _ in range(rng.randint(1, 4))] * rng.randint(1, 20)
        text = " ".join(w)
        if docs and rng.random() < 0.15:
            text = rng.choice(docs)[1]
        elif docs and rng.random() < 0.15 and (text := rng.choice(docs)[1]):
            k = rng.randrange(len(text))
            text = text[:k] + "zz" + text[k + 1 :]
        docs.append((i * 3 + 1, text))
    docs += [(9 * 10**5 + i, " ".join(words[:1] * n)) for i, n in enumerate((20, 21, 25, 40))]  # hardly a symbol
    return [*docs, (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n ")]


REPEATS = (
    (recompression, brute.word_repeats, ("n_words", "n_removed", None, "kept_sha256")),
    (suffixes, brute.byte_repeats, ("n_bytes", "n_removed", "n_spans", "kept_sha256")),
)


@pytest.mark.parametrize("seed,n,vocabulary,bucket", [(1, 60, 60, 2000), (2, 60, 500, 3000), (3, 40, 3, 10**6)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, n, vocabulary, bucket):
    docs = varied(seed, n, vocabulary)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(repeats, "RANGES", 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for module, plain, names in REPEATS:
        got = {r.doc_id: r for r in module.query(frame).collect()}
        want = plain(docs)
        assert len(got) == len(want)
        for d, w in want.items():
            assert all(name is None or got[d][name] == v for name, v in zip(names, w)), d


@pytest.mark.parametrize("module,plain,names", REPEATS[:1])
def test_crowded_anchors_spread_and_equal_brute_force(spark, monkeypatch, module, plain, names):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(40)]
    near = [[word() for _ in range(12)] for _ in range(3)]  # surroundings that come again
    docs = [(i, " ".join([word() for _ in range(30)] + rng.choice(near) + passage + rng.choice(near) + [word() for _ in range(30)])) for i in range(90)]
    docs += varied(12, 40, 60)[:-3]
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs)
    for crowd in (1, 4):
        got = {r.doc_id: r for r in repeats.find_repeats(frame, module.RULE, crowd=crowd).collect()}
        for d, w in want.items():
            assert (got[d].n_units, got[d].n_removed, got[d].kept_sha256) == (w[0], w[1], w[3]), d
    # The open groups of one anchor, by hand: its windows go to more than one bucket.
    text = [t.encode() for _, t in docs[:90]]
    units, bounds = module.RULE.units(text)
    g = module.RULE.groups(units, bounds)
    keys, counts = np.unique(g.key, return_counts=True)
    at = np.flatnonzero(g.key == keys[counts.argmax()])
    opened = {"doc": g.doc[at], "start": g.start[at], "n": g.n[at], "key": g.key[at]}
    found = pd.DataFrame({"home": [0], "open": [2], "payload": [repeats.pack(repeats._OPEN, opened, np.arange(len(at)))]})
    step = repeats._cover(module.RULE, 50)((0,), pd.DataFrame({"doc_id": range(90), "text": text}), found)
    buckets = step["bucket"].dropna()
    assert buckets.nunique() > 3 and (buckets < 0).all()


def by_hand(docs, rule, n=3):
    """The steps of ``find_repeats`` without Spark."""
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([(t or "").encode() for _, t in docs], pa.binary())], names=["doc_id", "text"])

    def grouped(frames, key):
        return pd.concat([pd.DataFrame({key: [], "payload": []}), *frames]).groupby(key)

    sent = grouped([b.to_pandas() for b in repeats._sender(rule, n, n, None)(iter([batch]))], "bucket")
    found = dict(list(grouped([repeats._settle(n, n)((int(k),), g) for k, g in sent], "home")))
    none = pd.DataFrame({"home": [], "open": [], "payload": []})
    frame = pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [(t or "").encode() for _, t in docs]})
    frame["home"] = np.mod(repeats.spark_hash(frame["doc_id"].to_numpy()), n)
    step = pd.concat([repeats._cover(rule, n)((h,), g, found.get(h, none)) for h, g in frame.groupby("home")])
    windows = step[step["payload"].notna()]
    late = dict(list(grouped([repeats._settle_windows(rule, n)(g) for _, g in windows.groupby("bucket")], "home")))
    waiting = step[step["text"].notna()]
    rest = [repeats._finish(rule)((h,), g, late.get(h, none)) for h, g in waiting.groupby("home")]
    done = pd.concat([step[step["kept_sha256"].notna()], *rest])
    return {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in done.itertuples()}


@pytest.mark.parametrize("chunk", [150, 600, 5000])
def test_long_documents_are_read_in_parts(monkeypatch, chunk):
    docs = varied(8, 50, 40)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(recompression, "PIECE", 100)
    for module, plain, names in REPEATS[:1]:
        want = plain(docs)
        for d, row in by_hand(docs, module.RULE).items():
            assert all(name is None or a == b for name, a, b in zip(names, row, want[d])), d


def test_contents_are_told_apart_by_all_bits():
    one = np.array([1, 1], np.uint64)
    content = np.array([5, 5 + (1 << 50)], np.uint64)
    groups = repeats.Groups(np.array([0, 1]), np.array([0, 0]), np.array([1, 1]), one, content, one)
    rule = repeats.Rule(2, lambda raws: (np.arange(4), np.array([0, 2, 4])), lambda units, bounds: groups, len, None, None)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([b"ab", b"cd"])], names=["doc_id", "text"])
    sent = pd.concat([b.to_pandas() for b in repeats._sender(rule, 1, 1, None)(iter([batch]))])
    found = repeats._settle(1, 1)((0,), sent)
    assert len(found) and all(found["open"])  # neither came before


def test_spark_hash(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 12345678901]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x long").select(F.xxhash64("x")).collect()]
    assert repeats.spark_hash(np.array(ids)).tolist() == want


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs = []
    for g in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(6, 200))]
        for c in range(rng.choice((1, 2, 12))):
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "zz" + str(rng.randint(0, 99))
            docs.append((len(docs) * 7 + 3, " ".join(words).title() if c % 3 == 0 else "\n".join(words)))
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b"), (10**6 + 3, "A  B"), (10**6 + 4, "a b c"), (10**6 + 5, docs[0][1])]
    want = brute.components(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for block in (neardup.BLOCK, 500):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: r for r in neardup.query(frame).collect()}
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_from_80_percent_on(spark):
    docs, want = [], set()
    for k, share in enumerate((0.78, 0.8, 0.81, 0.83, 0.845, 0.86)):
        words = [f"w{k}x{i}" for i in range(1004)]  # 1000 shingles, of which the copy has so many that the share is met
        both = -(-round(2000 * share * 1000) // (1000 + round(share * 1000)))
        copy = words[: both + 4] + [f"y{k}x{i}" for i in range(1000 - both)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} | ({2 * k + 1} if share < 0.8 else set())
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    assert {r.doc_id for r in neardup.find_groups(frame, 80).filter("kept").collect()} == want
    assert sum(r.kept for r in neardup.query(frame).collect()) == 11  # the query has 85


def test_deduplication_of_odd_rows(odd, nothing):
    for query in (neardup.query, recompression.query, suffixes.query):
        rows = query(odd).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
        assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1  # repeated rows alike
        assert query(nothing).count() == 0
    assert all(r.n_removed == 0 for r in recompression.query(odd).collect() if r.doc_id is None)
    assert all(r.kept and r.component_id is None for r in neardup.query(odd).collect() if r.doc_id is None)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 65536, (200, neardup.PLACES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.PLACES, neardup.DISTANCE, replace=False)
        row[at] = row[at] + 1
    assert all(set(x) & set(y) for x, y in zip(neardup.keys(a).tolist(), neardup.keys(b).tolist()))


def test_sum_product_is_exact():
    rng = np.random.default_rng(7)
    parent = np.array([-1, 0, 0, 1, 1, 2, 3])
    depth = np.array([0, 1, 1, 2, 2, 2, 3])
    leaf = np.array([0, 0, 0, 0, 1, 1, 1])
    unary, couple = rng.normal(size=7), rng.normal(size=(2, 2, 2))
    f = extraction.Forest(parent, leaf, [np.flatnonzero(depth == d) for d in (1, 2, 3)], np.zeros((7, 0)))
    weight = {}
    for s in itertools.product((0, 1), repeat=7):
        weight[s] = np.exp(sum(unary[i] * s[i] for i in range(7)) + sum(couple[leaf[i], s[parent[i]], s[i]] for i in range(1, 7)))
    want = [sum(w for s, w in weight.items() if s[i]) / sum(weight.values()) for i in range(7)]
    got, pairs = extraction.sum_product(f, unary, couple)
    assert np.allclose(got, want)
    assert np.allclose(pairs[6, 1, 1], sum(w for s, w in weight.items() if s[6] and s[3]) / sum(weight.values()))


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extraction.query(pages).collect()}
    right = 0
    for r in pages.collect():
        nodes = parse(r.html)
        want = "\n".join(n.text for n, inside in zip(nodes, extraction.marked(nodes)) if n.leaf and inside)
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right >= 0.95 * len(got)
    rows = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>"), (2, "u", "<p>"), (3, None, "<script>a</p>")], "page_id long, url string, html string")
    assert [r.text for r in extraction.query(rows.withColumn("text", F.lit(1))).collect()] == [""] * 5
    assert extraction.query(pages.limit(0)).count() == 0


def test_made_layouts_are_read():
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("aeioulnrst"), 4)) for _ in range(n)) + "."
    raw = ["<body><nav><a>x</a></nav><article>" + "".join(f"<p>{words(int(rng.integers(5, 60)))}</p>" for _ in range(5)) + "</article></body>" for _ in range(60)]
    model = extraction.train(extraction.labelled(raw))
    page = (
        '<header class="site-header"><a href=/>Site</a></header><nav><a>Home</a> <a>News</a></nav><div id="content"><h1>Title of it</h1>'
        "<p>First paragraph of <b>the</b> story,\n with some words in it.</p><div class=ad>Buy cheap things here.</div><p>Second one &amp; here too, it says so again.</p></div>"
        '<section id="comments"><h3>Comments</h3><p>I think this is a great story, thanks.</p></section><footer>&copy; 2020</footer>'
    )
    nodes = parse(page)
    text = [n.text for n, p in zip(nodes, model.marginals([nodes])) if n.leaf and p >= 0.5]
    assert "First paragraph of the story, with some words in it." in text and "Second one & here too, it says so again." in text
    assert not any(w in " ".join(text) for w in ("Home", "cheap", "great story", "2020"))


def test_reading_html():
    texts = lambda h: [n.text for n in parse(h) if n.leaf]
    assert texts("<p>a<b>b</b>c<br>d<p>e &lt;x&gt; <!-- no --> f<script>var t='</p>'</script></div>g") == ["abc d", "e <x> fg"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("a < b <1 <p title='>'>c") == ["a < b <1", "c"]
    for big in ("<div>" * 20000, "<" * 200_000, "</p>" * 100_000, "<p>x" * 50_000, "<a b='" * 20_000, "<!--" * 50_000):
        start = time.time()
        parse(big)
        assert time.time() - start < 20


def test_a_head_without_end_tags():
    texts = lambda page: [n.text for n in parse(page) if n.leaf]
    assert texts("<html><head><title>T</title><meta charset=x><style>a</style><article><p>One</p></article>") == ["One"]
    assert texts("<html><head><title>T</title> Two <b>three</b>") == ["Two three"]
    assert texts("<html><head><title>T</title><template><p>no</p></template></head><body><p>Four</p></body>") == ["Four"]


def test_toxicity_on_held_out_rows():
    rng = random.Random(9)
    syllables = ["th", "er", "an", "on", "in", "re", "ed", "nd", "ti", "es", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    insults = ["blockhead", "dumbo", "fungus", "gasbag"]

    def text(bad):
        words = [word() for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    rows = [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.train(rows[:450])
    score = lambda t: model.score(np.array([toxicity.features(model.margins(toxicity.words_of(t)).tolist() if toxicity.words_of(t) else [])]))[0]
    assert sum((score(t) >= 0.5) == y for t, y in rows[450:]) >= 145
    assert score("and the blxockhead is a fun-gus and gasbbag of d.u.m.b.o") > 0.5 > score(text(False))
    assert toxicity.train([("a b", 1)]) is None and toxicity.train([]) is None


def test_toxicity_of_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.query(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.query(nothing, labels).count() == 0
    assert {r.score for r in toxicity.query(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.reject(odd, labels.limit(0)).columns == odd.columns


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append(docs)
    assert all(k.columns == list(pipeline.COLUMNS) for k in kept[:-1])
    toxic, unique, clean, masked, mixed = ({r.doc_id: r.text for r in k.collect()} for k in kept)
    score = {r.doc_id: r.predicted for r in toxicity.query(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(toxic) == {d for d, p in score.items() if not p}
    groups = brute.components(list(toxic.items()), 80)
    assert set(unique) == {d for d, (_, root) in groups.items() if d == root}
    items = [leaks.fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, t in unique.items() if any(i in leaks.fold(t) for i in items)}
    assert exact and not exact & set(clean) and len(unique) - len(clean) <= len(exact) + 1
    assert set(masked) == set(clean) and all(pii.find(t)[0] == [] for t in masked.values())
    assert set(mixed) <= set(masked) and all(masked[d] == t for d, t in mixed.items())
    assert mixed
