"""The inverted index, places in groups, and chat bodies of odd conversations."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from veilframe.operators import chat, search
from veilframe.operators.places import with_places

DOCS = "doc_id long, lang string, text string"


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "Other", "cat", "été", "x1", "über", "rare", "dog"]
    rows = [(i * 37, rng.choice(["en", "fr", None]), " ".join(rng.choices(words, [30, 5, 5, 3, 3, 2, .3, 5], k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(10**9, "en", None), (10**9 + 1, "en", "rare, RARE; rare-x1")]


def ranked(rows, query, lang=None):
    """BM25 by looking at every text."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = [(i, g, cut(t)) for i, g, t in rows]
    mean = sum(len(w) for *_, w in docs) / len(docs)
    out = {}
    for t in set(cut(query)):
        df = sum(t in w for *_, w in docs)
        idf = math.log(1 + (len(docs) - df + .5) / (df + .5))
        for i, g, w in docs:
            if t in w and (lang is None or g == lang):
                tf = w.count(t)
                out[i] = out.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(w) / mean))
    return sorted(((-round(s, 6), i) for i, s in out.items()))


@pytest.mark.parametrize("block_docs", [8, 100, 10_000])
def test_search_equals_scoring_every_text(spark, tmp_path, block_docs):
    rows = corpus(1, 400)
    index = search.build_index(spark.createDataFrame(rows, DOCS).repartition(4), str(tmp_path / "index"), 16, block_docs)
    for query, lang, size, page in (("rare CAT", None, 5, 1), ("the other", None, 7, 3), ("été über the", "fr", 10, 2), ("the", "en", 500, 1), ("none", None, 10, 1)):
        got = [(round(-r.score, 6), r.doc_id) for r in search.search_index(spark, index, query, lang, size, page).collect()]
        want = ranked(rows, query, lang)[(page - 1) * size : page * size]
        assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want))
    empty = search.build_index(spark.createDataFrame([], DOCS), str(tmp_path / "empty"))
    assert search.search_index(spark, empty, "the").count() == 0


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = search.build_index(spark.createDataFrame(corpus(2, 300), DOCS), str(tmp_path / "index"), 32, 50)
    rows = index.postings(spark, ["rare", "cat"])
    files = {r[0] for r in rows.select(F.input_file_name()).collect()}
    buckets = {re.search(r"bucket=(\d+)", f).group(1) for f in files}
    assert 1 <= len(buckets) <= 2
    plan = rows.select("block", "top")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan
    assert "docs" not in plan.split("ReadSchema")[1]  # bounds do not read the postings
    assert {r.term for r in rows.collect()} == {"rare", "cat"}


def test_whole_words_only(spark, tmp_path):
    rows = [(1, "en", "other mother"), (2, "en", "the end")]
    index = search.build_index(spark.createDataFrame(rows, DOCS), str(tmp_path / "index"))
    assert [r.doc_id for r in search.search_index(spark, index, "the").collect()] == [2]


def test_places_of_a_group_over_many_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 > 0, 1L, if(id % 2 = 0, null, id % 4)) AS g", "id * 7919 % 1000 AS k", "'t' AS s").unionAll(
        spark.range(500).selectExpr("1L", "cast(null as long)", "'same'")).repartition(6)
    got = with_places(rows, "g", ["k", "s"], parts=9).collect()
    for g in {r.g for r in got}:
        mine = sorted((r.place, r.k) for r in got if r.g == g) if g != 1 else sorted(((r.place, -1 if r.k is None else r.k) for r in got if r.g == g))
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)


ODD = [
    (1, None, "user", "no turn"), (1, 3, "user", "tied \"b\""), (1, 3, "user", "tied a"), (1, 3, "assistant", "x\n"), (1, 3, "assistant", "x\n"),
    (None, 0, "system", "prompt"), (None, 5, "user", "lost"), (2, 7, None, "no role"), (2, 8, "user", None), (3, 900_000, "system", "alone"),
]


@pytest.mark.parametrize("per_part", [1, 2, 1000])
def test_bodies_of_odd_conversations_are_json(spark, per_part):
    turns = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumn("_place", F.lit("!"))

    def bodies(build):
        parts = {}
        for r in sorted(build(turns, turns_per_part=per_part).collect(), key=lambda r: r.part):
            parts.setdefault(r.conv_id, []).append(r)
        for rows in parts.values():
            assert [r.part for r in rows] == list(range(len(rows))) and [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]
        return {c: json.loads("".join(r.body for r in rows)) for c, rows in parts.items()}

    first = bodies(chat.chat_payload_system_first)
    assert set(first) == {1, None, 2, 3}
    assert [m["content"] for m in first[1]["messages"]] == ["no turn", "x\n", "x\n", "tied \"b\"", "tied a"][:3] + ["tied \"b\"", "tied a"]
    assert [m["role"] for m in first[None]["messages"]] == ["system", "user"]
    assert first[2]["messages"] == [{"content": "no role"}, {"role": "user"}] and len(first[3]["messages"]) == 1
    field = bodies(chat.chat_payload_system_field)
    assert field[None]["system"] == "prompt" and [m["content"] for m in field[None]["messages"]] == ["lost"] and field[3]["messages"] == []
    last = bodies(chat.chat_payload_history_last)
    assert [m["parts"][0]["text"] for m in last[1]["history"]] == ["no turn", "x\n", "x\n", "tied \"b\""] and last[None]["history"] == []
    assert last[2]["history"] == [{"parts": [{"text": "no role"}]}]


def test_bloom_filter_of_a_column(spark):
    from veilframe.operators import bloom
    keys = spark.range(3000).selectExpr("concat('k', id) AS k")
    found = bloom.build(keys, F.col("k"))
    others = spark.range(20_000).selectExpr("concat('o', id) AS k")
    assert keys.where(~found.test(F.col("k"))).count() == 0
    assert others.where(found.test(F.col("k"))).count() < 1000
    nothing = bloom.build(keys.limit(0), F.col("k"))
    assert others.where(nothing.test(F.col("k"))).count() == 0


def test_bloom_filter_keeps_plans_short(spark):
    """Plans are written out as text on the driver: a bit a place, not a byte."""
    from veilframe.operators import bloom
    keys = spark.range(20_000).selectExpr("concat('k', id) AS k")
    found = bloom.build(keys, F.col("k"))
    assert len(found.places) == 1 << (found.power - 3)
    assert keys.where(found.test(F.col("k"))).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('x', id) AS k")
    assert others.where(found.test(F.col("k"))).count() < 2_000


def test_what_is_written_between_is_gathered_already(spark, tmp_path):
    """No row per term and document is written or exchanged: one per term, block and language."""
    search.build_index(spark.createDataFrame(corpus(3, 300), DOCS), str(tmp_path / "index"), 8, 50)
    counted = spark.read.parquet(str(tmp_path / "index/counts"))
    postings = spark.read.parquet(str(tmp_path / "index/postings"))
    assert counted.count() == postings.count() == postings.select("term", "block", "lang").distinct().count()
