"""The suffix sort: buckets of several sizes, ranges cut anywhere, frequent beginnings, blocks of strings."""

import random

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_llm import varied

from veilframe.llm import repeats, suffixes


def by_hand(docs, ranges, homes=3):
    """The steps of the query without Spark, and how many rows each bucket got."""
    frame = pd.DataFrame({"doc_id": [d for d, _ in docs], "text": [(t or "").encode() for _, t in docs]})
    batch = pa.RecordBatch.from_arrays([pa.array(frame["doc_id"], pa.int64()), pa.array(frame["text"], pa.binary())], names=["doc_id", "text"])
    none = pd.DataFrame({"bucket": [], "payload": []})
    sent = pd.concat([none, *[b.to_pandas() for b in suffixes._sender(ranges, homes)(iter([batch]))]])
    found = pd.concat([pd.DataFrame({"payload": []}), *[suffixes._settle(ranges.buckets, homes)((int(k),), g) for k, g in sent.groupby("bucket")]])
    done = suffixes._finish((0,), frame, found[found["payload"].notna()])
    return {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in done.itertuples()}, sent


def fingerprints(leads):
    """Of beginnings given as bytes."""
    units = np.frombuffer(leads.tobytes(), np.uint8)
    return repeats.Hashes(suffixes._BYTE[units]).windows(suffixes.BEGIN)[:: suffixes.BEGIN]


def leads(docs):
    units = np.frombuffer("".join(t or "" for _, t in docs).encode(), np.uint8)
    return np.sort(suffixes.leading(units, np.unique(suffixes.anchors(units, np.zeros(0, np.uint64))[0])))


@pytest.mark.parametrize("seed,vocabulary", [(21, 60), (22, 500), (23, 3)])
@pytest.mark.parametrize("chunk,strings", [(150, 300), (600, 50), (1 << 20, 1_000_000)])
def test_ranges_and_frequent_beginnings_leave_the_result_alone(monkeypatch, seed, vocabulary, chunk, strings):
    docs = varied(seed, 50, vocabulary)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixes, "STRINGS", strings)
    want, every = brute.byte_repeats(docs), leads(docs)
    found, count = np.unique(every, return_counts=True)
    for points, within, frequent in (
        (every[:0], 1, every[:0]), (np.unique(every[::40]), 1, every[:0]), (np.unique(every[::15]), 3, found[count > 2]), (every[:0], 2, found),
    ):
        got, _ = by_hand(docs, suffixes.Ranges(points, within, fingerprints(frequent)))
        assert got == want


def test_multikey_sort_equals_sorting_bytes():
    rng = random.Random(5)
    text = bytes(rng.choice(b"ab\x00\xff") for _ in range(400))
    units = np.frombuffer(text + bytes(8), np.uint8)
    at = np.array([rng.randrange(360) for _ in range(300)])
    part = np.array([rng.randrange(3) for _ in range(300)])
    length = np.array([3, 8, 21])[part]
    left, same = suffixes.multikey(units, at, length, part)
    key = [(part[i], text[at[i] : at[i] + length[i]]) for i in range(300)]
    assert [key[i] for i in left] == sorted(k for k in key if key.count(k) > 1)
    assert all((same[i] == same[i - 1]) == (key[left[i]] == key[left[i - 1]]) for i in range(1, len(left)))


def test_edges_of_a_frequent_passage_spread_over_the_buckets():
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(40)
    docs = [(i, noise(150) + passage + noise(150)) for i in range(200)]
    docs += [(i + 200, t) for i, (_, t) in enumerate(docs[:5])]
    raw = passage.encode()
    inside = np.array([raw[i : i + suffixes.BEGIN] for i in range(len(raw) - suffixes.BEGIN + 1)], suffixes._LEAD)
    most = []
    for frequent in (inside[:0], inside):
        ranges = suffixes.Ranges(np.unique(leads(docs)), 1, fingerprints(frequent))
        got, sent = by_hand(docs, ranges)
        assert got == brute.byte_repeats(docs)
        most.append(max(len(suffixes._unpacked(list(g["payload"]))[0]["doc"]) for k, g in sent.groupby("bucket") if k < ranges.buckets))
    assert most[0] >= 100 and most[1] <= most[0] / 3, most


def test_splitters_come_from_a_bounded_sample(spark, monkeypatch):
    same = "always the same long beginning of texts"
    docs = [*varied(24, 200, 300), *[(10**7 + i, f"{i} {same} {i * 7919} and further words that fill the text up to a window or more, {i}") for i in range(150)]]
    frame = repeats.prepared(spark.createDataFrame(docs, "doc_id long, text string"))
    monkeypatch.setattr(suffixes, "CROWD", 100)
    points, frequent = suffixes.splitters(frame, 6, len(docs))
    assert 0 < len(points) <= 5 and (np.sort(points) == points).all() and all(len(p) <= suffixes.BEGIN for p in points)
    assert set(fingerprints(np.array([same[:20].encode()], suffixes._LEAD)).tolist()) <= set(frequent.tolist())
    assert len(suffixes.splitters(frame, 1, len(docs))[0]) == 0
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(frame).collect()}
    assert got == brute.byte_repeats(docs)
