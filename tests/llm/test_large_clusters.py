"""Near duplicates among texts that a template holds together."""

import random
import time

import brute
import numpy as np

from veilframe.llm import neardup

RARE = [f"w{i}" for i in range(40_000)]


def templated(rng, n, own, common):
    """Texts of a common template and words of their own: about 0.3 similar to each other."""
    return [" ".join(common + rng.choices(RARE, k=own)) for _ in range(n)]


def texts(n, seed=1):
    rng = random.Random(seed)
    common = [f"t{i}" for i in range(60)]
    docs = list(enumerate(templated(rng, n, 70, common)))
    for k in range(n // 10):  # near copies among them, in chains
        base = docs[rng.randrange(len(docs))][1].split()
        base[rng.randrange(len(base))] = "edited"
        docs.append((len(docs) + 1000, " ".join(base)))
    return docs


def test_templates_do_not_hold_clusters_together(spark, monkeypatch):
    docs = texts(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    want = brute.components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.query(frame).collect()}
    assert got == want
    assert sum(d == c for d, (_, c) in want.items()) < len(docs)
    prepared = neardup.prepared(frame)
    members = spark.createDataFrame([(d, n, 0) for d, (n, _) in want.items()], "rep long, n long, cluster long")
    parts = {r.rep: r.cluster for r in neardup.divided(prepared, members, 85).collect()}
    for d, (_, c) in want.items():  # linked texts stay together
        assert d == c or parts[d] == parts[c]
    sizes = np.unique(list(parts.values()), return_counts=True)[1]
    assert sizes.max() < 30  # the template alone keeps nobody


def test_first_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 15)), dtype=np.uint64)]))
        often = np.sort(rng.permutation(a)[: len(a) // 2])
        counts = rng.integers(1, 9, len(often))
        both = len(np.intersect1d(a, b))
        for percent in (80, 85):
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(neardup.first_shingles(a, often, counts, percent), neardup.first_shingles(b, often, counts, percent)))


def test_time_grows_with_the_rows(spark, monkeypatch):
    """A template at similarity 0.3 makes one cluster of candidates; four times the texts take about four times as long."""
    monkeypatch.setattr(neardup, "BLOCK", 20_000)

    def seconds(n):
        frame = spark.createDataFrame(list(enumerate(templated(random.Random(n), n, 70, [f"t{i}" for i in range(60)]))), "doc_id long, text string").repartition(8).cache()
        frame.count()
        start = time.time()
        assert neardup.query(frame).filter("kept").count() == n
        return time.time() - start

    seconds(300)
    few, many = seconds(1500), seconds(6000)
    assert many < 5 * few + 5, (few, many)
