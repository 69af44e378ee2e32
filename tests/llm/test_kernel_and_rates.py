"""The string kernel against every subsequence, bounds of learning, and rates that are too high."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing, toxicity


def weighted(word):
    """The subsequences of three characters of a marked word within the span, with their weights."""
    marked, out = f"^{word}$", {}
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i < toxicity.SPAN:
            key = marked[i] + marked[j] + marked[k]
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
    return out


def norm(word):
    marked = f"^{word}$"
    squares = sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(len(marked)), 3) if k - i < toxicity.SPAN)
    return math.sqrt(max(squares, 1.0))


def kernel(a, b):
    x, y = weighted(a), weighted(b)
    return sum(w * y[s] for s, w in x.items() if s in y) / norm(a) / norm(b)


def test_rows_multiply_to_the_kernel():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 12))) for _ in range(40)] + ["idiot", "idi.ot", "id1ot", "iddiot", "idt"]
    rows, _ = toxicity.dense(words)
    got = rows @ rows.T
    for (i, a), (j, b) in itertools.product(enumerate(words[:20] + words[-5:]), repeat=2):
        i, j = words.index(a), words.index(b)
        assert abs(got[i, j] - kernel(a, b)) < 1e-4


def test_margins_are_the_kernel_machine_over_the_landmarks():
    """A machine with a weight for each landmark says the same as the weights of subsequences that it amounts to."""
    rng = np.random.default_rng(4)
    landmarks = ["stupid", "moron", "garden", "window", "idiots"]
    alpha = rng.normal(size=len(landmarks))
    rows, every = toxicity.dense(landmarks)
    weights = np.zeros(toxicity._SIZE**3)
    weights[every] = alpha @ rows
    model = toxicity.Model(weights, 0.25, (1.0, 0.0, 0.0, 0.0))
    words = ["stuupid", "s-tupid", "moroon", "gardens", "wnidow", "other", "xy", "idiotss"]
    want = [sum(w * kernel(a, m) for w, m in zip(alpha, landmarks)) + 0.25 for a in words]
    assert np.allclose(model.margins(words), want, atol=1e-4)


def test_long_texts_are_learned_from_in_part(spark):
    docs = spark.createDataFrame([(i, "w " * 40_000 if i % 2 else "short") for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(1, 40)], "doc_id long, toxic int")
    texts = toxicity.sample(docs, labels, 100, 100)
    assert texts and max(len(t) for t, _ in texts) == toxicity.LEARN_CHARS and "short" in {t for t, _ in texts}


def test_a_rate_beyond_all_bounds_raises(spark):
    docs = spark.createDataFrame([(1, "a b", "tiny"), (2, "c " * 5000, "big")], "doc_id long, text string, source string")
    with pytest.raises(Exception, match="repeated more than"):
        mixing.mix(docs, epochs=1e12).count()
    assert mixing.mix(docs, {"tiny": 1.0}, epochs=0.01).agg(F.count("*")).first()[0] >= 0
