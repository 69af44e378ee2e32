"""Names of interior symbols: alike wherever a window stands, of growing length, and what is exchanged."""

import random

import brute
import numpy as np
import pytest
from test_llm import by_hand, varied

from veilframe.llm import recompression


def parsed(texts):
    words, bounds = recompression._units([t.encode() for t in texts])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(words)) + recompression.WINDOW <= bounds[1:][doc])
    return words, bounds, at


def test_equal_windows_share_the_name_of_a_symbol_of_the_last_level():
    rng = random.Random(3)
    word = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    passage = word(60)
    words, bounds, at = parsed([f"{word(rng.randint(0, 30))} {passage} {word(rng.randint(0, 30))}" for _ in range(30)])
    begin, name = recompression.anchors(words, bounds, at)
    seen = {}
    for i, a in enumerate(at.tolist()):
        found = seen.setdefault(tuple(words[a : a + 20].tolist()), (name[i], begin[i] - a))
        assert found == (name[i], begin[i] - a) and 0 <= begin[i] - a < 20
    fresh = np.zeros(len(words), bool)
    fresh[bounds[:-1]] = True
    levels = list(recompression.parse(words, fresh, at.astype(np.int32), at.astype(np.int32) + np.int32(20)))
    assert len(levels) == recompression.ROUNDS
    assert len(levels[-1].window) > 0.99 * len(at)
    assert np.diff(levels[-1].start).max() > 5  # no limit on what a symbol stands for
    last = levels[-1]
    assert (last.start[last.low] >= at[last.window]).all()
    ends = np.append(last.start, len(words))[last.high]
    assert (ends <= at[last.window] + 20).all()
    # The names that copies share are those of the last level.
    shared = {name[i] for i in range(len(at)) if i in set(last.window.tolist())}
    assert len(shared) < len(last.window) / 5


@pytest.mark.parametrize("rounds", [1, 3, 12])
def test_the_number_of_rounds_leaves_the_result_alone(monkeypatch, rounds):
    monkeypatch.setattr(recompression, "ROUNDS", rounds)
    docs = varied(31, 50, 50)
    want = brute.word_repeats(docs)
    for d, (n, removed, spans, digest) in by_hand(docs, recompression.RULE).items():
        assert (n, removed, spans, digest) == want[d]
