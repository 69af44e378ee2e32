"""Substring deduplication by recompression: words of 20-word windows that also start earlier.

The corpus of words is rewritten in rounds. The first names runs of two to four
equal words; each further one splits the symbols at random (by a bit of their
names) into left and right ones and names every pair of a left and a right
neighbour. Names are fingerprints of what they
stand for, so they are the same all over the corpus without an exchange, and
equal passages are parsed alike except at their edges.

Which symbols of a window are sure to be the same wherever the window occurs
follows from the window alone: at its left edge a symbol of the right kind might
be taken by a neighbour outside, at its right edge one of the left kind. What is
inside is *interior*. A window's anchor is the longest interior symbol of its
highest round, of least name among alike ones, and this name is what is exchanged: windows meet
in the bucket of the name they share, which reveals repeats, and fingerprints of
the words around it verify those. Symbols may grow to any length; there are four
levels, since in the fourth every window of prose still has an interior symbol, in
the sixth 95 % and in the eighth 15 % have one. A window
without any symbol, inside a long run of one word, is named by its first word. See
``repeats`` for the exchange.

Defined cases: null texts have no words; rows with a null id are kept whole and
compared with nothing; repeated rows get the same result, as if the row stood
once, and rows that share an id but not the text are judged by the findings of
either; an empty table gives an empty one; further columns are not looked at.
Among equal windows the first by (id, place) stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from veilframe.llm.repeats import Groups, Hashes, Rule, U, find_repeats, mixed

WINDOW = 20
#: Levels of symbols: runs, then pairs, pairs of these and so on.
ROUNDS = 4
#: Most words of a named run.
RUN = 4

_BYTE = mixed(np.arange(1001, 1257, dtype=U))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes whose words are hashed at a time.
PIECE = 1 << 20


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each word, and where it begins."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    start, end = edge[::2], edge[1::2]
    if len(data) <= 2 * PIECE:
        return Hashes(_BYTE[np.frombuffer(data, np.uint8)]).of(start, end), start
    out, first = np.empty(len(start), U), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + PIECE, side="right")))
        low = start[first]
        out[first:last] = Hashes(_BYTE[np.frombuffer(data, np.uint8)[low : end[last - 1]]]).of(start[first:last] - low, end[first:last] - low)
        first = last
    return out, start


def _units(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, start = word_hashes(b" ".join(raws))
    return words, np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raws]]))


def _named(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mixed(a * U(0xD6E8FEB86659FD93) + mixed(b + U(salt)))


def _indexed(new: np.ndarray) -> np.ndarray:
    """For each symbol, and for the end, its number in the next round."""
    return np.append(np.cumsum(new, dtype=np.int32) - np.int32(1), np.int32(new.sum()))


@dataclass(frozen=True)
class Level:
    """The symbols of a round: names and first words; and of the windows that have interior ones
    (by their index) the first and last + 1 of these."""

    name: np.ndarray
    start: np.ndarray
    window: np.ndarray
    low: np.ndarray
    high: np.ndarray


def parse(words: np.ndarray, fresh: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[Level]:
    """The rounds over windows [low, high) of words, while any has an interior symbol.
    ``fresh`` marks the words that begin a document."""
    n = len(words)
    # Runs. What of a run is seen in a window tells how it is parsed only if it is too long for a name.
    begin = fresh.copy()
    begin[1:] |= words[1:] != words[:-1]
    first = np.flatnonzero(begin).astype(np.int32)
    run = _indexed(begin)[:-1]
    count = np.diff(np.append(first, np.int32(n)))
    short = (count >= 2) & (count <= RUN)
    new = begin | ~short[run]
    index = _indexed(new)
    run_end, run_begin = (first + count)[run], first[run]
    edge = np.minimum(run_end[low], high)
    sure_low = np.where(edge - low > RUN, low, edge)
    edge = np.maximum(run_begin[high - 1], low)
    sure_high = np.where(high - edge > RUN, high, edge)
    low, high = index[sure_low], index[sure_high]
    name = np.where(short[run], _named(words, count[run].astype(U), 1), words)[new]
    start = np.flatnonzero(new).astype(np.int32)
    fresh = fresh[start]
    window = np.arange(len(low), dtype=np.int32)
    for k in range(1, ROUNDS + 1):
        some = low < high
        window, low, high = window[some], low[some], high[some]
        if not len(window):
            return
        yield Level(name, start, window, low, high)
        left = (mixed(name + U(k * 7919)) & U(1)).astype(bool)
        take = np.zeros(len(name), bool)
        take[:-1] = left[:-1] & ~left[1:] & ~fresh[1:]
        new = np.ones(len(name), bool)
        new[1:] = ~take[:-1]
        index = _indexed(new)
        # A right symbol at the left edge may be taken, and a left one at the right edge may take.
        low, high = index[low + ~left[low]], index[high - left[high - 1]]
        pair = np.flatnonzero(take)
        name = name.copy()
        name[pair] = _named(name[pair], name[pair + 1], k + 1)
        name, start, fresh = name[new], start[new], fresh[new]


def _least(level: Level) -> np.ndarray:
    """Of each window the longest interior symbol, of least name among these, the first of alike ones."""
    bits = U((1 << 24) - 1)
    length = np.diff(np.append(level.start, level.start[-1:] + 1))
    rank = (mixed(level.name) >> U(5)) | (U(31) - np.minimum(length, 31).astype(U)) << U(59)
    rank = (rank & ~bits) | np.arange(len(level.name), dtype=U)
    least = [rank]
    for k in range(4):
        later = np.full(len(rank), np.iinfo(U).max, U)
        later[: max(0, len(rank) - (1 << k))] = least[-1][1 << k :]
        least.append(np.minimum(least[-1], later))
    step = np.array([0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4], np.int64)[level.high - level.low]
    table, row = np.concatenate(least), step * len(rank)
    return (np.minimum(table[row + level.low], table[row + level.high - (1 << step)]) & bits).astype(np.int64)


def anchors(words: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (by its first word) where its anchor begins, and the anchor's name."""
    fresh = np.zeros(len(words), bool)
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    first = at.astype(np.int32)
    begin, name = at.astype(np.int64), words[at]
    for k, level in enumerate(parse(words, fresh, first, first + np.int32(WINDOW))):
        best = _least(level)
        begin[level.window], name[level.window] = level.start[best], mixed(level.name[best] + U(k))
    return begin, name


def _groups(words: np.ndarray, bounds: np.ndarray) -> Groups:
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(np.arange(len(words)) + WINDOW <= bounds[1:][doc])
    begin, name = anchors(words, bounds, at)
    hashes = Hashes(words)
    first = np.ones(len(at), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(first)
    n = np.diff(np.append(i, len(at)))
    start, begin, name = at[i], begin[i], name[i]
    content = mixed(hashes.of(start, start + n + WINDOW - 1) + ((begin - start) * 1024 + n).astype(U))
    return Groups(doc[start], start - bounds[:-1][doc[start]], n, name, content, name)


def _pieces(raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    words = raw.split()  # bytes are split at the same six blanks
    return [b" ".join(words[a:b]) for a, b in zip(starts, ends, strict=True)]


def _kept(raw: bytes, covered: np.ndarray | None) -> bytes:
    words = raw.split()
    return b" ".join(words if covered is None else [w for w, c in zip(words, covered.tolist(), strict=True) if not c])


RULE = Rule(WINDOW, _units, _groups, lambda raw: len(raw.split()), _pieces, _kept)


def query(docs: DataFrame) -> DataFrame:
    return find_repeats(docs, RULE).drop("n_spans").withColumnRenamed("n_units", "n_words")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
word AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS v FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS t
         FROM word ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
