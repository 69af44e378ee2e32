"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with up to k character edits. Cut into k + 1
pieces, at least one piece then stands there unchanged. One automaton over the
pieces of a block of items finds all exact piece hits of a text in a single
pass; around each hit Myers' bit-parallel distance, with the item as one wide
bit vector, decides. Matching is on lower-cased text with runs of white space
as one blank; offsets are mapped back to the source.

The items are the query set: they are taken to the driver in blocks of bounded
characters, one after the other, and each block runs against all documents,
which stay where they are. Nothing is shuffled and no pair is emitted but leaks.

Defined cases: items of null or blank text are no items; one with a null id is
reported with it, and texts under one id each by themselves; items shorter than
``min_chars`` after folding are matched exactly as long as they have a letter;
null texts have no leaks; null ids and repeated rows each have their own
result rows; empty tables give an empty one; further columns are not looked at.
An item that occurs several times in a document is reported once, at the first
place of least distance.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Shorter items have to match exactly: a few characters with edits are found anywhere.
MIN_CHARS = 50
#: Characters of the items that are on the driver, and in one automaton, at a time.
BLOCK_CHARS = 4_000_000

_BLANKS = re.compile(r"\s+")


def fold(text: str) -> str:
    return _BLANKS.sub(" ", text.lower()).strip()


def folded_offsets(text: str) -> tuple[str, list[int]]:
    """The text as :func:`fold` gives it, and the source place of each of its characters."""
    lowered = text.lower()  # as a whole: a letter's form may depend on those around it, its length does not
    out, at, gap, low = [], [], False, 0
    for i, c in enumerate(text):
        high = low + len(c.lower())
        if c.isspace():
            gap = bool(out)
        else:
            if gap:
                out.append(" ")
                at.append(i - 1)
                gap = False
            out += lowered[low:high]
            at += [i] * (high - low)
        low = high
    return "".join(out), at


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors + 1`` pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def myers(item: str, window: str, most: int, masks: dict[str, int]) -> tuple[int, int] | None:
    """Least edit distance of the item to a part of the window, and where that part ends.

    ``masks`` has for each character of the item the bits of its places. None
    if the distance is over ``most``.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end, n = most + 1, 0, len(window)
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, j
        if score - (n - j) >= best:  # what is left cannot improve on it
            break
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d | hp)), hp & d
    return (best, end) if best <= most else None


def anchored(item: str, back: str, distance: int, masks: dict[str, int]) -> int:
    """The length of the shortest beginning of ``back`` at ``distance`` edits from the whole item: the same
    bit vectors, with the first row counting up instead of free."""
    m = len(item)
    if m <= distance:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for j, c in enumerate(back, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | (full & ~(d | plus)), plus & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score <= distance:
            return j
        hp, hn = ((hp << 1) | 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d | hp)), hp & d
    return len(back)


#: Places of one piece in an item that are looked at one by one; more are one stretch.
FEW_PLACES = 8


def _stretches(places: list[int]) -> list[tuple[int, int]]:
    return [(p, p) for p in places] if len(places) <= FEW_PLACES else [(min(places), max(places))]


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int) -> None:
        self.items, self.masks, self.most = [], [], []
        places: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:  # items are told apart by their place: ids may repeat or be null
            errors = int(rate * len(text)) if len(text) >= min_chars else 0
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            for at, piece in pieces(text, errors):
                places[piece][len(self.items)].append(at)
            self.items.append((item_id, text))
            self.masks.append(dict(masks))
            self.most.append(errors)
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), [(k, a, b) for k, all_ in where.items() for a, b in _stretches(all_)]))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """By the place of an item in the block its least distance and the end of its first such place in the folded text."""
        if not self.items:
            return {}
        wanted: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for k, a, b in where:
                wanted[k].add((end + 1 - length - b, end + 1 - length - a))  # between which the item would begin
        out = {}
        for k, begins in wanted.items():
            item, most, found = self.items[k][1], self.most[k], None
            for low, high in _windows(begins, len(item), most):
                window = text[low:high]
                if self.hopeful(item, window, most):
                    hit = myers(item, window, most, self.masks[k])
                    if hit and (found is None or hit[0] < found[0]):
                        found = (hit[0], low + hit[1])
                        if hit[0] == 0:
                            break
            if found:
                out[k] = found
        return out

    @staticmethod
    def hopeful(item: str, window: str, most: int) -> bool:
        """Whether the counts of characters allow it: each edit mends at most one lacking one."""
        if len(window) < len(item) - most:
            return False
        lacking = len(item)
        for c in set(item):
            lacking -= min(item.count(c), window.count(c))
        return lacking <= most


def _windows(begins: set[tuple[int, int]], length: int, most: int) -> Iterator[tuple[int, int]]:
    """The parts of a text in which an item of so many characters may stand, those that overlap as one."""
    low = high = None
    for first, last in sorted(begins):
        a, b = max(0, first - most), last + length + most
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


LEAKS = "doc_id long, item_id long, distance int, start int, end int"
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_made: dict[str, Matcher] = {}


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, at most ``block_chars`` characters of them on the driver at a time."""
    rows = items.filter("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    block, size = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        folded = fold(text)
        if not folded:
            continue
        if block and size + len(folded) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, folded))
        size += len(folded)
    if block:
        yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and the place in code points of every leaked item."""
    spark, parts = docs.sparkSession, []
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    for block in _blocks(items, block_chars):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared, key, rate, min_chars)
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = matcher.find(fold(text)) if text else {}
                    if hits:
                        found += _placed(doc_id, text, hits, matcher)
                yield pa.RecordBatch.from_pylist(found, schema=_LEAKS)

        parts.append(rows.mapInArrow(run, LEAKS))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], LEAKS)


def without_leaks(
    docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in whose text no item stands, with all their columns."""
    for block in _blocks(items, block_chars):
        docs = docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, rate, min_chars), docs.schema)
    return docs


def _filter(shared: Broadcast, key: str, rate: float, min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, key, rate, min_chars)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not (t and matcher.find(fold(t))) for t in texts], pa.bool_()))

    return run


def _matcher(shared: Broadcast, key: str, rate: float, min_chars: int) -> Matcher:
    """The automaton of a block; a worker keeps those it has met."""
    if key not in _made:
        if len(_made) >= 4:
            _made.clear()
        _made[key] = Matcher(shared.value, rate, min_chars)
    return _made[key]


def _placed(doc_id: int | None, text: str, hits: dict[int, tuple[int, int]], matcher: Matcher) -> list[dict]:
    """The result rows of a document; the start comes from matching the reversed item backwards."""
    folded, source = folded_offsets(text)
    out = []
    for k, (distance, end) in hits.items():
        item_id, text = matcher.items[k]
        item = text[::-1]
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            masks[c] |= 1 << i
        back = folded[max(0, end - len(item) - distance) : end][::-1]
        length = anchored(item, back, distance, masks)
        start = source[max(0, end - length)] if length else source[end - 1]
        out.append({"doc_id": doc_id, "item_id": item_id, "distance": distance, "start": start, "end": source[end - 1] + 1})
    return out


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_leaks(docs, items)
