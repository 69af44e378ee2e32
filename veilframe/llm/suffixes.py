"""Suffix-array deduplication: bytes of 100-byte strings that also start earlier.

1. **Sampled suffixes.** Of the 20-byte beginnings in a 100-byte string the one of least hash
   is its anchor, so equal strings keep the same suffix; about one suffix in 38 bytes is left.
   Consecutive strings with one anchor are a *group*; its suffix travels with the bytes that
   these strings have before the anchor, 100 to 180 bytes in all.
2. **Splitters.** Suffixes are range-partitioned by their leading 20 bytes at quantiles of a
   sample drawn in the executors. A beginning that by the sample would fill a good part of a
   range is *frequent*: it ranks behind all others, so that strings at the edge of a frequent
   passage are anchored at what surrounds it, which spreads them over the ranges. Ranges are cut
   between different beginnings.
3. **Buckets** sort their suffixes by multikey quicksort, whose characters are eight bytes: parts
   that are equal so far are sorted by the next character, and what stands alone is left out.
   First the beginnings are sorted, then the whole contents of the groups that share one: of equal
   groups the first in the corpus stays. Where groups of different content share a beginning,
   their 100-byte strings are sorted alike, in blocks of a bounded number.
4. Findings return to their documents, which are hashed without the removed bytes.

Hashes only choose anchors and places; what is removed was equal byte by byte. Ranges hold all
suffixes of a beginning, so no equal strings lie on two sides of a boundary. A task settles
the repeats among its own texts first, so a hot passage sends a record for each few megabytes.

Defined cases: null texts are empty; rows with a null id are kept whole and
compared with nothing; repeated rows get the same result, as if the row stood
once, and rows that share an id but not the text are judged by the findings of
either; an empty table gives an empty one; further columns are not looked at.
Among equal strings the first by (id, place) stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import repeats
from veilframe.llm.common import chosen
from veilframe.llm.repeats import DONE, FOUND, Hashes, Rule, U, mixed, pack, unpack

WINDOW = 100
BEGIN = 20
#: Of a sample for the splitters: documents for each range (a quarter of what is drawn), the
#: suffix taken of so many in a document, and the most suffixes for each range. It only balances.
SAMPLED, EVERY, MOST = 4, 16, 200
#: Places in the corpus, by the sample, and finds in the sample, from which a beginning is frequent.
CROWD, FREQUENT = 30_000, 8
#: Chunks whose records travel together.
TOGETHER = 4
#: Strings that are sorted at a time.
STRINGS = 500_000
#: Buckets of suffixes for each home of documents: suffixes have three times the bytes of their texts.
SMALLER = 3

_BYTE = mixed(np.arange(1, 257, dtype=U))
_LOW = U((1 << 24) - 1)
_LEAD = f"S{BEGIN}"
_SUFFIX = [("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("off", "u1")]
_BUCKETS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _units(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def _kept(raw: bytes, covered: np.ndarray | None) -> bytes:
    return raw if covered is None else np.frombuffer(raw, np.uint8)[~covered].tobytes()


RULE = Rule(WINDOW, _units, None, len, None, _kept)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(units: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the anchor of the string that begins there, and the fingerprints of beginnings.
    ``frequent`` has those of beginnings that are taken only where a string has no other."""
    begin = Hashes(_BYTE[units]).windows(BEGIN)
    rank = begin >> U(1)
    if len(frequent):
        rank |= np.isin(begin, frequent).astype(U) << U(63)
    least = sliding_least((rank & ~_LOW) | np.arange(len(begin), dtype=U), WINDOW - BEGIN + 1)
    return (least & _LOW).astype(np.int64), begin


def leading(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(units[at[:, None] + np.arange(BEGIN)]).view(_LEAD).reshape(len(at))


@dataclass(frozen=True)
class Ranges:
    """Beginnings at which the order of suffixes is cut, into how many parts each range is divided by
    the fingerprint of the beginning, and the fingerprints of frequent beginnings."""

    points: np.ndarray
    within: int
    frequent: np.ndarray

    @property
    def buckets(self) -> int:
        return (len(self.points) + 1) * self.within

    def of(self, lead: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, lead, side="right") * self.within + (begin % U(self.within)).astype(np.int64)


def _groups(units: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk's groups: document (an index), first string, number of strings, anchor and its fingerprint."""
    anchor, begin = anchors(units, frequent)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    inside = np.arange(len(anchor)) + WINDOW <= bounds[1:][doc]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    n = np.bincount((np.cumsum(first) - 1)[inside], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    return doc[start], start, n, anchor[start], begin[anchor[start]]


def _packed(columns: dict[str, np.ndarray], pieces: list[bytes], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The records of each bucket, their bytes behind them, compressed."""
    codec = pa.Codec("zstd", compression_level=3)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        blob = len(at).to_bytes(4, "little") + pack(_SUFFIX, columns, at) + b"".join([pieces[i] for i in at.tolist()])
        yield b, len(blob).to_bytes(8, "little") + codec.compress(blob, asbytes=True)


def _unpacked(payloads: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The records, and their bytes one behind the other with a margin for the last characters."""
    codec, width = pa.Codec("zstd"), sum(np.dtype(kind).itemsize for _, kind in _SUFFIX)
    heads, texts = [], []
    for payload in payloads:
        blob = codec.decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
        end = 4 + int.from_bytes(blob[:4], "little") * width
        heads.append(blob[4:end])
        texts.append(blob[end:])
    return unpack(_SUFFIX, heads), np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)


def _sender(ranges: Ranges, homes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = text.as_py()
                    if doc is not None and raw:
                        yield doc, raw

        parts, pieces = [], []

        def send() -> pa.RecordBatch:
            ids, start, n, off, bucket = (np.concatenate(c) for c in zip(*parts, strict=True))
            # Groups that come again are settled here and go to their documents.
            index: dict[tuple[int, bytes], int] = {}
            same = np.array([index.setdefault((o, p), len(index)) for o, p in zip(off.tolist(), pieces, strict=True)], np.int64)
            order = np.lexsort((start, ids, same))
            new = repeats._runs(same[order])
            doc, place = repeats._first(new, ids[order], start[order])
            again = order[(ids[order] != doc) | (start[order] != place)]
            columns = {"doc": ids, "start": start, "n": n, "off": off}
            there = order[new]
            sent = list(_packed({c: v[there] for c, v in columns.items()}, [pieces[i] for i in there.tolist()], bucket[there]))
            found = {c: columns[c][again] for c in ("doc", "start", "n")}
            sent += repeats._packed_rows(repeats._FINDING, found, ranges.buckets + np.mod(repeats.spark_hash(found["doc"]), homes))
            parts.clear()
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array([p for _, p in sent], pa.binary())], schema=_BUCKETS)

        for docs, places, units, bounds in repeats._chunks(RULE, rows()):
            if len(units) < WINDOW:
                continue
            doc, first, n, at, begin = _groups(units, bounds, ranges.frequent)
            if not len(doc):
                continue
            parts.append((docs[doc], first - bounds[:-1][doc] + places[doc], n, at - first, ranges.of(leading(units, at), begin)))
            raw = units.tobytes()
            pieces += [raw[a:b] for a, b in zip(first.tolist(), (first + n + WINDOW - 1).tolist(), strict=True)]
            if len(parts) >= TOGETHER:
                yield send()
        if parts:
            yield send()

    return run


def multikey(text: np.ndarray, at: np.ndarray, length: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings ``text[at : at + length]`` within their parts; the lengths of a
    part are alike. What stands alone leaves; of the rest the indices in order, and what marks equal ones."""
    characters = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    left, part = np.arange(len(at)), part.astype(np.int64)
    for k in range(0, int(length.max()) if len(at) else 0, 8):
        rest = np.clip(length[left].astype(np.int64) - k, 0, 8)
        place = np.where(rest > 0, at[left] + k, 0)
        character = characters[place].astype(U)
        bits = (U(64) - rest.astype(U) * U(8))
        character = np.where(rest > 0, (character >> np.minimum(bits, U(63))) << np.minimum(bits, U(63)), U(0))
        order = np.lexsort((character, part))
        left, part, character = left[order], part[order], character[order]
        part = np.cumsum(repeats._runs(part, character)) - 1
        there = np.bincount(part, minlength=1)[part] > 1
        left, part = left[there], part[there]
        if not len(left):
            break
    return left, part


def _again(doc: np.ndarray, start: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by class and place, and which of them have another place before them in their class."""
    order = np.lexsort((start, doc, same))
    new = repeats._runs(same[order])
    first, place = repeats._first(new, doc[order], start[order])
    return order, (doc[order] != first) | (start[order] != place)


def _strings(text: np.ndarray, r: dict[str, np.ndarray], begin: np.ndarray, run: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Of groups in order of their runs, which share a beginning: the strings that came before, block by block."""
    total = np.cumsum(r["n"])
    edge = np.append(np.flatnonzero(repeats._runs(run)), len(run))
    low = 0
    while low < len(run):
        done = total[low - 1] if low else 0
        high = int(edge[max(np.searchsorted(edge, low, side="right"), np.searchsorted(edge, np.searchsorted(total, done + STRINGS), side="right") - 1)])
        g = {name: c[low:high] for name, c in r.items()}
        steps = -(-int(total[high - 1] - done) // STRINGS)
        # Equal strings have their anchor at the same place, so a large run is taken by these places.
        width = -(-(WINDOW - BEGIN + 1) // steps)
        for least in range(0, WINDOW - BEGIN + 1, width):
            a = np.maximum(0, g["off"] - (least + width - 1))
            n = np.maximum(0, np.minimum(g["n"] - 1, g["off"] - least) - a + 1)
            group = np.repeat(np.arange(len(n)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[group]
            at, start = begin[low:high][group] + inside, g["start"][group] + inside
            left, same = multikey(text, at, np.full(len(at), WINDOW), run[low:high][group] * 128 + g["off"][group] - inside)
            order, again = _again(g["doc"][group][left], start[left], same)
            found = left[order][again]
            if len(found):
                yield repeats._in_runs(g["doc"][group][found], start[found])
        low = high


def settled(payloads: list[bytes]) -> list[dict[str, np.ndarray]]:
    """The findings among the suffixes of a bucket."""
    r, text = _unpacked(payloads)
    r = {name: c.astype(np.int64) for name, c in r.items()}
    size = r["n"] + WINDOW - 1
    begin = np.cumsum(size) - size
    # By beginnings: what shares none has no equal string.
    left, run = multikey(text, begin + r["off"], np.full(len(size), BEGIN), np.zeros(len(size)))
    r, begin, size = {name: c[left] for name, c in r.items()}, begin[left], size[left]
    # By whole contents.
    there, same = multikey(text, begin, size, (run * 128 + r["off"]) * 128 + r["n"])
    order, again = _again(r["doc"][there], r["start"][there], same)
    found, out = there[order][again], []
    if len(found):
        out.append({name: r[name][found] for name in ("doc", "start", "n")})
    opened = np.ones(len(run), bool)
    opened[found] = False
    # Rows that share an id may be first together; either of them stands for the content.
    alone = np.bincount(run[opened], minlength=int(run.max(initial=0)) + 1)[run] < 2
    opened &= ~alone
    return [*out, *_strings(text, {name: c[opened] for name, c in r.items()}, begin[opened], run[opened])]


def _settle(buckets: int, homes: int) -> Callable:
    def run(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        payloads = list(rows["payload"])
        if key[0] >= buckets:  # settled in their task
            return repeats._by_home(unpack(repeats._FINDING, payloads), homes)
        return pd.concat([repeats._by_home(f, homes) for f in [{name: np.zeros(0, np.int64) for name, _ in repeats._FINDING}, *settled(payloads)]])

    return run


def _finish(key: tuple[int], docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    by_doc, out = repeats._by_doc(list(found["payload"])), []
    for doc, raw in zip(docs["doc_id"], docs["text"], strict=True):
        f = by_doc.get(int(doc))
        covered = repeats._covered(len(raw), f["start"], f["n"], WINDOW) if f is not None and raw else None
        out.append(repeats._done(RULE, int(doc), raw, len(raw), covered))
    return repeats._frame(out, DONE)


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in frames:
        yield repeats._frame([repeats._done(RULE, None, raw, len(raw), None) for raw in docs["text"]], DONE)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for _, _, units, _ in repeats._chunks(RULE, iter([(doc, text.as_py())])):
                if len(units) >= WINDOW:
                    yield doc, units


def _leads(frequent: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, units in _drawn(batches):
            at = np.unique(anchors(units, frequent)[0])[doc % EVERY :: EVERY]
            blob = units[at[:, None] + np.arange(BEGIN)].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob[i : i + BEGIN] for i in range(0, len(blob), BEGIN)], pa.binary())], names=["lead"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, units in _drawn(batches):
        begin, n = np.unique(Hashes(_BYTE[units]).windows(BEGIN), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(begin.view(np.int64)), pa.array(n)], names=["begin", "n"])


def splitters(docs: DataFrame, parts: int, there: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings at quantiles of the order of suffixes, and the fingerprints of frequent ones.

    The sample is of about ``4 * SAMPLED`` documents for each range (there are at most 4,096),
    chosen by a hash of their ids. The executors send at most ``MOST`` beginnings for each range, and
    count those of all places: only a frequent one, which has ``CROWD`` places of a range's 100,000, is sent.
    """
    if parts < 2:
        return np.zeros(0, _LEAD), np.zeros(0, U)
    some = docs.filter(F.col("doc_id").isNotNull() & chosen("doc_id", SAMPLED * parts, there))
    each = max(1.0, there / (4 * SAMPLED * parts))
    counted = some.mapInArrow(_counted, "begin long, n long").groupBy("begin").agg(F.sum("n").alias("n"))
    often = counted.filter((F.col("n") >= FREQUENT) & (F.col("n") * each >= CROWD)).select("begin").toArrow()["begin"].to_numpy()
    frequent = np.sort(often.astype(np.int64).view(U))
    leads = some.mapInArrow(_leads(frequent), "lead binary").limit(MOST * parts).toArrow()["lead"]
    every = np.sort(np.array([bytes(x) for x in leads.to_pylist()], _LEAD))
    return np.unique(every[[len(every) * i // parts for i in range(1, parts)]]) if len(every) else every, frequent


def query(docs: DataFrame) -> DataFrame:
    docs = repeats.prepared(docs)
    facts = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows")).first()
    n = max(1, round((facts["size"] or 0) / repeats.BUCKET_BYTES))
    buckets = SMALLER * n if n > 1 else 1
    parts = min(buckets, repeats.RANGES)
    points, frequent = splitters(docs, parts, facts["rows"])
    ranges = Ranges(points, -(-buckets // parts), frequent)
    sent = docs.mapInArrow(_sender(ranges, n), "bucket int, payload binary")
    found = sent.groupBy("bucket").applyInPandas(_settle(ranges.buckets, n), FOUND).select("home", "payload")
    placed = docs.filter("doc_id is not null").withColumn("home", repeats.home(n))
    done = placed.groupBy("home").cogroup(found.groupBy("home")).applyInPandas(_finish, DONE)
    whole = docs.filter("doc_id is null").mapInPandas(_whole, DONE)
    return done.unionAll(whole).withColumnRenamed("n_units", "n_bytes")
