"""Windows of a fixed length that occur earlier in a corpus, found exactly.

A corpus of documents is a corpus of sequences (of words or bytes), and every
``window`` consecutive units are a window. What the two operators on top of
this add is an *anchor*: a rule that picks, from the content of a window alone,
a part of it. Consecutive windows with the same anchor occurrence are a *group*,
so a sequence of n units is a few n/30 or n/5 groups instead of n windows.

1. ``groups``: each group sends (anchor content, group content, document,
   start, number of windows) to the bucket of its anchor content.
2. ``settle``: a bucket sorts its records. A group whose whole content came
   before is covered. A first group whose anchor also stands in other content
   is *open*: its windows have to be compared one by one. All others are unique.
3. ``cover``: findings return to their documents. Documents without open groups
   are done. Of others the text of each open group goes to the bucket of its
   anchor content, which compares window by window (``settle_windows``), and they
   are done when those findings return (``finish``). Where an anchor stands in
   more than ``CROWD`` contents, the windows of its groups are hashed with their
   documents and each goes to the bucket of its own fingerprint, of 128 bits; those
   that a task has several times go once.

Equal windows have equal anchors, so none is missed; groups are told apart by
64 bits of the anchor and 64 of the content. Records travel packed: a row of
the exchange holds all records that one chunk of texts has for one bucket. A
chunk settles its own repeats first, so what a hot passage sends to its bucket
is a record for each chunk, not for each document; settled records go by
document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut

#: Bytes of a chunk: what a task has in arrays at a time. Longer documents are read in overlapping parts.
CHUNK_BYTES = 1 << 20
#: Bytes of text for each bucket of an exchange.
BUCKET_BYTES = 12_000_000
#: Ranges that an operator's splitters make at most, which bounds their sample; more buckets than
#: that divide each range by the anchor's fingerprint.
RANGES = 4096

#: Contents of an anchor beyond which its open groups do not meet in one bucket: a limit on what a task has of an anchor.
CROWD = 10_000
#: Windows of such groups that are hashed at a time.
CROWD_WINDOWS = 1_000_000

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number of each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int, back: bool) -> np.ndarray:
    name = "back" if back else "base"
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), _BACK if back else _BASE, U)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


class Hashes:
    """Fingerprints of all parts of a sequence from sums of its prefixes."""

    def __init__(self, units: np.ndarray) -> None:
        self.sums = np.zeros(len(units) + 1, U)
        np.cumsum(units * _power(len(units), False), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _power(len(self.sums), True)[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * _power(n, True)) if n > 0 else np.zeros(0, U)


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << U(r)) | (x >> U(64 - r))
    h = (U(42) + p5 + U(8)) ^ (turn(ids.astype(np.int64).view(U) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64)


@dataclass
class Groups:
    """Of a chunk: for each group its document (an index), first window, number of windows and fingerprints."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    content: np.ndarray
    lead: np.ndarray


@dataclass(frozen=True)
class Rule:
    """What makes an operator: ``units`` turns texts into one sequence of units and the bounds of
    each; ``groups`` finds the groups of such a chunk; ``count`` the units of a text, ``pieces`` the
    texts of some runs of units, ``kept`` what is left of a text."""

    window: int
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    groups: Callable[[np.ndarray, np.ndarray], Groups]
    count: Callable[[bytes], int]
    pieces: Callable[[bytes, list[int], list[int]], list[bytes]]
    kept: Callable[[bytes, np.ndarray | None], bytes]


_GROUP = [("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1")]
_FINDING = [("doc", "<i8"), ("start", "<u4"), ("n", "u1")]
_OPEN = [("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("key", "<u8")]
_WINDOW = [("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("start", "<u4")]
_PIECE = [("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("key", "<u8"), ("size", "<u4")]


def pack(layout: list[tuple[str, str]], columns: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """The columns byte plane by byte plane: of ids and places most planes hold one value, which the exchange compresses away."""
    return b"".join(columns[name][at].astype(kind).view(np.uint8).reshape(len(at), -1).T.tobytes() for name, kind in layout if len(at))


def unpack(layout: list[tuple[str, str]], blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = {name: [] for name, _ in layout}
    width = sum(np.dtype(kind).itemsize for _, kind in layout)
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in layout:
            size = np.dtype(kind).itemsize
            parts[name].append(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
            at += n * size
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in layout}


def _packed_rows(layout: list[tuple[str, str]], columns: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        yield b, pack(layout, columns, at)


def _chunks(rule: Rule, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, place of the first unit, units, bounds) of chunks; a long document in overlapping parts."""
    ids, raws, size = [], [], 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        units, bounds = rule.units(raws)
        return np.array(ids, np.int64), np.zeros(len(ids), np.int64), units, bounds

    for doc, raw in rows:
        if len(raw) > CHUNK_BYTES:
            units, _ = rule.units([raw])
            for at in range(0, max(1, len(units) - rule.window + 1), CHUNK_BYTES):
                part = units[at : at + CHUNK_BYTES + rule.window - 1]
                yield np.array([doc]), np.array([at]), part, np.array([0, len(part)])
            continue
        ids.append(doc)
        raws.append(raw)
        size += len(raw)
        if size > CHUNK_BYTES:
            yield together()
            ids, raws, size = [], [], 0
    if ids:
        yield together()


_BUCKETS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _sender(rule: Rule, buckets: int, homes: int, splitters: np.ndarray | None, ranges: int = 1) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = text.as_py()
                    if doc is not None and raw:
                        yield doc, raw

        for docs, places, units, bounds in _chunks(rule, rows()):
            if len(units) < rule.window:
                continue
            g = rule.groups(units, bounds)
            ids, start = docs[g.doc], g.start + places[g.doc]
            # The repeats of the chunk itself are settled here and go by document.
            order = np.lexsort((start, ids, g.content, g.key))
            again = np.zeros(len(order), bool)
            same = (g.key[order][1:] == g.key[order][:-1]) & (g.content[order][1:] == g.content[order][:-1])
            moved = (ids[order][1:] != ids[order][:-1]) | (start[order][1:] != start[order][:-1])
            again[order[1:]] = same & moved
            if splitters is None:
                bucket = (g.key % U(buckets)).astype(np.int64)
            else:
                within = buckets // ranges
                bucket = np.searchsorted(splitters, g.lead, side="right") * within + (g.key % U(within)).astype(np.int64)
            bucket = np.where(again, buckets + np.mod(spark_hash(ids), homes), bucket)
            columns = {"key": g.key, "content": g.content, "doc": ids, "start": start, "n": g.n}
            out = list(_packed_rows(_GROUP, columns, bucket))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], schema=_BUCKETS)

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a new value begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _first(new: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """For each row the columns' values at the begin of its run."""
    run = np.cumsum(new) - 1
    return [c[new][run] for c in columns]


def _by_home(columns: dict[str, np.ndarray], homes: int, opened: int = 0) -> pd.DataFrame:
    """The findings packed by the home of their document; ``opened`` is 1 for open groups, 2 for those of a crowded anchor."""
    rows = list(_packed_rows(_OPEN if opened else _FINDING, columns, np.mod(spark_hash(columns["doc"]), homes)))
    return pd.DataFrame({
        "home": np.array([h for h, _ in rows], np.int32), "open": np.full(len(rows), opened),
        "payload": np.array([p for _, p in rows] + [None], object)[:-1],
    })


FOUND = "home int, open int, payload binary"


def _settle(buckets: int, homes: int, crowd: int = CROWD) -> Callable:
    def run(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        r = unpack(_GROUP, list(rows["payload"]))
        if key[0] >= buckets:  # settled in its chunk
            return _by_home(r, homes)
        order = np.lexsort((r["start"], r["doc"], r["content"], r["key"]))
        r = {name: c[order] for name, c in r.items()}
        content, anchor = _runs(r["key"], r["content"]), _runs(r["key"])
        doc, start = _first(content, r["doc"], r["start"])
        again = (r["doc"] != doc) | (r["start"] != start)
        contents = np.bincount(np.cumsum(anchor) - 1, content)[np.cumsum(anchor) - 1] if len(content) else np.zeros(0)
        # Rows that share an id may be first together; they are open together too.
        opened, crowded = ~again & (contents > 1) & (contents <= crowd), ~again & (contents > max(1, crowd))
        part = lambda at: {name: c[at] for name, c in r.items()}
        return pd.concat([_by_home(part(again), homes), _by_home(part(opened), homes, 1), _by_home(part(crowded), homes, 2)])

    return run


def _packed_pieces(columns: dict[str, np.ndarray], pieces: list[bytes], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
        head = len(at).to_bytes(4, "little") + pack(_PIECE, columns, at)
        yield b, zlib.compress(head + b"".join([pieces[i] for i in at.tolist()]), 1)


def _unpacked_pieces(payload: bytes) -> tuple[dict[str, np.ndarray], list[bytes]]:
    blob = zlib.decompress(payload)
    n = int.from_bytes(blob[:4], "little")
    end = 4 + n * sum(np.dtype(kind).itemsize for _, kind in _PIECE)
    columns = unpack(_PIECE, [blob[4:end]])
    cuts = (end + np.cumsum(columns["size"], dtype=np.int64)).tolist()
    return columns, [blob[a:b] for a, b in zip([end, *cuts], cuts, strict=False)]


def _expanded(columns: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of groups whose units begin at the bounds: the group, the first unit, the document and the start."""
    n = columns["n"].astype(np.int64)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = np.repeat(np.arange(len(n)), n)
    return group, bounds[:-1][group] + inside, columns["doc"][group], columns["start"].astype(np.int64)[group] + inside


def _in_runs(doc: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Single windows as findings of consecutive ones."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    once = _runs(doc, start)
    doc, start = doc[once], start[once]
    new = _runs(doc, start - np.arange(len(start)))
    place = np.arange(len(start))
    new |= (place - _first(new, place)[0]) % 255 == 0
    return {"doc": doc[new], "start": start[new], "n": np.diff(np.append(np.flatnonzero(new), len(start)))}


def _compared(r: dict[str, np.ndarray], *names: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of windows that are equal where the columns are, the first of each, and the findings for the others."""
    order = np.lexsort((r["start"], r["doc"], *(r[name] for name in names)))
    r = {name: c[order] for name, c in r.items()}
    new = _runs(*(r[name] for name in names))
    doc, start = _first(new, r["doc"], r["start"])
    again = (r["doc"] != doc) | (r["start"] != start)
    return {name: c[new] for name, c in r.items()}, _in_runs(r["doc"][again], r["start"][again])


def _windows(rule: Rule, columns: dict[str, np.ndarray], pieces: list[bytes]) -> dict[str, np.ndarray]:
    """The windows of groups with two fingerprints each."""
    units, bounds = rule.units(pieces)
    _, at, doc, start = _expanded(columns, bounds)
    one, two = (Hashes(u).of(at, at + rule.window) for u in (units, mixed(units.astype(U) + _BASE)))
    return {"one": one, "two": two, "doc": doc, "start": start}


def _settle_windows(rule: Rule, homes: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:  # windows of crowded anchors
            _, again = _compared(unpack(_WINDOW, list(rows["payload"])), "two", "one")
            return _by_home(again, homes)
        parts = {"key": [], "content": [], "doc": [], "start": []}
        for payload in rows["payload"]:
            columns, pieces = _unpacked_pieces(payload)
            units, bounds = rule.units(pieces)
            group, at, doc, start = _expanded(columns, bounds)
            parts["content"].append(Hashes(units).of(at, at + rule.window))
            parts["key"].append(columns["key"][group])
            parts["doc"].append(doc)
            parts["start"].append(start)
        _, again = _compared({name: np.concatenate(c) for name, c in parts.items()}, "content", "key")
        return _by_home(again, homes)

    return run


def _covered(size: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which units the windows cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.minimum(start, size), 1)
    np.add.at(edge, np.minimum(start.astype(np.int64) + n + window - 1, size), -1)
    return np.cumsum(edge)[:size] > 0


def _by_doc(payloads: list[bytes], layout: list[tuple[str, str]] = _FINDING) -> dict[int, dict[str, np.ndarray]]:
    r = unpack(layout, payloads)
    order = np.argsort(r["doc"], kind="stable")
    r = {name: c[order] for name, c in r.items()}
    found, first = np.unique(r["doc"], return_index=True)
    cuts = [*first.tolist(), len(order)]
    return {d: {name: c[a:b] for name, c in r.items()} for d, a, b in zip(found.tolist(), cuts, cuts[1:], strict=False)}


DONE = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"
STEP = f"{DONE}, home int, text binary, covered binary, bucket int, payload binary"
_EMPTY = {"doc_id": None, "n_units": None, "n_removed": None, "n_spans": None, "kept_sha256": None, "home": None, "text": None, "covered": None, "bucket": None, "payload": None}


def _done(rule: Rule, doc: int | None, raw: bytes, n: int, covered: np.ndarray | None) -> dict:
    """The result row of a text; ``covered`` is None if nothing of it is."""
    removed = spans = 0
    if covered is not None:
        removed, spans = int(covered.sum()), int(covered[0]) + int(np.count_nonzero(covered[1:] & ~covered[:-1]))
    sha = hashlib.sha256(rule.kept(raw, covered)).hexdigest()
    return {"doc_id": doc, "n_units": n, "n_removed": removed, "n_spans": spans, "kept_sha256": sha}


def _frame(rows: list[dict], like: str) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in like.split(",")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out


def _cover(rule: Rule, buckets: int) -> Callable:
    def run(key: tuple[int], docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        by_doc = _by_doc(list(found["payload"][found["open"] == 0]))
        opened, crowded = (_by_doc(list(found["payload"][found["open"] == kind]), _OPEN) for kind in (1, 2))
        out, waiting, pieces, size = [], [], [], 0
        crowd, crowd_pieces, windows = [], [], 0

        def send() -> None:
            nonlocal waiting, pieces, size
            if waiting:
                columns = {name: np.concatenate([w[name] for w in waiting]) for name, _ in _OPEN}
                columns["size"] = np.array([len(p) for p in pieces])
                rows = _packed_pieces(columns, pieces, (columns["key"] % U(buckets)).astype(np.int64))
                out.extend({**_EMPTY, "bucket": b, "payload": p} for b, p in rows)
            waiting, pieces, size = [], [], 0

        def send_crowd() -> None:
            nonlocal crowd, crowd_pieces, windows
            if crowd:
                columns = {name: np.concatenate([c[name] for c in crowd]) for name, _ in _OPEN}
                first, again = _compared(_windows(rule, columns, crowd_pieces), "two", "one")
                rows = _packed_rows(_WINDOW, first, -1 - (first["one"] % U(buckets)).astype(np.int64))
                out.extend({**_EMPTY, "bucket": b, "payload": p} for b, p in rows)
                if len(again["doc"]):  # what came before in this task
                    out.append({**_EMPTY, "home": int(key[0]), "payload": pack(_FINDING, again, np.arange(len(again["doc"])))})
            crowd, crowd_pieces, windows = [], [], 0

        def fitting(groups: dict[str, np.ndarray] | None, length: int) -> dict[str, np.ndarray] | None:
            """The groups without those that another text of the same id has."""
            if groups is None:
                return None
            inside = groups["start"].astype(np.int64) + groups["n"] + rule.window - 1 <= length
            return {name: c[inside] for name, c in groups.items()} if inside.any() else None

        def texts(raw: bytes, groups: dict[str, np.ndarray]) -> list[bytes]:
            start = groups["start"].astype(np.int64)
            return rule.pieces(raw, start.tolist(), (start + groups["n"] + rule.window - 1).tolist())

        for doc, raw in zip(docs["doc_id"], docs["text"], strict=True):
            doc = None if doc is None or pd.isna(doc) else int(doc)
            f, length = by_doc.get(doc), rule.count(raw)
            covered = _covered(length, f["start"], f["n"], rule.window) if f is not None and length else None
            o, c = fitting(opened.get(doc), length), fitting(crowded.get(doc), length)
            if o is None and c is None:
                out.append({**_EMPTY, **_done(rule, doc, raw, length, covered)})
                continue
            if o is not None:
                waiting.append(o)
                pieces += texts(raw, o)
                size += len(raw)
            for at in range(0, len(c["n"]) if c is not None else 0, 10_000):
                part = {name: x[at : at + 10_000] for name, x in c.items()}
                crowd.append(part)
                crowd_pieces += texts(raw, part)
                windows += int(part["n"].sum())
                if windows > CROWD_WINDOWS:
                    send_crowd()
            bits = b"" if covered is None else np.packbits(covered).tobytes()
            out.append({**_EMPTY, "doc_id": doc, "home": int(key[0]), "text": zlib.compress(raw, 1), "covered": bits})
            if size > 8 * CHUNK_BYTES:
                send()
        send()
        send_crowd()
        return _frame(out, STEP)

    return run


def _finish(rule: Rule) -> Callable:
    def run(key: tuple[int], docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        by_doc, out = _by_doc(list(found["payload"])), []
        for doc, packed, bits in zip(docs["doc_id"], docs["text"], docs["covered"], strict=True):
            raw = zlib.decompress(packed)
            f, n = by_doc.get(int(doc)), rule.count(raw)
            covered = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else None
            if f is not None:
                late = _covered(n, f["start"], f["n"], rule.window)
                covered = late if covered is None else covered | late
            out.append(_done(rule, int(doc), raw, n, covered))
        return _frame(out, DONE)

    return run


def home(homes: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(homes)).cast("int")


def prepared(docs: DataFrame) -> DataFrame:
    """The id and the text's bytes, empty if null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))


def find_repeats(docs: DataFrame, rule: Rule, splitters: Callable[[DataFrame, int], np.ndarray] | None = None, crowd: int = CROWD) -> DataFrame:
    """Per document: ``n_units``, ``n_removed``, ``n_spans`` and the digest of what is kept."""
    docs = prepared(docs)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, round(size / BUCKET_BYTES))
    ranges = min(n, RANGES)
    buckets = ranges * -(-n // ranges)
    points = splitters(docs, ranges) if splitters else None
    sent = docs.mapInArrow(_sender(rule, buckets, n, points, ranges), "bucket int, payload binary")
    found = sent.groupBy("bucket").applyInPandas(_settle(buckets, n, crowd), FOUND)
    placed = docs.withColumn("home", home(n))
    step = cut(placed.groupBy("home").cogroup(found.groupBy("home")).applyInPandas(_cover(rule, n), STEP))
    windows = step.filter("bucket is not null").select("bucket", "payload")
    own = step.filter("bucket is null and payload is not null").select("home", F.lit(0).alias("open"), "payload")
    late = windows.groupBy("bucket").applyInPandas(_settle_windows(rule, n), FOUND).unionAll(own)
    open_ = step.filter("text is not null").select("home", "doc_id", "text", "covered")
    rest = open_.groupBy("home").cogroup(late.groupBy("home")).applyInPandas(_finish(rule), DONE)
    names = [c.split(" ")[0] for c in DONE.split(", ")]
    return step.filter("kept_sha256 is not null").select(*names).unionAll(rest.select(*names))
