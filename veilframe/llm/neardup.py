"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document is its set of five-word shingles. Its signature has 40 minima, of
which 16 bits each are kept; documents of similarity s differ in about
40 * (1 - s) of them. The join has to find every pair of signatures that differ
in at most 19 places: cut into ten chunks of four places, such a pair has a
chunk with at most one difference, so it agrees in the chunk with one of its
places masked. The four masks of ten chunks are the 40 keys of a signature. At
similarity 0.85 a pair differs in over 19 places with probability under one in
a million, at 0.8 (if that is asked for) with 2.2 in 100,000; above, in fewer yet.

Equal sets are one class before anything is compared. Classes that share a key
are hung on the smallest of the key, and the connected parts of that graph are
the clusters: no link between classes leaves one. A large cluster is often held
together by what its texts have in common and no link, a template or a licence.
It is divided again: of two linked sets of n shingles each, the n - 0.85 n + 1
that come first in any order of shingles have one in common. The order begins
with shingles that are rare, by their counts in a bounded sample of the large
clusters, so texts that share but a template share no first shingle and part.
Then their members are hung on the smallest of each first shingle; this keeps
all links and costs work in proportion to the rows. In a cluster links are looked
for from document to document, among those not linked yet, by set sizes,
signatures and then the full sets, so a group of copies costs about as many
comparisons as it has members for each chain it is made of, and gives one row a
member. Clusters that are large still, of very many differing copies, are dealt as
pairs of blocks, each a task of bounded size.

Defined cases: null and blank texts have empty sets and are linked with
nothing; rows with a null id are compared with nothing, have no component and
are kept; rows that share an id are one document, so repeated rows get the same
result; an empty table gives an empty one; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chosen, cut
from veilframe.llm.graph import components
from veilframe.llm.recompression import word_hashes
from veilframe.llm.repeats import Hashes, U, _packed_rows, mixed, prepared, unpack
from veilframe.operators import bloom

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union, where nothing else is asked for.
PERCENT = 85
PLACES, CHUNK, ERRORS = 40, 4, 1
#: The signature distance within which every pair is found: with one more there may be two errors in each chunk.
DISTANCE = PLACES // CHUNK * (ERRORS + 1) - 1
#: Shingles of a block of a cluster, and of a task of small clusters.
BLOCK = 400_000

#: Blocks of a cluster beyond which it is divided; a text of fewer is sent so many times, which costs less than
#: the rounds of dividing. The result is the same either way.
DIVIDED = 8
#: Documents whose shingles are counted to order those of large clusters, and shingles that are told apart by
#: their counts. They decide which shingles come first, not which links are found.
SAMPLE, FREQUENT = 20_000, 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = mixed(np.arange(1, PLACES + 1, dtype=U)) | U(1)
_ADD = mixed(np.arange(101, PLACES + 101, dtype=U))


def shingles(raw: bytes) -> np.ndarray:
    """The sorted fingerprints of a text's shingles, A-Z in lower case."""
    words, _ = word_hashes(raw.translate(_LOWER))
    if len(words) >= SHINGLE:
        return np.unique(Hashes(words).windows(SHINGLE))
    return mixed(Hashes(words).of(np.array([0]), np.array([len(words)])) + U(len(words))) if len(words) else np.zeros(0, U)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of 16-bit minima of sets that begin at the places, none of them empty."""
    out = np.empty((len(at), PLACES), np.uint16)
    for k in range(PLACES):
        out[:, k] = mixed(np.minimum.reduceat(sets * _FACTOR[k] + _ADD[k], at)).astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """For each signature its keys: every chunk with every place masked."""
    chunks = signature.reshape(len(signature), PLACES // CHUNK, CHUNK).astype(U)
    shifts = U(1) << (U(16) * np.arange(CHUNK, dtype=U))
    out = np.empty((len(signature), PLACES // CHUNK, CHUNK), U)
    for mask in range(CHUNK):
        rest = chunks * shifts
        rest[:, :, mask] = 0
        tag = np.arange(PLACES // CHUNK, dtype=U) * U(CHUNK) + U(mask + 1)
        out[:, :, mask] = mixed(rest.sum(axis=2, dtype=U) ^ mixed(tag))
    return out.reshape(len(signature), -1)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("signature", pa.binary())])
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"


def _some(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, sets, size = [], [], 0
    for doc, raw in rows:
        ids.append(doc)
        sets.append(shingles(raw))
        size += len(sets[-1])
        if size > 500_000 or len(ids) >= 10_000:
            yield ids, sets
            ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _texts(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    for batch in batches:
        ids = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", *more)]
        yield from zip(*ids, (t.as_py() for t in batch.column(batch.schema.get_field_index("text"))), strict=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _some(_texts(batches)):
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        h1, h2, signed = np.zeros(len(n), U), np.zeros(len(n), U), [None] * len(n)
        if len(full):
            every = np.concatenate(sets)
            at = (np.cumsum(n) - n)[full]
            h1[full] = np.add.reduceat(mixed(every), at)
            h2[full] = np.add.reduceat(mixed(every ^ U(0x5851F42D4C957F2D)), at)
            for i, row in zip(full.tolist(), signatures(every, at), strict=True):
                signed[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(signed, pa.binary()),
        ], schema=_SIGNED)


_KEY = [("key", "<u8"), ("doc", "<i8")]


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            if not len(ids):
                continue
            own = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), PLACES))
            columns = {"key": own.ravel(), "doc": np.repeat(ids, own.shape[1])}
            out = list(_packed_rows(_KEY, columns, (columns["key"] % U(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"],
            )

    return run


def _hang(rows: pd.DataFrame) -> pd.DataFrame:
    """The links of each key's documents with the smallest of them, each once."""
    r = unpack(_KEY, list(rows["payload"]))
    order = np.lexsort((r["doc"], r["key"]))
    key, doc = r["key"][order], r["doc"][order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = doc[new][np.cumsum(new) - 1]
    at = first != doc
    links = np.unique(np.column_stack([first[at], doc[at]]), axis=0) if at.any() else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _some(_texts(batches)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])


def first_shingles(own: np.ndarray, often: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Of a set the shingles that come first, so many that linked sets share one. ``often`` are
    frequent shingles, sorted, with their ``counts``; all others come before them."""
    count = np.zeros(len(own), np.int64)
    if len(often) and len(own):
        place = np.minimum(np.searchsorted(often, own), len(often) - 1)
        count = np.where(often[place] == own, counts[place], 0)
    first = len(own) - -(-percent * len(own) // 100) + 1
    return own[np.lexsort((own, count))[: first if len(own) else 0]]


def _send_first(buckets: int, often: np.ndarray, counts: np.ndarray, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _some(_texts(batches)):
            firsts = [mixed(first_shingles(s, often, counts, percent)) for s in sets]
            columns = {"key": np.concatenate(firsts), "doc": np.repeat(np.array(ids, np.int64), list(map(len, firsts)))}
            out = list(_packed_rows(_KEY, columns, (columns["key"] % U(buckets)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])

    return run


def divided(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``rep``, ``n`` and ``cluster`` of the members after those of large clusters are divided by first shingles."""
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("_size")).filter(F.col("_size") > DIVIDED * BLOCK)
    large = cut(members.join(sizes.drop("_size"), "cluster", "left_semi"))
    total, there = large.agg(F.sum("n"), F.count("*")).first()
    if not there:
        return members
    # Texts stay where they are: a Bloom filter of the members, of bounded size, tells them in the scan. One that
    # it takes by mistake sends a few keys more; only members are joined below.
    texts = docs.filter(bloom.build(large, F.col("rep")).test(F.col("doc_id")))
    sample = texts.filter(chosen("doc_id", SAMPLE // 4, there))
    counted = sample.mapInArrow(_each_shingle, "shingle long").groupBy("shingle").count().filter("count > 1")
    top = counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    often, counts = top.column("shingle").to_numpy().view(U), top.column("count").to_numpy()
    order = np.argsort(often)
    buckets = max(1, round(total * (100 - percent) / 100 * 16 / 8_000_000))
    sent = texts.mapInArrow(_send_first(buckets, often[order], counts[order], percent), "bucket int, payload binary")
    parts = components(sent.groupBy("bucket").applyInPandas(_hang, "a long, b long"))
    kept = large.select("rep", "n").join(parts, F.col("rep") == F.col("node")).select("rep", "n", F.col("root").alias("cluster"))
    return members.join(sizes.drop("_size"), "cluster", "left_anti").select("rep", "n", "cluster").unionAll(kept)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for doc, task, cluster, text in _texts(batches, "task", "cluster"):
        rows.append((doc, task, cluster, shingles(text).tobytes()))
        if len(rows) >= 2000:
            yield _set_batch(rows)
            rows = []
    if rows:
        yield _set_batch(rows)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "task", "cluster", "shingles"])


def _link(percent: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A link to each document from one before it, wherever it has any, cluster by cluster."""
        out = []
        for _, group in rows.groupby("cluster", sort=True):
            out += spanning(group["doc_id"].to_numpy(np.int64), [np.frombuffer(s, U) for s in group["shingles"]], percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def spanning(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what all links between the sets connect."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    ids, sets, n = ids[order], [sets[i] for i in order], n[order]
    every, at = np.concatenate(sets), np.cumsum(n) - n
    signed = signatures(every, at)
    left = np.arange(len(ids))  # not linked yet, in order of size
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            low, high = np.searchsorted(n[left], [-(-percent * n[x] // 100), 100 * n[x] // percent + 1])
            near = np.arange(low, high)
            near = near[(signed[left[near]] != signed[x]).sum(axis=1) <= DISTANCE]
            hit = [i for i in near.tolist() if _linked(sets[x], sets[left[i]], percent)] if len(near) < 8 else near[_all_linked(every, at, n, x, left[near], percent)].tolist()
            out += [(int(ids[x]), int(ids[left[i]])) for i in hit]
            queue += [left[i] for i in hit]
            left = np.delete(left, hit)
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _all_linked(every: np.ndarray, at: np.ndarray, n: np.ndarray, x: int, ys: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets are linked with set x."""
    own = every[at[x] : at[x] + n[x]]
    first = np.cumsum(n[ys]) - n[ys]
    values = every[np.repeat(at[ys] - first, n[ys]) + np.arange(n[ys].sum())]
    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
    both = np.add.reduceat((own[place] == values).astype(np.int64), first)
    return 100 * both >= percent * (n[x] + n[ys] - both)


def find_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row; links from ``percent`` similarity on."""
    docs = prepared(docs)
    signed = cut(docs.mapInArrow(_sign, SIGNED))
    same = ["h1", "h2", "n_shingles"]
    classes = cut(signed.filter("doc_id is not null and n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    buckets = max(1, round(classes.count() * PLACES * 16 / 8_000_000))
    sent = classes.select("rep", "signature").mapInArrow(_send(buckets), "bucket int, payload binary")
    clusters = components(sent.groupBy("bucket").applyInPandas(_hang, "a long, b long"))
    members = classes.groupBy("rep").agg(F.max("n_shingles").alias("n")).join(clusters, F.col("rep") == F.col("node")).select("rep", "n", F.col("root").alias("cluster"))
    members = cut(divided(docs, cut(members), percent))
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    tasks = max(1, round((members.agg(F.sum("n")).first()[0] or 0) / BLOCK))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "cluster").select("rep", "cluster", "blocks", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(tasks))).otherwise(tasks + F.pmod(pair, F.lit(1 << 40)))
    dealt = dealt.select(F.col("rep").alias("_rep"), "cluster", task.alias("task"))
    texts = docs.join(dealt, docs["doc_id"] == dealt["_rep"]).select("doc_id", "task", "cluster", "text")
    sets = texts.mapInArrow(_sets, "doc_id long, task long, cluster long, shingles binary")
    roots = components(sets.groupBy("task").applyInPandas(_link(percent), "a long, b long"))
    found = classes.select(*[F.col(c).alias(f"_{c}") for c in same], "rep").join(roots, F.col("rep") == F.col("node"), "left")
    found = found.select(*[f"_{c}" for c in same], F.coalesce("root", "rep").alias("component_id"))
    on = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n_shingles") == F.col("_n_shingles"))
    known = (F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).alias("_known")
    rows = signed.drop("signature")
    # Blank texts share one key and have no class: they stay out of the join.
    alone = rows.filter(~known).withColumn("component_id", F.lit(None).cast("long"))
    rows = rows.filter(known).join(found, on, "left").select(*rows.columns, "component_id").unionAll(alone)
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


query = find_groups


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(root.b, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(root.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
