"""The trie of conversation prefixes, by van Emde Boas recursion.

Sequences are cut at half depth. What lies before a cut is named, so that equal
prefixes share a name; the part above is the upper trie, the parts below each
name are its lower forests, and both are cut again, until a part is one turn
high. All parts of one height are worked on at once, in every conversation:

* Down, names. A stretch of 2^k turns is named by its halves; the prefix at a
  cut by the part's root and the stretch above the cut. Names are 128-bit
  hashes, equal wherever the turns are. Inside a block of ``BLOCK`` turns this
  takes one pass; the cuts between blocks, which only long conversations have,
  take one join for each height.
* Up, totals. For each height, from low to high, a cut node's total is grafted
  on the nodes of the upper part between it and the part's root: those lie in
  one block of any conversation through it, found by its smallest one. A node
  is thus added to once for each height, not once for each descendant.

A conversation of any length is blocks of at most ``BLOCK`` turns; copies are
aggregated where they are, before names are exchanged; members of a node are
counted and their least is kept, never listed.

Defined cases: turns are ordered by (turn, role, text), nulls first; null role
and text are empty; repeated rows are turns of their own; rows without conv_id
belong to no conversation; an empty table has no nodes; further columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.order import id_digests, placed, ranged, stored

#: Turns of a block; a power of two.
BLOCK = 512
#: The name of the root.
ROOT = bytes(16)
#: Conversations that share their beginning with the first of so many, and the most turns they share.
FAMILY, HEADS = 100, 6

_WALK = "conv_id long, block long, length long, names array<binary>, chars array<long>"


def _hash(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(a + b, digest_size=16).digest()


def _stretches(turns: list[bytes]) -> list[list[bytes]]:
    """Names of the stretches of 1, 2, 4, ... turns that begin at multiples of their length."""
    levels = [turns]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash(last[i], last[i + 1]) for i in range(0, len(last) - 1, 2)])
    return levels


def prefix_names(root: bytes, turns: list[bytes], height: int) -> list[bytes]:
    """The names of the prefixes of 0 to ``len(turns)`` (at most ``height - 1``) turns below ``root``."""
    levels, names = _stretches(turns), [root] * (min(len(turns), height - 1) + 1)

    def cut(root: bytes, low: int, size: int) -> None:
        while size > 1:
            half = size // 2
            if low + half < len(names):
                names[low + half] = name = _hash(root, levels[half.bit_length() - 1][low // half])
                cut(name, low + half, half)  # the lower forest
            size = half  # the upper trie

    cut(root, 0, height)
    return names


def turn_name(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as they are, as ``conv_id, depth, name, chars, length``, and the conversations with their ``length``."""
    written, sizes = _numbered(turns)
    rows = placed(written, sizes, "_total").select(F.col("_group").alias("conv_id"), F.col("place").alias("depth"), "name", "chars", F.col("_total").alias("length"))
    return rows, sizes.groupBy(F.col("_group").alias("conv_id")).agg(F.max("_total").alias("length"))


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    empty = F.lit("")
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return ranged(rows, "conv_id", ["turn", "role", "text"], [
        turn_name(F.col("role"), F.col("text")).alias("name"), F.length("text").cast("long").alias("chars")])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation c after it took the first h turns of c - c % ``FAMILY`` for
    its own first h, where h = crc32(c) % ``HEADS``; and the conversations, in the form of :func:`sequences`."""
    written, sizes = _numbered(turns)
    whole = sizes.groupBy(F.col("_group").alias("conv_id")).agg(F.max("_total").alias("n"))
    base, heads = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = whole.select("conv_id", "n", heads, base.alias("base")).join(whole.select(F.col("conv_id").alias("base"), F.col("n").alias("_nb")), "base", "left")
    taken = F.least("h", F.coalesce("_nb", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    # One row for each conversation and range: what the turns need to know of their conversation.
    info = sizes.join(convs.withColumnRenamed("conv_id", "_group"), "_group")
    rows = placed(written, info, "h", "taken", "length")
    own = rows.filter("place > h").select(F.col("_group").alias("conv_id"), (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "name", "chars", "length")
    first = rows.filter(F.col("place") < HEADS).select(F.col("_group").alias("base"), "place", "name", "chars")
    head = convs.select("conv_id", "base", "taken", "length").join(first, "base").filter("place <= taken")
    return own.unionByName(head.select("conv_id", F.col("place").alias("depth"), "name", "chars", "length")), convs.select("conv_id", "length")


def _walks(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """``conv_id, block, length, names, chars``: the names of the prefixes from the block's root to
    its end, and the code points of its turns."""
    turn = F.struct("depth", "name", "chars")
    edges = rows.select("conv_id", F.floor((F.col("depth") - 1) / block).alias("block"), "length", turn.alias("turn"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("block"), "length", F.lit(None).cast(edges.schema["turn"].dataType).alias("turn"))
    # A turnless conversation is one block as well; lists leave nulls out.
    groups = edges.unionByName(none).groupBy("conv_id", "block", "length").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    most = convs.agg(F.max("length")).first()[0] or 0
    shape = "conv_id", "block", "length", "root", "after", F.col("turns.name").alias("names"), F.col("turns.chars").alias("chars")
    if most < block:
        blocks = groups.withColumns({"root": F.lit(ROOT), "after": F.lit(None).cast("binary")})
    else:
        groups = stored(groups, "blocks")
        roots = _roots(groups, most // block, block)
        after = roots.select("conv_id", (F.col("block") - 1).alias("block"), F.col("root").alias("after"))
        blocks = groups.join(roots, ["conv_id", "block"], "left").join(after, ["conv_id", "block"], "left")
        blocks = blocks.withColumn("root", F.coalesce("root", F.lit(ROOT)))
    return blocks.select(*shape).mapInArrow(lambda batches: _name_blocks(batches, block), _WALK)


def _name_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("root", "after", "names")), strict=True)
        names = [prefix_names(root, turns, block) + ([after] if len(turns) == block else []) for root, after, turns in rows]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "block", "length")), pa.array(names, pa.list_(pa.binary())), batch.column("chars")],
            names=["conv_id", "block", "length", "names", "chars"])


def _roots(groups: DataFrame, last: int, block: int) -> DataFrame:
    """``conv_id, block, root``: names of the prefixes where blocks 1 to ``last`` begin."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_stretches(turns)[-1][0] for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary())], names=["conv_id", "i", "name"])

    hashed = lambda a, b: F.unhex(F.substring(F.sha2(F.concat(a, b), 256), 1, 32))
    full = groups.filter(F.size("turns") == block).select("conv_id", F.col("block").alias("i"), F.col("turns.name").alias("names"))
    levels = [stored(full.mapInArrow(whole, "conv_id long, i long, name binary"), "stretches")]
    while 1 << len(levels) <= last:
        pair = levels[-1].groupBy("conv_id", F.floor(F.col("i") / 2).alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "name"))).alias("p"))
        levels.append(stored(pair.filter(F.size("p") == 2).select("conv_id", "i", hashed(F.col("p")[0]["name"], F.col("p")[1]["name"]).alias("name")), "stretches"))
    roots = groups.filter("block = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(ROOT).alias("root"))
    for k in reversed(range(len(levels))):
        above = levels[k].select("conv_id", (F.col("i") * (1 << k)).alias("block"), "name")
        below = roots.join(above, ["conv_id", "block"]).filter(F.col("block") % (2 << k) == 0)
        roots = stored(roots.unionByName(below.select("conv_id", F.col("block") + (1 << k), hashed(F.col("root"), F.col("name"))).toDF("conv_id", "block", "root")), "roots")
    return roots.filter("block > 0")


def _low(depth: str) -> Column:
    """The greatest power of two that divides the depth: the height of the part cut there."""
    return F.col(depth).bitwiseAND(-F.col(depth))


def trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the sequences ``rows`` (conv_id, depth from 1, name, chars, length) of ``convs``
    (conv_id, length): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    walks = stored(_walks(rows, convs, block), "walks")
    steps = walks.select("conv_id", "block", "length", F.posexplode("names").alias("t", "name"), "names", "chars").filter("t > 0 or block = 0")
    steps = steps.select(
        "conv_id", "name", (F.col("block") * block + F.col("t")).alias("depth"), "length",
        F.when(F.col("t") > 0, F.col("names")[F.col("t") - 1]).alias("parent"), F.when(F.col("t") > 0, F.col("chars")[F.col("t") - 1]).otherwise(0).alias("chars"))
    nodes = steps.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "parent", "chars")])
    nodes = stored(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = _graft(nodes, walks, convs, block)
    ends = id_digests(steps.filter("depth = length"), "name", "conv_id")
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "name").join(ends, "name", "left").join(above, "parent", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _graft(nodes: DataFrame, walks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """``name, n_leaves, saved_tokens`` of the subtree of every node."""
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    pile = nodes.select(
        "name", "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    most = convs.agg(F.max("length")).first()[0] or 0
    half = 1
    while half <= most:
        cuts = pile.filter(_low("depth") == half).groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
        # The half above a cut: a stretch of one block, or whole blocks.
        first, last = F.col("depth") - half, F.col("depth") - 1
        cuts = cuts.select("conv_id", "n_leaves", "saved_tokens", first.alias("first"), last.alias("last"), F.explode(
            F.sequence(F.floor(first / block), F.floor(last / block))).alias("block"))
        low = F.greatest(F.col("first") - F.col("block") * block, F.lit(0))
        many = F.least(F.col("last") - F.col("block") * block, F.lit(block - 1)) - low + 1
        above = cuts.join(walks.filter(F.col("length") >= half).select("conv_id", "block", "names"), ["conv_id", "block"])
        above = above.select("n_leaves", "saved_tokens", (F.col("block") * block + low).alias("at"), F.posexplode(F.slice("names", (low + 1).cast("int"), many.cast("int"))).alias("t", "name"))
        grafts = above.groupBy("name", (F.col("at") + F.col("t")).alias("depth")).agg(*sums)
        pile = pile.unionByName(stored(grafts, "grafts"), allowMissingColumns=True)
        half *= 2
    return pile.groupBy("name").agg(*sums)


def query(turns: DataFrame) -> DataFrame:
    return trie(*rebuilt(turns))


#: CRC-32, a bit at a time.
CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({x})), lambda i: ascii(substring({x}, i::BIGINT + 1, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1))))"""

SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
                  sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS name, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, xor({CRC_SQL.format(x="c::VARCHAR")}, 4294967295) % 6 AS h, n, c - c % 100 AS base FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
k AS (SELECT c.c, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.c = c.base),
s AS (SELECT k.c, t.place AS d, name, chars FROM k JOIN t ON t.c = k.base AND t.place <= k.taken
      UNION ALL SELECT k.c, t.place - k.h + k.taken, name, chars FROM k JOIN t ON t.c = k.c AND t.place > k.h),
p AS (SELECT c, 0 AS d, '' AS name, 0 AS chars FROM k
      UNION ALL SELECT c, d, sha256(string_agg(name, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)), chars FROM s),
q AS (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS is_end FROM p),
n AS (SELECT name, min(c) AS c, any_value(d) AS d, any_value(parent) AS parent, any_value(chars) AS chars, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM q GROUP BY name),
v AS (SELECT *, (SELECT count(*) FROM n x WHERE x.parent = n.name) AS n_children FROM n),
u AS (SELECT q.name, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
      FROM v JOIN q ON q.c = v.c AND q.d <= v.d GROUP BY q.name)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, w.c AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.name = v.name LEFT JOIN v w ON w.name = v.parent
"""
