"""Repair of conversation structure by dynamic programming over a grammar.

A turn is, for its repair, one of nine symbols: what its role begins with, and
whether it must go or ends early. Conversations are words over these symbols,
and the same stretches come again and again, so the words are compressed by
Re-Pair: in every round the most frequent pairs of neighbours become rules,
counted by Spark over the distinct words with their numbers of conversations.

A symbol's transfer matrix holds, for each two states of the automaton of
legal role orders, the cheapest edits that lead from one to the other: their
cost and a rope of their letters. A rule's matrix is the min-plus product of
those of its two symbols, computed once, bottom-up; its ropes share theirs. A
conversation is the product of the few matrices that its word is parsed to.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank and
duplicate turns must go), Insert an empty turn of user or assistant (5); a turn
that ends early and stays adds 5. A sequence of letters has one meaning: next
after a user is an assistant, else a user. So no cheapest rope of two states is
the beginning of another, and taking the least of each part gives the least of
the whole.

A conversation is worked on in words of at most ``WORD`` turns; longer ones
multiply their words' matrices pairwise in a tree. Texts are read in order as a
stream when repaired turns are written or hashed, so memory does not grow with
a conversation.

Defined cases: null role and text are one space; turns are ordered by (turn,
role, text), nulls first; repeated rows are turns of their own; the null
conv_id is a conversation; a role that begins with none of s, u, a, an empty
one too, cannot be kept; a conversation without turns has no edits; an empty
table gives an empty one; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GAP_CHARS
from veilframe.llm.order import placed, ranged, stored
from veilframe.llm.tries import turn_name

#: Turns of a word; rounds of Re-Pair, and pairs looked at in each. They decide how much is shared, not what comes out.
WORD, ROUNDS, PAIRS = 4096, 10, 64
#: Distinct words whose result a task remembers.
REMEMBERED = 50_000

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: States: nothing yet, after system, after user, after assistant. What user or assistant comes next, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
EARLY = 5  # added for a turn that ends early and stays
#: Symbols: g must go; s, u, a and o for any other role; in capitals if the turn ends early.
GONE, SYMBOLS = "g", "gsuaoSUAO"

_NO_BLANK = f"[^{GAP_CHARS}]"
_AUDIT = "_group string, cost long, audit string"
_MATRIX = "array<struct<cost:long,audit:string>>"


class Rope:
    """Letters of edits, as a text or as two ropes one after the other."""

    __slots__ = ("left", "right")

    def __init__(self, left, right=None):
        self.left, self.right = left, right

    def __add__(self, other: Rope) -> Rope:
        return Rope(self, other)

    def __str__(self) -> str:
        parts, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.right is None:
                parts.append(rope.left)
            else:
                stack += (rope.right, rope.left)
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        a, b = self, other
        while a.right is not None and b.right is not None and a.left is b.left:
            a, b = a.right, b.right  # what they share does not decide
        return str(a) < str(b)


#: [from][to]: (cost, rope) of the cheapest edits, or None.
Matrix = list[list[tuple[int, Rope] | None]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus, ties to the rope that is less; ``a`` may have any number of rows."""
    def best(row: list, q: int) -> tuple[int, Rope] | None:
        found = [(row[r][0] + b[r][q][0], row[r][1] + b[r][q][1]) for r in range(4) if row[r] and b[r][q]]
        return min(found, default=None)

    return [[best(row, q) for q in range(4)] for row in a]


def _inserts(p: int) -> Iterator[tuple[int, int]]:
    """The states that inserted turns lead to, each with the least number of them."""
    seen, n = set(), 0
    while p not in seen:
        seen.add(p)
        yield p, n
        p, n = NEXT[p], n + 1


def symbol_matrix(symbol: str) -> Matrix:
    """Turns inserted before it, then the turn's own edit."""
    early = EARLY if symbol.isupper() else 0
    matrix: Matrix = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for r, n in _inserts(p):
            edits = [(DELETE, r, 0)]
            if symbol != GONE:
                edits.append((REROLE, NEXT[r], early))
                kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(symbol.lower())
                if kept is not None and (kept == NEXT[r] or (kept == SYSTEM and r == START)):
                    edits.append((KEEP, kept, early))
            for letter, q, more in edits:
                found = (n * COST[INSERT] + COST[letter] + more, Rope(INSERT * n + letter))
                matrix[p][q] = min(matrix[p][q], found) if matrix[p][q] else found
    return matrix


def finish(row: list[tuple[int, Rope] | None]) -> tuple[int, str]:
    """The cheapest of the edits that lead to each state, with turns inserted at the end up to a legal order."""
    found = []
    for p, entry in enumerate(row):
        if entry:
            n = next(n for q, n in _inserts(p) if q in ACCEPTED)
            found.append((entry[0] + n * COST[INSERT], entry[1] + Rope(INSERT * n)))
    cost, rope = min(found)
    return cost, str(rope)


class Grammar(NamedTuple):
    """``rounds`` of rules: pairs of symbols, numbers from 0, and the symbol of each pair."""

    rounds: tuple[dict[tuple[int, int], int], ...] = ()

    @property
    def size(self) -> int:
        return len(SYMBOLS) + sum(map(len, self.rounds))

    def parse(self, word: str) -> list[int]:
        symbols = [SYMBOLS.index(c) for c in word]
        for rules in self.rounds:
            out, i = [], 0
            while i < len(symbols):
                rule = rules.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
                out.append(symbols[i] if rule is None else rule)
                i += 1 if rule is None else 2
            symbols = out
        return symbols

    def matrices(self) -> list[Matrix]:
        """One for each symbol, a rule's from those of its pair."""
        found = [symbol_matrix(s) for s in SYMBOLS]
        for rules in self.rounds:
            found += [product(found[a], found[b]) for a, b in rules]
        return found

    def expand(self, symbol: int) -> str:
        pairs = [pair for rules in self.rounds for pair in rules]
        if symbol < len(SYMBOLS):
            return SYMBOLS[symbol]
        return "".join(map(self.expand, pairs[symbol - len(SYMBOLS)]))


def learn(words: DataFrame, rounds: int = ROUNDS) -> Grammar:
    """The grammar of ``word`` and ``n``, how often it occurs. In a round no two pairs share a
    symbol, so all of them are replaced at once as they would be one by one. At most ``PAIRS`` rows
    come to the driver in a round; a grammar has at most ``ROUNDS * PAIRS`` rules."""
    grammar = Grammar()
    for _ in range(rounds):
        def count(batches: Iterator[pa.RecordBatch], grammar: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs: Counter = Counter()
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    symbols = grammar.parse(word)
                    for pair in zip(symbols, symbols[1:], strict=False):
                        pairs[pair] += n
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([a for a, _ in pairs], pa.int32()), "b": pa.array([b for _, b in pairs], pa.int32()), "n": pa.array(list(pairs.values()), pa.int64())})

        counted = words.select("word", "n").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")
        rules: dict[tuple[int, int], int] = {}
        used: set[int] = set()
        for a, b, _ in counted.orderBy(F.desc("n"), "a", "b").limit(PAIRS).collect():
            if used.isdisjoint((a, b)):
                rules[a, b] = grammar.size + len(rules)
                used |= {a, b}
        if not rules:
            break
        grammar = Grammar((*grammar.rounds, rules))
    return grammar


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) with the faults that a hash of conversation
    and turn gives them, nulls as one space. ``_group`` is the conversation's id as text."""
    group, blank = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(" ")
    rows = turns.select(group.alias("_group"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat("_group", F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("_fault", F.crc32(key.cast("binary")) % 20).filter("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "_group", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


class Examined(NamedTuple):
    """The turns in order (``_group, turn, role, text, place``), what is wrong with each
    (``_group, place, kind, symbol, initial, turn``), and words of symbols (``_group, part, parts, word, initials``)."""

    turns: DataFrame
    faults: DataFrame
    words: DataFrame


def examine(turns: DataFrame, word: int = WORD) -> Examined:
    """Faults of ``_group, turn, role, text``. The first of equal turns is found by its place, so
    a text that fills a conversation is aggregated, not gathered."""
    initial = F.substring("role", 1, 1)
    kind = F.when(~F.col("text").rlike(_NO_BLANK), "blank").when(
        ~F.col("text").rlike(rf"[.!?][{GAP_CHARS}]*\z"), "truncated")
    written, sizes = ranged(turns, "_group", ["turn", "role", "text"], [
        "turn", "role", "text", kind.alias("kind"), initial.alias("initial"), turn_name(F.col("role"), F.col("text")).alias("name")])
    rows = placed(written, sizes, "_total")
    slim = rows.select("_group", "place", "turn", "kind", "initial", "name", "_total")
    firsts = slim.groupBy("_group", "name").agg(F.min("place").alias("place")).select("_group", "place", F.lit(True).alias("_new"))
    fault = F.when(F.col("kind") == "blank", "blank").when(F.col("_new").isNull(), "duplicate").otherwise(F.col("kind"))
    faults = slim.join(firsts, ["_group", "place"], "left").withColumn("kind", fault)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("kind").isin("blank", "duplicate"), GONE).when(F.col("kind") == "truncated", F.upper(letter)).otherwise(letter)
    faults = stored(faults.select("_group", "place", "turn", "kind", "initial", symbol.alias("symbol"), "_total"), "faults")
    part = F.floor((F.col("place") - 1) / word)
    parts = faults.groupBy("_group", part.alias("part"), F.floor((F.col("_total") - 1) / word + 1).alias("parts")).agg(
        F.sort_array(F.collect_list(F.struct("place", "symbol", "initial"))).alias("t"))
    words = parts.select("_group", "part", "parts", F.array_join("t.symbol", "").alias("word"), F.col("t.initial").alias("initials"))
    return Examined(rows.select("_group", "turn", "role", "text", "place"), faults, stored(words, "words"))


def _out(rows: Sequence[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


_PA_MATRIX = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _flat(matrix: Matrix) -> list[dict | None]:
    return [{"cost": e[0], "audit": str(e[1])} if e else None for row in matrix for e in row]


def _square(flat: list[dict | None]) -> Matrix:
    entries = [(e["cost"], Rope(e["audit"])) if e else None for e in flat]
    return [entries[4 * p : 4 * p + 4] for p in range(4)]


def audits(words: DataFrame, grammar: Grammar) -> DataFrame:
    """``_group``, ``cost`` and ``audit`` of the cheapest edits of each conversation."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, known = grammar.matrices(), {}

        def solve(word: str) -> tuple[int, str]:
            row: list = [(0, Rope("")), None, None, None]
            for symbol in grammar.parse(word):
                row = product([row], matrices[symbol])[0]
            return finish(row)

        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            found = []
            for group, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in known:
                    known[word] = solve(word)
                found.append((group, *known[word]))
            yield _out(found, ("_group", "cost", "audit"), (pa.string(), pa.int64(), pa.string()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = grammar.matrices()
        for batch in batches:
            found = []
            for group, part, word in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                symbols = grammar.parse(word)
                matrix = matrices[symbols[0]]
                for symbol in symbols[1:]:
                    matrix = product(matrix, matrices[symbol])
                found.append((group, part, _flat(matrix)))
            yield _out(found, ("_group", "part", "matrix"), (pa.string(), pa.int64(), _PA_MATRIX))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for group, part, some in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix = _square(some[0])
                for other in some[1:]:
                    matrix = product(matrix, _square(other))
                found.append((group, part, _flat(matrix)))
            yield _out(found, ("_group", "part", "matrix"), (pa.string(), pa.int64(), _PA_MATRIX))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield _out([(g, *finish(_square(m)[START])) for g, m in rows], ("_group", "cost", "audit"), (pa.string(), pa.int64(), pa.string()))

    short = words.filter("parts = 1").select("_group", "word").mapInArrow(whole, _AUDIT)
    most = words.agg(F.max("parts")).first()[0] or 0
    if most < 2:
        return short
    schema = f"_group string, part long, matrix {_MATRIX}"
    tree = stored(words.filter("parts > 1").select("_group", "part", "word").mapInArrow(partial, schema), "matrices")
    while most > 1:
        two = tree.groupBy("_group", F.floor(F.col("part") / 2).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("at"), "matrix"))).alias("t"))
        tree = stored(two.select("_group", "part", F.col("t.matrix").alias("some")).mapInArrow(pairs, schema), "matrices")
        most = (most + 1) // 2
    return short.unionByName(tree.select("_group", "matrix").mapInArrow(ends, _AUDIT))


class _Editor:
    """Applies the letters of a conversation to its turns, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _emit(self, letter: str, role: str | None, text: str) -> tuple[str, str, str]:
        if role is None:
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        else:
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        return letter, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._emit(INSERT, None, "")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            yield self._emit(letter, role if letter == KEEP else None, text)


def _edited(turns: DataFrame, audits: DataFrame, schema: str, begin: Callable, add: Callable, names: Sequence[str], kinds: Sequence[pa.DataType]) -> DataFrame:
    """Turns read in order, each conversation after its audit. ``begin(group)`` gives what a
    conversation carries, ``add(carried, edits, last)`` the rows that some of its edits give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = carried = None
        for batch in batches:
            found = []
            for group, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if editor is not None:
                        found += add(carried, editor.inserted(), True)
                    editor, carried = _Editor(text), begin(group)
                else:
                    found += add(carried, editor.turn(role, text), False)
            yield _out(found, names, kinds)
        if editor is not None:
            yield _out(add(carried, editor.inserted(), True), names, kinds)

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = audits.select("_group", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = first.unionByName(turns.select("_group", "place", "role", "text"))
    return rows.repartition(n, "_group").sortWithinPartitions("_group", "place").mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns after repair: ``_group``, ``n`` from 1, ``edit``, ``role``, ``text``."""

    def add(carried: list, edits: Iterator, last: bool) -> list[tuple]:
        out = []
        for edit in edits:
            carried[1] += 1
            out.append((carried[0], carried[1], *edit))
        return out

    return _edited(turns, audits, "_group string, n long, edit string, role string, text string", lambda group: [group, 0], add,
                   ("_group", "n", "edit", "role", "text"), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))


def repaired_digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``_group`` and ``digest``, the SHA-256 of the repaired turns as ``role:text``, joined by line feeds."""

    def add(carried: list, edits: Iterator, last: bool) -> list[tuple]:
        for _, role, text in edits:
            carried[1].update(f"{carried[2]}{role}:{text}".encode())
            carried[2] = "\n"
        return [(carried[0], carried[1].hexdigest())] if last else []

    return _edited(turns, audits, "_group string, digest string", lambda group: [group, hashlib.sha256(), ""], add,
                   ("_group", "digest"), (pa.string(), pa.string()))


def illegal_neighbours(words: DataFrame) -> DataFrame:
    """``_group`` and ``illegal``: neighbouring turns that begin with other than su, ua, au."""
    legal = ["su", "ua", "au"]
    # Each word after the last initial of the word before it; only long conversations have such.
    before = words.filter("parts > 1").select("_group", (F.col("part") + 1).alias("part"), F.element_at("initials", -1).alias("_last"))
    rows = words.filter("parts = 1").withColumn("_last", F.lit(None).cast("string")).unionByName(
        words.filter("parts > 1").join(before, ["_group", "part"], "left"))
    joined = F.when(F.col("_last").isNull(), F.col("initials")).otherwise(F.concat(F.array("_last"), F.col("initials")))
    rows = rows.select("_group", joined.alias("i"))
    bad = F.expr(f"size(filter(transform(slice(i, 2, size(i)), (x, k) -> concat(i[k], x)), p -> p not in ({', '.join(map(repr, legal))})))")
    return rows.groupBy("_group").agg(F.sum(bad.cast("long")).alias("illegal"))


def repair(turns: DataFrame, word: int = WORD) -> tuple[Examined, DataFrame]:
    """What :func:`examine` finds in the turns (``_group, turn, role, text``), and the cheapest edits of each conversation."""
    found = examine(turns, word)
    grammar = learn(stored(found.words.groupBy("word").agg(F.count("*").alias("n")), "distinct-words"))
    return found, stored(audits(found.words, grammar), "audits")


def query(turns: DataFrame, word: int = WORD) -> DataFrame:
    found, edits = repair(damaged(turns), word)
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    counts = found.faults.groupBy("_group").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), *kinds)
    rows = turns.select("conv_id").distinct().withColumn("_group", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    for more in (counts, illegal_neighbours(found.words), edits, repaired_digests(found.turns, edits)):
        rows = rows.join(more, "_group", "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(
        "conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
