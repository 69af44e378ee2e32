"""Toxicity by a support vector machine over a string kernel.

The kernel counts common subsequences: two words are alike by the gap-weighted
subsequences of three characters (with marks for begin and end) within a span
of seven, so inserted and skipped characters lower the likeness but do not end
it. Landmark words span a Nyström space; a linear machine is trained there by
hinge loss. A sentence is as toxic as its most telling word, and so is a text;
which words of a toxic text are meant is learned in turns with the machine
(multi-instance training), starting from words that are much more frequent in
toxic texts. Disguised spellings of those words are added to the training rows.

A linear function in that space is one weight for each subsequence, so a word
is scored by summing weights over its own subsequences, whatever the number of
landmarks. Each different word of a batch is scored once.

Training takes a bounded sample of labelled rows (``max_toxic`` and
``max_clean``) to the driver, and of a text over ``LEARN_CHARS`` characters a
window of so many at a place that the hash of its id chooses; scoring is a scan
of whole texts.

Defined cases: a null or empty text has no words and gets the score of an empty
text; a null id is held out and never learned from; repeated labels of an id
count once, the toxic one first; without labels of both kinds every score is
0.0; repeated rows and empty tables give as many rows; further columns are not
looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chosen

#: Weight of each skipped character, and the longest span of a subsequence.
DECAY, SPAN = 0.6, 7
#: Labelled rows that training takes at most.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Characters of a text that are learned from.
LEARN_CHARS = 10_000
LANDMARKS = 200
ROUNDS = 4
FOLDS = 5
#: Words that a worker remembers.
REMEMBERED = 400_000
#: Texts whose words a worker holds.
AT_ONCE = 400

_SIZE = 64
_CODES = np.full(65536, 0, np.int32)
for _i, _c in enumerate("^$abcdefghijklmnopqrstuvwxyzàâäáãçéèêëíîïñóôöõßúùûü"):
    _CODES[ord(_c)] = _i + 1
_CODES[_CODES == 0] = 50 + np.flatnonzero(_CODES == 0) % (_SIZE - 50)
_PAIRS = [(d1, d2) for d2 in range(2, SPAN) for d1 in range(1, d2)]

# Digits and signs written for letters.
_LEET = str.maketrans("013457@$", "oieastas")
_NOT_LETTER = re.compile(r"[\W_]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!]|[\d@$!][^\W\d_]")


def words_of(text: str) -> list[str]:
    """The words as the kernel sees them: letters in lower case; single letters in a row are one word."""
    out, single = [], []
    for token in text.lower().split():
        if not token.isalpha():
            if not token.isascii() or not token.isalnum():
                if _MIXED.search(token):
                    token = token.rstrip("!.,?").translate(_LEET)
                token = _NOT_LETTER.sub("", token)
            else:
                token = token.translate(_LEET)
            if not token:
                continue
        if len(token) == 1:
            single.append(token)
            continue
        if single:
            if len(single) > 2:
                out.append("".join(single))
            single = []
        out.append(token)
    if len(single) > 2:
        out.append("".join(single))
    return out


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words, marked, in one row of codes, and the word of each place."""
    marked = [f"^{w}$" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    return _CODES[np.minimum(points, 65535)], np.repeat(np.arange(len(words)), [len(m) for m in marked])


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps the word and the number of every subsequence, and its weight."""
    codes, word = _coded(words)
    for d1, d2 in _PAIRS:
        if len(codes) > d2:
            inside = word[:-d2] == word[d2:]
            number = codes[:-d2] * (_SIZE * _SIZE) + codes[d1 : len(codes) - d2 + d1] * _SIZE + codes[d2:]
            yield word[:-d2][inside], number[inside], DECAY ** (d2 - 2)


def norms(words: list[str]) -> np.ndarray:
    """What the kernel is divided by: the root of the squared weights of a word's subsequences."""
    lengths = np.array([len(w) + 2 for w in words])
    total = sum(np.maximum(lengths - d2, 0) * DECAY ** (2 * (d2 - 2)) for _, d2 in _PAIRS)
    return np.sqrt(np.maximum(total, 1.0))


def dense(words: list[str], every: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A row of weights for each word over the given subsequences, else over those that occur."""
    parts = list(subsequences(words))
    if every is None:
        every = np.unique(np.concatenate([n for _, n, _ in parts])) if parts else np.zeros(0, np.int64)
    place = np.full(_SIZE**3, -1, np.int32)
    place[every] = np.arange(len(every))
    out = np.zeros(len(words) * len(every), np.float32)
    for word, number, weight in parts:
        at = place[number]
        np.add.at(out, word[at >= 0] * len(every) + at[at >= 0], np.float32(weight))
    return out.reshape(len(words), len(every)) / norms(words)[:, None].astype(np.float32), every


@dataclass(frozen=True)
class Model:
    """``weights`` by subsequence; ``bias``; the logistic map of a text's features to a score."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, ...]

    def margins(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words))
        for word, number, weight in subsequences(words):
            total += np.bincount(word, self.weights[number], len(words)) * weight
        return total / norms(words) + self.bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(features @ np.array(self.scale), -30, 30)
        return 1 / (1 + np.exp(-z))


def features(margins: list[float]) -> list[float]:
    """Of a text: its most telling word, the second, the length, one."""
    top = sorted(margins, reverse=True)[:2] if len(margins) < 3 else _two(margins)
    top = [*top, -3.0, -3.0][:2]
    return [max(-3.0, min(3.0, top[0])), max(-3.0, min(3.0, top[1])), math.log1p(len(margins)) / 10, 1.0]


def _two(values: list[float]) -> list[float]:
    first = max(values)
    at = values.index(first)
    return [first, max(max(values[:at], default=-9.0), max(values[at + 1 :], default=-9.0))]


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """Spellings with an inserted letter, a doubled one, and one left out."""
    i, j, k = rng.integers(1, max(2, len(word)), 3)
    letter = "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)]
    return [word[:i] + letter + word[i:], word[:j] + word[j - 1] + word[j:], *([word[:k] + word[k + 1 :]] if len(word) > 5 else [])]


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """A linear machine by averaged descent on the squared hinge."""
    theta, speed = start.copy(), np.zeros_like(start)
    total = weight.sum()
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ theta))
        slope = 2e-4 * theta - 2 * (x.T @ (weight * y * slack)) / total
        speed = 0.9 * speed - 1.0 * slope
        theta = theta + speed
    return theta


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + 1e-2 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        theta -= np.linalg.solve(curve, slope)
    return theta


def train(rows: Iterable[tuple[str, int]], landmarks: int = LANDMARKS, seed: int = 5) -> Model | None:
    """The machine of (text, label) rows; None unless there are labels of both kinds."""
    rng = np.random.default_rng(seed)
    texts = [(words_of(text), label) for text, label in sorted(rows) if text]
    toxic = [w for w, label in texts if label]
    clean = [w for w, label in texts if not label]
    if not toxic or not clean:
        return None
    in_toxic, in_clean = Counter(), Counter()
    for w in toxic:
        in_toxic.update(set(w))
    for w in clean:
        in_clean.update(set(w))
    lead = {w: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((in_clean[w] + 0.5) / (len(clean) + 1)) for w, n in in_toxic.items()}
    telling = sorted((w for w, n in in_toxic.items() if n >= 3 and lead[w] > 1), key=lambda w: (-in_toxic[w] * lead[w], w))[: landmarks // 2]
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    rest = common[: landmarks // 4] + [common[i] for i in sorted(rng.choice(len(common), min(len(common), landmarks // 4), replace=False))]
    marks = sorted({*telling, *rest})
    rows_z, every = dense(marks)
    values, vectors = np.linalg.eigh((rows_z @ rows_z.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    to = (rows_z.T @ root).astype(np.float32)

    def space(words: list[str]) -> np.ndarray:
        parts = [dense(words[i : i + 1000], every)[0] @ to for i in range(0, len(words), 1000)]
        return np.hstack([np.vstack(parts), np.ones((len(words), 1))])

    def model(theta: np.ndarray, scale: tuple[float, ...] = ()) -> Model:
        weights = np.zeros(_SIZE**3)
        weights[every] = rows_z.T @ (root @ theta[:-1])
        return Model(weights, float(theta[-1]), scale)

    vocabulary = sorted({w for words, _ in texts for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    no = np.array([number[w] for w in sorted(in_clean)])
    hard = rng.choice(no, min(len(no), 6_000), replace=False)
    hard = np.union1d(hard, [number[w] for w in common[:1500]])
    witness = [max(set(w), key=lambda x: (lead[x] if in_toxic[x] > 2 else -9, x)) for w in toxic if w]
    witness = [w for w in witness if lead[w] > 1 and in_toxic[w] > 2] or witness
    theta = None
    for _ in range(ROUNDS):
        yes = Counter(witness)
        extra = Counter()
        for w, n in yes.items():
            for d in disguised(w, rng):
                if d not in in_clean:
                    extra[d] += n / 3
        words = [*yes, *extra, *[vocabulary[i] for i in hard]]
        y = np.array([1.0] * (len(yes) + len(extra)) + [-1.0] * len(hard))
        weight = np.array([*yes.values(), *extra.values(), *[1 + in_clean[vocabulary[i]] ** 0.5 for i in hard]], float)
        up = y > 0
        weight[up] = np.sqrt(weight[up])
        weight[up] *= 0.5 * weight[~up].sum() / weight[up].sum()
        x = space(words)
        theta = _hinge(x, y, weight, np.zeros(x.shape[1]) if theta is None else theta)
        margins = model(theta).margins(vocabulary)
        worst = no[np.argsort(-margins[no])[:2000]]
        hard = np.union1d(hard, worst[margins[worst] > -1])
        witness = []
        for words_ in toxic:
            best = max(set(words_), key=lambda x: (margins[number[x]], x), default=None)
            if best is not None and margins[number[best]] > 0:
                witness.append(best)
        if not witness:
            break
    table = np.array([features([margins[number[w]] for w in words]) for words, _ in texts])
    labels = np.array([float(label) for _, label in texts])
    return model(theta, tuple(_logistic(table, labels).tolist()))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> list[tuple[str, int]]:
    """At most so many labelled texts outside the held-out fold, chosen by a hash of their ids."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out())
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # a row for each label
    ids = {}
    for label, most in ((1, max_toxic), (0, max_clean)):
        some = known.filter(F.col("toxic") == label).filter(chosen("doc_id", most, there.get(label, 0)))
        ids |= {r.doc_id: r.toxic for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(list(ids.items()), "_id long, toxic int")
    # The sample is at most max_toxic + max_clean rows, so it may be broadcast.
    low = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - LEARN_CHARS, F.lit(0)) + 1).cast("int") + 1
    window = F.substr(F.col("text"), low, F.lit(LEARN_CHARS)).alias("text")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", window).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    return [(r.text or "", r.toxic) for r in rows.collect()]


_known: dict[str, dict[str, float]] = {}


def _scores(model: Model, known: dict[str, float], column: pa.Array) -> np.ndarray:
    """The score of each text, some at a time."""
    parts = [_some_scores(model, known, column.slice(i, AT_ONCE).to_pylist()) for i in range(0, len(column), AT_ONCE)]
    return np.concatenate([np.zeros(0), *parts])


def _some_scores(model: Model, known: dict[str, float], texts: list[str | None]) -> np.ndarray:
    """The score of each text; ``known`` has the margins of words met so far."""
    if len(known) > REMEMBERED:
        known.clear()
    words = [words_of(t) if t else [] for t in texts]
    new = list({w for ws in words for w in ws}.difference(known))
    for i in range(0, len(new), 50_000):
        some = new[i : i + 50_000]
        known.update(zip(some, model.margins(some).tolist(), strict=True))
    return model.score(np.array([features([known[w] for w in ws]) for ws in words]).reshape(-1, 4))


def _remembered(key: str) -> dict[str, float]:
    if key not in _known:
        _known.clear()
        _known[key] = {}
    return _known[key]


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` of the rows' texts."""
    rows = rows.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared, key = rows.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, _remembered(key), batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    return train(sample(docs, labels, max_toxic, max_clean))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, _remembered(key), batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
