"""URL filters from association rules.

A URL is a set of tokens: labels of its host from the right, words of them,
segments of its path by place with digits as ``#``, their first characters, the
extension, names of parameters, scheme and fragment. Spark's FP-growth finds
the token sets that go with a label often enough; sets whose label is certain
enough become rules, and a rule goes if a more general one with the same
verdict is as certain. URLs meet rules through an inverted index: a rule lies
under its rarest token, so a URL looks at the rules of its own tokens only.
Of the rules that hold, the most certain decides, then the best supported.

A list of host and path prefixes given by hand comes first: where one fits, the
longest decides, and the rules are not asked. In the registered query, which
has no other labels of pages, the URLs that the list decides are the labels.

Bounds of the fit, all parameters: at most ``max_labelled`` different labelled
URLs, chosen by a hash; of a URL the ``width`` tokens that tell most about the
label take part in sets; ``max_rules`` rules. Copies of a URL count once, with
the label that most of them have. Matching takes every URL and all its tokens,
and needs no shuffle; what travels to the tasks is the bounded rules.

Defined cases: a null URL, or one without ``://``, has empty host and path and
no tokens; what no rule fits is allowed; without labels there are no rules;
page ids may be null or repeat; an empty table gives an empty one; further
columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chosen
from veilframe.llm.order import stored

#: Fixed: host, then the path's beginning after the first slash, and the verdict.
LISTED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Least share and least number of labelled URLs that a rule holds for with its verdict, and least share of those with its tokens.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 10, 0.9
MAX_LABELLED, MAX_ITEMS, WIDTH, MAX_RULES = 200_000, 2_000, 8, 10_000
DEFAULT = "allow"
_VERDICT = "verdict="

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    items: frozenset[str]
    verdict: str
    confidence: float
    support: float


def parts(url: str = "url") -> dict[str, Column]:
    """``host`` and ``path`` of a URL, empty if it has none."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1),
    }


def listed(rules: Sequence[tuple[str, str]] = LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits ``host`` and ``path``, and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, decided in sorted(rules, key=lambda r: len(r[0])):
        host, _, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """The distinct tokens of a URL with columns ``host`` and ``path``."""
    text = F.translate(F.coalesce(F.col(url).cast("string"), F.lit("")), UPPER, LOWER)
    labels = F.reverse(F.split("host", r"\."))
    segments = F.filter(F.split(F.translate("path", UPPER, LOWER), "/"), lambda s: s != "")
    # Numbers differ from page to page, their places and lengths tell more.
    shape = lambda s: F.regexp_replace(s, "[0-9]", "#")
    place = lambda i: (i + 1).cast("string")
    query = F.regexp_extract(text, r"://[^?#]*\?([^#]*)", 1)
    named = lambda name, many: F.transform(many, lambda x: F.concat(F.lit(f"{name}:"), x))
    every = F.concat(
        F.transform(labels, lambda s, i: F.concat(F.lit("h"), place(i), F.lit(":"), s)),
        named("w", F.split("host", r"[.\-_]+")),
        F.transform(segments, lambda s, i: F.concat(F.lit("p"), place(i), F.lit(":"), shape(s))),
        F.transform(segments, lambda s, i: F.concat(F.lit("p"), place(i), F.lit("^"), F.substring(s, 1, 1))),
        named("x", F.array(F.regexp_extract(F.translate("path", UPPER, LOWER), r"\.([a-z0-9]+)$", 1))),
        named("q", F.transform(F.split(query, "&"), lambda s: F.substring_index(s, "=", 1))),
        named("f", F.array(F.regexp_extract(text, r"://[^#]*#(.*)", 1))),
        named("s", F.array(F.regexp_extract(text, r"^([a-z][a-z0-9+.\-]*)://", 1))),
    )
    full = F.filter(every, lambda t: ~F.substring(t, -1, 1).isin(":", "^"))
    return F.when(F.instr(text, "://") > 0, F.array_distinct(full)).otherwise(F.array().cast("array<string>"))


def transactions(labelled: DataFrame, max_labelled: int = MAX_LABELLED, min_support: float = MIN_SUPPORT, width: int = WIDTH, max_items: int = MAX_ITEMS) -> DataFrame:
    """``items`` of the labelled URLs (``url``, ``verdict``): their most telling tokens and the verdict."""
    rows = labelled.filter("url is not null and verdict is not null")
    once = rows.groupBy("url").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("share"))
    there = once.count()
    sample = once.filter(chosen("url", max_labelled // 4, there)) if there > max_labelled else once
    sample = sample.select("url", F.when(F.col("share") >= 0.5, "block").otherwise("allow").alias("verdict"))
    sample = stored(sample.withColumns(parts()).select("url", "verdict", tokens().alias("tokens")), "labelled-urls")
    sizes = sample.agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("block")).first()
    n, block = sizes["n"], sizes["block"]
    each = sample.select("url", "verdict", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    # What a token tells about the label: mutual information, from the four counts.
    total, blocks, a, b = F.lit(float(n)), F.lit(float(block)), F.col("a"), F.col("b")
    term = lambda joint, x, y: F.when(joint > 0, joint / total * F.log(joint * total / (x * y))).otherwise(0.0)
    tells = (term(b, a, blocks) + term(a - b, a, total - blocks) + term(blocks - b, total - a, blocks)
             + term(total - a - blocks + b, total - a, total - blocks))
    items = counts.filter(F.col("a") >= min_support * n).select("token", F.round(-tells, 12).alias("_rank"), "a")
    items = items.orderBy("_rank", F.desc("a"), "token").limit(max_items).select("token", "_rank")
    chosen_items = each.join(items, "token").groupBy("url", "verdict").agg(F.slice(F.array_sort(F.collect_list(F.struct("_rank", "token"))), 1, width).alias("t"))
    return chosen_items.select(F.concat("t.token", F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT,
         max_rules: int = MAX_RULES, **bounds: int) -> list[Rule]:
    """The rules that the labelled URLs (``url``, ``verdict``) give, pruned, the strongest first."""
    baskets = stored(transactions(labelled, min_support=min_support, **bounds), "url-items")
    n = baskets.count()
    if n < min_count:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence, numPartitions=int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    verdict = F.col("consequent")[0]
    found = model.associationRules.filter(verdict.startswith(_VERDICT)).select(
        F.array_sort("antecedent").alias("items"), F.substring_index(verdict, "=", -1).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    top = found.orderBy(F.desc("confidence"), F.desc("support"), F.size("items"), "items", "verdict").limit(max_rules).collect()
    return prune([Rule(frozenset(r["items"]), r.verdict, r.confidence, r.support) for r in top])


def prune(rules: list[Rule]) -> list[Rule]:
    """Without rules that a more general one with the same verdict makes needless."""
    kept: list[Rule] = []
    by_item: dict[str, list[Rule]] = defaultdict(list)
    for rule in sorted(rules, key=lambda r: (len(r.items), -r.confidence, -r.support, sorted(r.items))):
        wider = (g for item in rule.items for g in by_item[item])
        if not any(g.items <= rule.items and g.verdict == rule.verdict and g.confidence >= rule.confidence for g in wider):
            kept.append(rule)
            by_item[min(rule.items)].append(rule)
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, len(r.items), sorted(r.items), r.verdict))


class Index:
    """Rules under their rarest token; the place in the list is the rank."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules, self.under = rules, defaultdict(list)
        often: dict[str, int] = defaultdict(int)
        for rule in rules:
            for item in rule.items:
                often[item] += 1
        for rank, rule in enumerate(rules):
            self.under[min(rule.items, key=lambda item: (often[item], item))].append(rank)

    def find(self, tokens: Sequence[str]) -> Rule | None:
        """The first of the rules whose tokens are all there."""
        there, best = set(tokens), None
        for token in there:
            for rank in self.under.get(token, ()):
                if best is not None and rank >= best:
                    break
                if self.rules[rank].items <= there:
                    best = rank
        return None if best is None else self.rules[best]


def judge(rows: DataFrame, rules: Sequence[Rule], lists: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the mined rule that decided, ``mined`` with its ``confidence``."""
    rule, verdict = listed(lists)
    located = rows.select("page_id", "url", *[c.alias(name) for name, c in parts().items()])
    ready = located.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(rule.isNull(), tokens()).alias("tokens"))
    shared = ready.sparkSession.sparkContext.broadcast(Index(list(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            verdicts, mined, confidence = [], [], []
            for given, some in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                found = index.find(some) if some else None
                verdicts.append(given or (found.verdict if found else DEFAULT))
                mined.append(" & ".join(sorted(found.items)) if found else None)
                confidence.append(found.confidence if found else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(mined, pa.string()), pa.array(confidence, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "mined", "confidence"])

    kind = dict(rows.dtypes)["page_id"]
    return ready.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, mined string, confidence double")


def labels_by_list(rows: DataFrame, lists: Sequence[tuple[str, str]] = LISTED) -> DataFrame:
    """``url`` and ``verdict`` of the URLs that the list decides."""
    return rows.select("url", *[c.alias(name) for name, c in parts().items()]).select("url", listed(lists)[1].alias("verdict")).filter("verdict is not null")


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, mine(labels_by_list(pages)))
