"""Main text of web pages by a tree-structured graphical model.

The nodes are the block elements of a page and the text runs in them, each
content or not. A node's own evidence (tag, class names, amount and kind of
text) gives its potential; a table of potentials couples every node with its
parent, one for text runs and one for elements. Messages go from the leaves up
and from the root down, and give each node its marginal: sum-product, exact on
a tree. Some pages are one forest, passed level by level; memory is in proportion to the
nodes of the largest page, or ``NODES``.

The weights are trained by the likelihood of whole labelled trees. Labelled
pages are a bounded sample (``max_pages``, none over ``MAX_HTML`` characters) of
the pages that mark their article; of each, further labelled pages are made by
writing its text into other page layouts, with the menus, side bars, notices,
forms and reader comments that such pages have, so that the model does not hang
on one layout. Extraction itself is a scan.

Defined cases: a null page is empty; pages without text give an empty one; null
ids and repeated rows keep a row each; without any labelled page the model knows
the made layouts only; an empty table gives an empty one; columns other than id,
url and html are not looked at. A line break inside a block counts as white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import chosen
from veilframe.llm.dom import Node, parse

#: Bounds of the fit: pages, characters of a page, and of a page the runs of its article that the made pages
#: show and the runs that they take their menus, notices and comments from. Extraction has no bounds.
MAX_PAGES, MAX_HTML, ARTICLE_RUNS, OTHER_RUNS = 100, 100_000, 40, 60
VARIANTS = 5
ROUNDS = 160
#: Nodes that are worked on at a time; a page of more is worked on alone.
NODES = 20_000

#: Block elements that are never main text inside an article. Captions are.
ASIDE = frozenset("nav aside form footer".split())
_END = re.compile(r"[.!?…:;\"”»)]$")


# Names that page layouts give their parts.
CONTENT_NAMES = ("content", "article", "post", "entry-content", "post-body", "story", "article-body", "main-content", "text", "page-content", "single", "blog-post", "rich-text", "prose")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "tags", "author-bio", "toc", "rail", "secondary")
MENU_NAMES = ("nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "topbar", "links", "pagination", "skip", "site-nav")
HEAD_NAMES = ("header", "site-header", "masthead", "banner", "logo", "top", "hero", "branding")
FOOT_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal", "credits", "colophon")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsbygoogle", "promotion", "ad-slot")
NOTICE_NAMES = ("notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "newsletter", "subscribe", "popup", "modal", "disclaimer", "paywall", "message")
COMMENT_NAMES = ("comments", "comment", "comment-list", "replies", "discussion", "responses", "disqus", "reply", "reader-comments")
SHARE_NAMES = ("share", "social", "meta", "byline", "byline-share", "post-meta", "actions", "toolbar", "rating")

KINDS = {
    "content": CONTENT_NAMES, "side": SIDE_NAMES, "menu": MENU_NAMES, "head": HEAD_NAMES, "foot": FOOT_NAMES, "ad": AD_NAMES,
    "notice": NOTICE_NAMES, "comment": COMMENT_NAMES, "share": SHARE_NAMES,
}


def _kinds() -> dict[str, str]:
    """The kind of every part of a name that belongs to one kind only."""
    found: dict[str, set[str]] = {}
    for kind, names in KINDS.items():
        for name in names:
            for part in name.split("-"):
                found.setdefault(part, set()).add(kind)
    return {part: next(iter(kinds)) for part, kinds in found.items() if len(kinds) == 1}


_KIND = _kinds()
_LONG = sorted(part for part in _KIND if len(part) >= 5)


def kinds_of(names: tuple[str, ...]) -> set[str]:
    """The kinds of an element's names: by the whole part, or by its beginning."""
    out = set()
    for name in names:
        kind = _KIND.get(name) or next((_KIND[part] for part in _LONG if name.startswith(part)), None)
        if kind:
            out.add(kind)
    return out


def _stats(nodes: list[Node]) -> np.ndarray:
    """Of every node: words, characters, linked characters, commas, sentence ends and runs below it."""
    out = np.zeros((len(nodes), 6))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.leaf:
            text = node.text
            out[i] = (text.count(" ") + 1, len(text), node.linked, text.count(","), bool(_END.search(text)), 1)
        if node.parent >= 0:
            out[node.parent] += out[i]
    return out


def evidence(nodes: list[Node]) -> tuple[list[list[str]], np.ndarray]:
    """Of every node its named features and its numbers."""
    stats = _stats(nodes)
    words, chars, linked, commas, ends, runs = stats.T
    total = max(words[0], 1.0)
    safe = np.maximum(words, 1.0)
    leaf = np.array([n.leaf for n in nodes], float)
    base = np.column_stack([
        np.ones(len(nodes)), np.log1p(words) / 3, linked / np.maximum(chars, 1), np.minimum(commas / safe * 5, 1.5),
        ends / np.maximum(runs, 1), words / total, np.log1p(words / np.maximum(runs, 1)) / 3, (words < 6).astype(float),
    ])
    numbers = np.hstack([base * leaf[:, None], base * (1 - leaf)[:, None]])
    named = []
    for node in nodes:
        own = [f"{'text' if node.leaf else 'tag'}:{node.tag}"]
        if node.leaf:
            up = nodes[node.parent]
            if "©" in node.text:
                own.append("text©")
            own += [f"in:{c}" for c in up.names] + [f"in-kind:{k}" for k in sorted(kinds_of(up.names))]
            if up.parent >= 0:
                own.append(f"over:{nodes[up.parent].tag}")
        else:
            own += [f"name:{c}" for c in node.names] + [f"kind:{k}" for k in sorted(kinds_of(node.names))]
        named.append(own)
    return named, numbers


@dataclass
class Forest:
    """Trees side by side; ``levels`` are the nodes of each depth from 1. ``x`` are the numbers of
    each node; its named features are pairs of ``rows`` and ``columns``."""

    parent: np.ndarray
    leaf: np.ndarray
    levels: list[np.ndarray]
    x: np.ndarray
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights of each node's evidence."""
        own = weights[self.x.shape[1] :]
        return self.x @ weights[: self.x.shape[1]] + np.bincount(self.rows, own[self.columns], len(self.parent))

    def pull(self, residual: np.ndarray, width: int) -> np.ndarray:
        """The slope of the weights by the residual of each node."""
        named = np.bincount(self.columns, residual[self.rows], width - self.x.shape[1])
        return np.concatenate([self.x.T @ residual, named])


def forest(pages: list[list[Node]], vocabulary: dict[str, int]) -> Forest:
    parent, leaf, depth, rows, columns, numbers, at = [], [], [], [], [], [], 0
    for nodes in pages:
        named, own = evidence(nodes)
        numbers.append(own)
        for i, node in enumerate(nodes):
            parent.append(node.parent + at if node.parent >= 0 else -1)
            leaf.append(node.leaf)
            depth.append(node.depth)
            for name in named[i]:
                if name in vocabulary:
                    rows.append(at + i)
                    columns.append(vocabulary[name])
        at += len(nodes)
    pairs = np.unique(np.array([rows, columns], np.int64).reshape(2, -1), axis=1)  # a name counts once a node
    d = np.array(depth, np.int64)
    order = np.argsort(d, kind="stable")
    levels = np.split(order, np.searchsorted(d[order], np.arange(1, (d.max() if at else 0) + 1)))[1:]
    return Forest(np.array(parent, np.int64), np.array(leaf, np.int64), levels, np.vstack(numbers) if at else np.zeros((0, 16)), *pairs)


def sum_product(f: Forest, unary: np.ndarray, couple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginal of each node being content, and of each (parent, node) pair of states.

    ``unary`` is the log potential of content; ``couple[leaf, parent state, state]`` those of pairs.
    """
    n = len(unary)
    up, own, message = np.zeros((n, 2)), np.column_stack([np.zeros(n), unary]), np.zeros((n, 2))
    for level in reversed(f.levels):
        total = own[level] + up[level]
        pair = couple[f.leaf[level]] + total[:, None, :]
        message[level] = np.logaddexp(pair[:, :, 0], pair[:, :, 1])
        message[level] -= message[level].max(axis=1, keepdims=True)
        np.add.at(up, f.parent[level], message[level])
    down, pairs = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for level in f.levels:
        p = f.parent[level]
        above = own[p] + up[p] + down[p] - message[level]
        pair = couple[f.leaf[level]] + above[:, :, None]
        down[level] = np.logaddexp(pair[:, 0], pair[:, 1])
        down[level] -= down[level].max(axis=1, keepdims=True)
        both = pair + (own[level] + up[level])[:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pairs[level] = both / both.sum(axis=(1, 2), keepdims=True)
    belief = own + up + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), pairs


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    couple: np.ndarray

    def marginals(self, pages: list[list[Node]]) -> np.ndarray:
        f = forest(pages, self.vocabulary)
        return sum_product(f, f.scores(self.weights), self.couple)[0]


def train(pages: list[tuple[list[Node], list[int]]]) -> Model:
    """Weights of the greatest likelihood of the labelled trees, by Adam."""
    count = Counter(name for nodes, _ in pages for names in evidence(nodes)[0] for name in set(names))
    vocabulary = {name: i for i, name in enumerate(sorted(n for n, c in count.items() if c >= 3))}
    f = forest([nodes for nodes, _ in pages], vocabulary)
    y = np.concatenate([labels for _, labels in pages]).astype(np.int64)
    inner = np.flatnonzero(f.parent >= 0)
    want = np.zeros((2, 2, 2))
    np.add.at(want, (f.leaf[inner], y[f.parent[inner]], y[inner]), 1)
    theta, couple = np.zeros(f.x.shape[1] + len(vocabulary)), np.zeros((2, 2, 2))
    m1 = m2 = n1 = n2 = 0
    for step in range(1, ROUNDS + 1):
        p, pairs = sum_product(f, f.scores(theta), couple)
        slope = f.pull(y - p, len(theta)) / len(pages) - 0.006 * theta
        have = np.zeros((2, 2, 2))
        np.add.at(have, f.leaf[inner], pairs[inner])
        pull = (want - have) / len(pages) - 0.006 * couple
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.99 * m2 + 0.01 * slope**2
        n1, n2 = 0.9 * n1 + 0.1 * pull, 0.99 * n2 + 0.01 * pull**2
        rate = 0.15 / (1 - 0.9**step)
        theta = theta + rate * m1 / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        couple = couple + rate * n1 / (np.sqrt(n2 / (1 - 0.99**step)) + 1e-6)
    return Model(vocabulary, theta, couple)


def tree_labels(nodes: list[Node], content: list[bool]) -> list[int]:
    """Labels of all nodes from those of the text runs.

    The root of the content is the lowest element over all of it, or above that one the highest
    without other text. Elements are content from there down, if half of their text is.
    """
    have, all_ = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.leaf:
            all_[i], have[i] = len(node.text), len(node.text) if content[i] else 0
        if node.parent >= 0:
            have[node.parent] += have[i]
            all_[node.parent] += all_[i]
    out = [int(c) for c in content]
    if not have[0]:
        return out
    root = max((i for i, n in enumerate(nodes) if not n.leaf and have[i] == have[0]), key=lambda i: nodes[i].depth)
    while nodes[root].parent >= 0 and all_[nodes[root].parent] == have[0]:
        root = nodes[root].parent
    below = [False] * len(nodes)
    for i, node in enumerate(nodes):
        below[i] = i == root or (node.parent >= 0 and below[node.parent])
        if not node.leaf:
            out[i] = int(below[i] and 2 * have[i] >= all_[i] > 0)
    return out


def marked(nodes: list[Node]) -> list[bool] | None:
    """Which runs a page that marks its article has inside it; None if it marks none."""
    root = "article" if any(n.tag == "article" and not n.leaf for n in nodes) else "main"
    inside, found = [False] * len(nodes), False
    for i, node in enumerate(nodes):
        above = inside[node.parent] if node.parent >= 0 else False
        if not node.leaf and node.tag == root:
            inside[i] = found = True
        else:
            inside[i] = above and (node.leaf or node.tag not in ASIDE)
    return inside if found else None


_SAID = ("Share", "Log in", "Sign up", "Subscribe now", "Search", "Menu", "Home", "Read more", "We use cookies", "Accept all", "Reply", "Your email", "Next", "All rights reserved", "Advertisement", "Submit", "Tags", "Follow us")


def made_page(texts: list[str], others: list[str], rng: np.random.Generator) -> tuple[list[Node], list[bool]]:
    """A page of some layout whose content are the texts, and which of its runs are content."""
    mark = "\x01"  # begins every content run; taken away after reading
    pick = lambda xs: xs[rng.integers(len(xs))]
    name = lambda xs: pick((f' class="{pick(xs)}"', f' class="{pick(xs)}"', f' id="{pick(xs)}"', f' class="x{rng.integers(9)} {pick(xs)}"'))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def some(most: int) -> str:
        words = pick(others).split() if others else []
        low = int(rng.integers(0, max(1, len(words) - 3)))
        return escape(" ".join(words[low : low + int(rng.integers(1, most))]) or pick(_SAID))

    short = lambda: pick((some(5), pick(_SAID)))
    link = lambda: f'<a href="/{rng.integers(99)}">{short()}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8))) + "</ul>"
    box = lambda tags, names, body: (lambda t: f"<{t}{name(names) if t in ('div', 'section', 'ul') or rng.random() < 0.5 else ''}>{body}</{t}>")(pick(tags))
    menu = lambda: box(("nav", "nav", "div", "header"), MENU_NAMES, pick((links(), "".join(link() for _ in range(4)))))
    head = lambda: box(("header", "div"), HEAD_NAMES, pick((f"<div>{short()}</div>", f"<p>{some(9)}</p>", f"<h2>{link()}</h2>", links())))
    side = lambda: box(("aside", "aside", "div", "section"), SIDE_NAMES, f"<h3>{short()}</h3>" + pick((links(), f"<p>{some(30)}</p>", f"<p>{some(25)}</p>{link()}")))
    advert = lambda: box(("div", "div", "aside", "section", "ins"), AD_NAMES, pick((some(25), f"<p>{some(25)}</p>", f"<p>{some(12)} {link()}</p>")))
    notice = lambda: box(("div", "div", "section", "aside", "dialog"), NOTICE_NAMES, pick((f"<p>{some(40)}</p>", some(30), f"<h4>{short()}</h4><p>{some(25)}</p>{link()}")))
    form = lambda: f"<form{name(NOTICE_NAMES) if rng.random() < 0.3 else ''}>" + pick((f"<label>{short()}</label><input>", f"<p>{some(15)}</p><input><button>{short()}</button>", f"<div>{some(10)}</div><div><label>{short()}</label></div>")) + "</form>"
    said = lambda: box(("div", "li", "article", "p", "section"), COMMENT_NAMES, pick((f"<p>{some(40)}</p>", f"<b>{short()}</b><p>{some(60)}</p>", f"<div>{short()}</div><div>{some(50)}</div>")))
    comments = lambda: box(("section", "div", "div", "aside", "ol"), COMMENT_NAMES, f"<h3>{short()}</h3>" * int(rng.integers(0, 2)) + "".join(said() for _ in range(rng.integers(1, 6))))
    share = lambda: box(("div", "div", "ul"), SHARE_NAMES, pick((f"{link()}{link()}", f"<span>{short()}</span>", links())))
    foot = lambda: box(("footer", "footer", "div"), FOOT_NAMES, pick((f"&copy; {some(12)}", f"<p>&copy; {some(9)}</p>{links()}", links(), f"<p>{some(30)}</p>")))

    if rng.random() < 0.35:  # short articles too
        texts = [" ".join(t.split()[: int(rng.integers(3, 25))]) for t in texts[: int(rng.integers(1, 8))]]
    blocks = []
    for i, text in enumerate(texts):
        t = mark + escape(text)
        tag = pick(("h1", "h2")) if i == 0 and rng.random() < 0.7 else pick(("p",) * 14 + ("h2", "h3", "blockquote", "div", "pre"))
        if tag == "p" and len(text) < 200 and rng.random() < 0.06:
            blocks.append(f"<ul><li>{t}</li></ul>")
        elif tag == "p" and len(text) < 300 and rng.random() < 0.08:
            blocks.append(f'<figure><img src="{i}.jpg"><figcaption>{t}</figcaption></figure>')
        else:
            blocks.append(f"<{tag}>{t}</{tag}>")
    inner = []
    for b in blocks:
        inner.append(b)
        if rng.random() < 0.2:
            inner.append(pick((advert, side, side, share, notice, form, form))())
    if rng.random() < 0.3:
        inner.insert(int(rng.random() < 0.5), pick((share, notice, advert))())
    if rng.random() < 0.15:
        inner.append(comments())
    body = "".join(inner)
    if rng.random() < 0.3 and len(blocks) > 1:
        body = f"<header>{inner[0]}</header>" + "".join(inner[1:])
    root = rng.random()
    if root < 0.3:
        body = f"<article{name(CONTENT_NAMES) if rng.random() < 0.5 else ''}>{body}</article>"
    elif root < 0.45:
        body = f"<main>{body}</main>"
    elif root < 0.9:
        body = box(("div", "div", "section"), CONTENT_NAMES, body)
    for _ in range(int(rng.integers(0, 3))):
        body = f"<div{name(('wrap', 'container', 'row', 'page', 'layout', 'inner'))}>{body}</div>"
    above = [x() for x in (menu, head, notice, advert, form, share) if rng.random() < 0.45]
    below = [x() for x in (comments, side, side, advert, foot, notice, form, menu) if rng.random() < 0.45]
    nodes = parse(f"<html><head><title>{some(9)}</title></head><body>{''.join(above)}{body}{''.join(below)}</body></html>")
    content = [n.leaf and n.text.startswith(mark) for n in nodes]
    for n in nodes:
        n.text = n.text.replace(mark, "")
    return nodes, content


def labelled(pages: list[str], variants: int = VARIANTS, seed: int = 11) -> list[tuple[list[Node], list[int]]]:
    """The pages that mark their article, with labels, and pages made of their text."""
    rng, out, written, other = np.random.default_rng(seed), [], [], []
    for page in pages:
        nodes = parse(page)
        inside = marked(nodes)
        if inside is not None:
            content = [n.leaf and i for n, i in zip(nodes, inside, strict=True)]
            out.append((nodes, tree_labels(nodes, content)))
            written.append([n.text for n, c in zip(nodes, content, strict=True) if c][:ARTICLE_RUNS])
        other += [n.text for n in nodes if n.leaf][:OTHER_RUNS]
    for texts in written or [[t] for t in other]:
        for _ in range(variants if texts else 0):
            nodes, content = made_page(texts, other, rng)
            out.append((nodes, tree_labels(nodes, content)))
    return out


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model | None:
    rows = pages.filter(F.col("html").isNotNull() & (F.length("html") <= MAX_HTML)).select("page_id", "html")
    rows = rows.filter(chosen("page_id", max_pages, pages.count()))
    rows = rows.orderBy(F.xxhash64("page_id"), "page_id", "html").limit(max_pages)
    found = labelled([r.html for r in rows.collect()])
    return train(found) if found else None


EXTRACTED = "page_id long, url string, text string, n_chars long"
_EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: Model | None) -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def texts_of(trees: list[list[Node]]) -> list[str]:
        content = shared.value.marginals(trees) >= 0.5 if shared.value else np.zeros(sum(map(len, trees)), bool)
        texts, at = [], 0
        for nodes in trees:
            texts.append("\n".join(n.text for n, c in zip(nodes, content[at : at + len(nodes)].tolist(), strict=True) if c and n.leaf))
            at += len(nodes)
        return texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, trees, nodes = [], [], 0
            for cell in batch.column(2):  # a page at a time
                trees.append(parse(cell.as_py() or ""))
                nodes += len(trees[-1])
                if nodes >= NODES:
                    texts += texts_of(trees)
                    trees, nodes = [], 0
            texts += texts_of(trees) if trees else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_EXTRACTED)

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return rows.mapInArrow(run, EXTRACTED)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
