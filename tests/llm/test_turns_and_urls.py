"""URL filters, the prefix trie and conversation repair against SQL and plain versions."""

import itertools
import random
import string

import brute_turns
import duckdb
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from veilframe.llm import order, repairs, tries, urlrules

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
ODD_TURNS = [
    (1, 0, "system", "a b."), (1, 1, "user", None), (1, 2, None, "x"), (1, None, "user", "first?"), (1, 2, None, "x"), (1, 2, "", "y."),
    (2, None, None, None), (None, 1, "user", "lost."), (None, None, None, None), (100, 0, "user", "a b."), (100, 1, "assistant", "é" * 5000),
    (103, 0, "user", "a b."), (103, 1, "assistant", "é" * 5000), (104, 7, "utility", "odd."), (104, 7, "utility", "odd."), (-5, 0, "assistant", " "),
]


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = spark.createDataFrame(ODD_TURNS, TURNS)
    return rows.withColumns({c: F.lit("!") for c in ("place", "name", "_group", "_seq", "depth", "block", "kind", "word")})


def many_turns(seed, convs=150, most=9, texts=4):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", " ", "c!"][:texts]))
            for c in rng.sample(range(400), convs) for t in range(rng.randint(1, most))]


def trie_rows(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_trie_equals_sql(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    assert compare(tries.query(frame), connect(SF), tries.SQL) is None


@pytest.mark.parametrize("block", [2, 8, 512])
def test_trie_equals_brute_force(spark, block):
    """Long and short conversations, shared beginnings, blocks smaller than conversations."""
    rows = many_turns(1) + [(900 + c, t, "user", "a.") for c in range(2) for t in range(37 + c)]
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(tries.trie(*tries.rebuilt(frame), block=block)) == brute_turns.trie(rows)


def test_trie_of_odd_rows(spark, odd_turns):
    got = trie_rows(tries.query(odd_turns))
    assert got == brute_turns.trie(ODD_TURNS)
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(ODD_TURNS, TURNS).toArrow())
    assert compare(tries.query(odd_turns), con, tries.SQL) is None
    assert tries.query(odd_turns.limit(0)).count() == 0


def test_trie_of_turns_as_they_are(spark):
    """The operator without the rebuilding of the query: equal conversations, one the beginning of another."""
    rows = [(c, t, "u", x) for c, turns in {1: "ab", 2: "abc", 3: "ab", 4: "b"}.items() for t, x in enumerate(turns)]
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in
           tries.trie(*tries.sequences(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {(1, 0): (4, 2, 2, 4), (1, 1): (3, 1, 1, 4), (1, 2): (3, 1, 1, 2), (2, 3): (1, 0, 1, 0), (4, 1): (1, 0, 1, 0)}


def test_prefix_names_depend_on_the_prefix_alone():
    rng = random.Random(3)
    words = [bytes([rng.randrange(3)]) * 16 for _ in range(60)]
    for n in range(1, 33):
        names = tries.prefix_names(tries.ROOT, words[:n], 64)
        assert names == tries.prefix_names(tries.ROOT, words, 64)[: n + 1] and len(set(names)) == n + 1


def test_places_and_digests_over_ranges(spark):
    """A group over many ranges, ties included, is numbered through; ids packed in runs hash as one text."""
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 5000).alias("k"), F.lit("t").alias("s"))
    same = rows.unionAll(spark.range(700).selectExpr("1", "-1L", "'s'")).repartition(6)
    got = order.placed(*order.ranged(same, "g", ["k", "s"], ["k"])).collect()
    for g in {r["_group"] for r in got}:
        mine = sorted((r.place, r.k) for r in got if r["_group"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [k for _, k in mine] == sorted(k for _, k in mine)
    ids = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("name"), F.col("id").alias("i"))
    digests = {bytes(r.name): r.digest for r in order.id_digests(ids.repartition(7), "name", "i").collect()}
    for name, wanted in ((b"a", lambda i: i % 3 > 0), (b"b", lambda i: i % 3 == 0)):
        assert digests[name] == brute_turns.sha(",".join(str(i) for i in range(30_000) if wanted(i)))


def repaired(frame, word=repairs.WORD):
    return {r.conv_id: tuple(r)[1:] for r in repairs.query(frame, word).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("word", [1, 3, 4096])
def test_repairs_equal_brute_force(spark, word):
    rows = many_turns(2, 120, 12) + many_turns(5, 40, 3, 2)
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert repaired(frame, word) == brute_turns.repairs(rows)


def test_repairs_of_odd_rows(spark, odd_turns):
    assert repaired(odd_turns) == brute_turns.repairs(ODD_TURNS)
    assert repaired(odd_turns, 1) == brute_turns.repairs(ODD_TURNS)
    assert repairs.query(odd_turns.limit(0)).count() == 0
    given = repaired(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert given == brute_turns.repairs([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_products_of_matrices_equal_every_edit():
    """All words of up to four symbols, in any bracketing."""
    kinds = {"g": ("blank", "user", " "), **{s: ("truncated" if s.isupper() else None, s.lower(), "x") for s in "suaoSUAO"}}
    for n in range(5):
        for word in itertools.product("gsuaUA" if n > 3 else "gsuaoSUA", repeat=n):
            want = brute_turns.cheapest(tuple(kinds[s] for s in word))[:2]
            row = [(0, repairs.Rope("")), None, None, None]
            for s in word:
                row = repairs.product([row], repairs.symbol_matrix(s))[0]
            assert repairs.finish(row) == want
            if n == 4:
                a, b, c, d = (repairs.symbol_matrix(s) for s in word)
                assert repairs.finish(repairs.product(repairs.product(a, b), repairs.product(c, d))[0]) == want


def test_rules_of_the_grammar_expand_to_the_words(spark):
    words = ["suauaua", "uauauaUA", "suauagua", "u", "", "uaua" * 40]
    grammar = repairs.learn(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert any(len(grammar.parse(w)) < len(w) / 3 for w in words)
    for w in words:
        assert "".join(map(grammar.expand, grammar.parse(w))) == w
    assert len(grammar.matrices()) == grammar.size


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(many_turns(8, 60), TURNS)
    found, edits = repairs.repair(repairs.damaged(rows))
    out = {}
    for r in sorted(repairs.repaired_turns(found.turns, edits).collect(), key=lambda r: r.n):
        out.setdefault(r["_group"], []).append(r.role[0])
    import re
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in out.values())


def apriori(baskets, min_support, min_confidence):
    """Rules by looking at every token set of every basket."""
    n, often = len(baskets), {}
    for tokens, verdict in baskets:
        for size in range(1, len(tokens) + 1):
            for items in itertools.combinations(sorted(tokens), size):
                counts = often.setdefault(items, {"allow": 0, "block": 0})
                counts[verdict] += 1
    return {(frozenset(items), v, round(c[v] / sum(c.values()), 9), round(c[v] / n, 9)) for items, c in often.items() for v in c
            if c[v] >= min_support * n - 1e-9 and c[v] / sum(c.values()) >= min_confidence - 1e-12}


def some_urls(seed, n):
    rng = random.Random(seed)
    return [f"http{rng.choice(['', 's'])}://{rng.choice(['m.', ''])}{rng.choice(['good', 'bad-pills', 'x'])}.{rng.choice(['com', 'NET'])}/{rng.choice(['en', 'de'])}/{rng.randrange(90)}{rng.choice(['', '.html', '?a=1'])}"
            for _ in range(n)]


def test_mined_rules_equal_brute_force(spark):
    labelled = [(u, "block" if "pills" in u and "/en/" in u or "NET/de" in u else "allow") for u in some_urls(1, 150)]
    frame = spark.createDataFrame(labelled + labelled[:40], "url string, verdict string")  # copies count once
    baskets = [([i for i in r["items"] if not i.startswith("verdict=")], next(i for i in r["items"] if i.startswith("verdict="))[8:])
               for r in urlrules.transactions(frame, min_support=0.1, width=6).collect()]
    assert len(baskets) == len({u for u, _ in labelled}) and max(len(t) for t, _ in baskets) == 6
    got = urlrules.mine(frame, min_support=0.1, min_confidence=0.9, min_count=1, width=6)
    want = apriori(baskets, 0.1, 0.9)
    pruned = urlrules.prune([urlrules.Rule(*r) for r in want])
    assert got == pruned and got
    for rule in map(tuple, got):  # what was pruned has a wider rule
        assert rule in want
    for items, verdict, confidence, _ in want:
        assert any(g.items <= items and g.verdict == verdict and g.confidence >= confidence for g in got)
    index = urlrules.Index(got)
    for tokens, _ in baskets:
        assert index.find(tokens) == next((r for r in got if r.items <= set(tokens)), None)


def test_mined_rules_hold_on_labels_left_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = urlrules.labels_by_list(pages)
    out = F.crc32(F.col("url").cast("binary")) % 5 == 0
    rules = urlrules.mine(labels.filter(~out))
    judged = urlrules.judge(labels.filter(out).withColumnRenamed("verdict", "page_id"), rules, ())
    hits = judged.agg(F.avg((F.col("page_id") == F.col("verdict")).cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert hits["n"] > 150 and hits["share"] > 0.95


ODD_URLS = [
    (1, None), (1, ""), (None, "https://A.Org/x"), (2, "no scheme/en"), (3, "http://example.org"), (4, "http://EXAMPLE.org/es/1?x#y"), (5, "http://a.example.org/en/1://b"),
    (5, "http://notexample.org/es/"), (6, "ftp://com/fr/"), (7, "http://x.com/de"), (8, "http://x.com/de/#"), (9, "http://?q"), (10, "://"), (11, "http://org/" + "a/" * 30_000), (12, "http://é.org/ü"),
]


def listed_plainly(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in rest[:end])
    path = rest[end:][: min((rest[end:].find(c) for c in "?#" if c in rest[end:]), default=len(rest))]
    fits = [(len(r), r, v) for r, v in urlrules.LISTED for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_listed_rules_of_odd_urls(spark):
    frame = spark.createDataFrame(ODD_URLS, "page_id long, url string").withColumns({c: F.lit("!") for c in ("host", "path", "rule", "tokens", "verdict", "html")})
    rules = [urlrules.Rule(frozenset({"s:http", "h1:com"}), "block", 1.0, 0.5)]
    got = urlrules.judge(frame, rules).collect()
    assert len(got) == len(ODD_URLS)
    want = []
    for i, url in ODD_URLS:
        host, path, rule, verdict = listed_plainly(url)
        want.append((i, host, path, rule, verdict or ("block" if url == "http://x.com/de" else "allow")))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
    assert urlrules.query(frame.limit(0)).count() == 0 and urlrules.query(frame).count() == len(ODD_URLS)


def test_every_page_is_judged_once(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.query(pages).collect()}
    for r in pages.select("page_id", "url").collect():
        host, path, rule, verdict = listed_plainly(r.url)
        assert got[r.page_id][:3] == (host, path, rule) and (got[r.page_id][3] == verdict or verdict is None)
