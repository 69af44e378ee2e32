"""Main text of pages that nothing was trained on, labelled by hand, and the reader's time."""

import time

import pytest

from veilframe.llm import extraction
from veilframe.llm.dom import parse

SF = "/root/testdata/sf0.01"

#: html, main text
BY_HAND = [
    ("""<html><head><title>Harbour</title></head><body><header><a href="/">Daily Harbour</a></header>
<nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Culture</a></li></ul></nav>
<article><h1>The old bridge is open again</h1><p>After three years of repairs, the old bridge over the river was opened on Monday, and several hundred people crossed it in the first hour.</p>
<figure><img src="b.jpg"><figcaption>The bridge on Monday morning, seen from the northern bank.</figcaption></figure>
<p>The mayor said that the work had cost less than planned. &quot;We are glad&quot;, she added, &quot;that the trams can run again.&quot;</p></article>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">Weather</a></li></ul></aside>
<footer>&copy; 2024 Daily Harbour</footer></body></html>""",
     ["The old bridge is open again", "After three years of repairs, the old bridge over the river was opened on Monday, and several hundred people crossed it in the first hour.",
      "The bridge on Monday morning, seen from the northern bank.", 'The mayor said that the work had cost less than planned. "We are glad", she added, "that the trams can run again."']),
    ("""<body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p></div><div id="menu"><a href="/x">Start</a> <a href="/y">Contact</a></div>
<div class="post-body"><h2>How to keep bread fresh</h2><p>Bread stays fresh longest in a clay pot with a lid, because the pot takes up moisture and gives it back slowly.</p>
<p>In the fridge, by contrast, bread gets stale quickly: the cold makes the starch crystallise, and the crumb turns dry.</p><div class="ad">Buy pots now, 20 % off!</div>
<p>If you cannot eat a loaf within three days, cut it, freeze the slices, and toast them straight from the freezer.</p></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>I always use a linen bag, works well for me.</p></div><div class="comment"><p>Nice tips, thanks a lot!</p></div></div></body>""",
     ["How to keep bread fresh", "Bread stays fresh longest in a clay pot with a lid, because the pot takes up moisture and gives it back slowly.",
      "In the fridge, by contrast, bread gets stale quickly: the cold makes the starch crystallise, and the crumb turns dry.",
      "If you cannot eat a loaf within three days, cut it, freeze the slices, and toast them straight from the freezer."]),
    ("<main><h1>Opening hours</h1><p>The library is open from Monday to Friday, nine to six.</p><figure><figcaption>The reading room on the second floor was renovated last summer.</figcaption></figure></main><footer>Imprint</footer>",
     ["Opening hours", "The library is open from Monday to Friday, nine to six.", "The reading room on the second floor was renovated last summer."]),
]


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_pages_labelled_by_hand(spark, model):
    rows = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(BY_HAND)], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in extraction.extract(rows, model).collect()}
    runs = wrong = 0
    for i, (_, want) in enumerate(BY_HAND):
        wrong += len(set(got[i]) ^ set(want))
        runs += len(want)
        assert [t for t in want if "bridge on Monday morning" in t or "reading room" in t] == [t for t in got[i] if "bridge on Monday morning" in t or "reading room" in t]
    assert wrong <= 1 and runs == 11


def test_the_reader_takes_linear_time():
    for page in ("<div>" * 20_000 + "<li></li>" * 20_000, "<table>" + "<td></b>" * 40_000, "<a " * 60_000, "<dl>" + "<div><dt>x" * 20_000, "<tr>" * 60_000):
        start = time.time()
        parse(page)
        assert time.time() - start < 1.5, page[:20]


def test_memory_is_in_proportion_to_the_nodes(model):
    """40,000 nodes hold a few numbers each, not a row of the vocabulary."""
    page = "".join(f"<p class='text x{i % 50}'>Some words of a paragraph, number {i}.</p>" for i in range(20_000))
    found = extraction.forest([parse(page)], model.vocabulary)
    held = sum(a.nbytes for a in (found.x, found.rows, found.columns, found.parent, found.leaf))
    assert len(found.parent) > 40_000 and held < 250 * len(found.parent)
