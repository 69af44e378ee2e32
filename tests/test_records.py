import base64
import json

import pytest
from pyspark.sql import functions as F
from veilframe.functions import model_output as MO
from veilframe.functions import payloads as P
from veilframe.functions import web
from veilframe.operators import calls, chat, messages
from veilframe.sources.session import materialise, shared_dir, spread


def one(spark, column, **values):
    df = spark.range(1).select(*[v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string").alias(k)
                                 for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("answer, want", [
    ('Sure {"a": [1, 2]} ok', '{"a":[1,2]}'),
    ("[1, 2]", "[1,2]"),
    ('[{"a":1}]', '{"a":1}'),
    ("bad {x} then [1]", "[1]"),
    ('{"a":1} and {"b":2}', None),
    ('{"a":1}, {"b":2}', None),
    ('{"a":1}] x [{}', None),
    ('{"a":1},"end"] x [{"b":2}', None),
    ("{}", "{}"),
    ("none", None),
    ("", None),
    (None, None),
])
def test_extract_json(spark, answer, want):
    assert one(spark, MO.extract_json(F.col("t")), t=answer) == want


def test_extract_json_with_schema(spark):
    got = one(spark, MO.extract_json(F.col("t"), "a array<int>, b string"), t='x {"a": [1], "b": "q"}')
    assert got.a == [1] and got.b == "q"


def test_response_text(spark):
    answers = [
        '{"output_text":" ready "}',
        '{"output_text":"","output":[{"content":[{"text":"a"},{"output_text":"b"}]},{},{"content":[{"text":"c"}]}]}',
        "{}",
    ]
    for answer, want in zip(answers, ["ready", "ab\n\nc", ""]):
        assert one(spark, MO.response_text(F.from_json("t", MO.RESPONSE_TYPE)), t=answer) == want


def _turns(spark):
    return spark.createDataFrame([
        (1, 0, "system", 'be "kind"'), (1, 1, "user", "hi"), (1, 2, "assistant", "yo\n"), (1, 3, "user", "bye"),
        (2, 0, "user", "only"), (3, 0, "system", "just prompt"), (4, 1, "user", "a"), (4, 4, "system", "mid"),
        (4, 9, "assistant", "z"),
    ], "conv_id long, turn long, role string, text string")


def _bodies(df):
    parts = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.part)):
        parts.setdefault(r.conv_id, []).append(r.body)
    return {c: json.loads("".join(p)) for c, p in parts.items()}


@pytest.mark.parametrize("per_part", [1, 2, 3, 1024])
def test_chat_payloads(spark, per_part):
    turns = _turns(spark)
    first = _bodies(chat.chat_payload_system_first(turns, turns_per_part=per_part))
    assert first[1]["messages"] == [
        {"role": "system", "content": 'be "kind"'}, {"role": "user", "content": "hi"},
        {"role": "assistant", "content": "yo\n"}, {"role": "user", "content": "bye"}]
    assert first[1]["temperature"] == 0.7 and "max_tokens" not in first[1]
    assert first[3]["messages"] == [{"role": "system", "content": "just prompt"}]
    assert [m["role"] for m in first[4]["messages"]] == ["user", "system", "assistant"]
    field = _bodies(chat.chat_payload_system_field(turns, turns_per_part=per_part))
    assert field[1]["system"] == 'be "kind"' and len(field[1]["messages"]) == 3
    assert "system" not in field[2] and field[2]["max_tokens"] == 2048 and "temperature" not in field[2]
    last = chat.chat_payload_history_last(turns, turns_per_part=per_part)
    history = _bodies(last)
    assert history[1]["history"] == [
        {"role": "user", "parts": [{"text": "hi"}]}, {"role": "model", "parts": [{"text": "yo\n"}]}]
    assert history[2]["history"] == [] and history[4]["history"] == [{"role": "user", "parts": [{"text": "a"}]}]
    assert {r.conv_id: r.message for r in last.where("is_last").collect()} == {
        1: "bye", 2: "only", 3: "just prompt", 4: "z"}


def test_raw_mail(spark):
    body = "é" * 200
    got = one(spark, P.payload_raw_mail(*[F.col(c) for c in ("to", "subject", "body", "kind", "from", "cc", "bcc")]),
              **{"to": "t@x", "subject": "s", "body": body, "kind": "html", "from": None, "cc": "c@x", "bcc": ""})
    assert "=" not in got and "\r" not in got
    text = base64.urlsafe_b64decode(got + "=" * (-len(got) % 4)).decode()
    assert text == ("To: t@x\r\nCc: c@x\r\nSubject: s\r\nMIME-Version: 1.0\r\n"
                    "Content-Type: text/html; charset=utf-8\r\n\r\n" + body)


def test_urls_and_envelope(spark):
    assert one(spark, web.normalize_url(F.col("u")), u="  HTTPS://a ") == "HTTPS://a"
    assert one(spark, web.normalize_url(F.col("u")), u="ftp.a/x") == "https://ftp.a/x"
    assert one(spark, web.strip_envelope(F.col("p")), p="T\nMarkdown Content:\n x \n Markdown Content: y ") == (
        "x \n Markdown Content: y")
    assert one(spark, web.strip_envelope(F.col("p")), p=" none ") == " none "


def test_markdown(spark):
    html = ("<head><title>t</title></head><body><nav>menu</nav><h2 class='a'>Head</h2><!-- c --><p>One &amp;lt; "
            "<a class=x href=\"/u\">link</a></p><ul><li>i1<li>i2</ul><script>var t='</p>';</script></body>")
    assert one(spark, web.page_to_markdown(F.col("h")), h=html) == "## Head\n\nOne &lt; [link](/u)\n\n- i1\n- i2"


@pytest.mark.parametrize("html, want", [
    (None, None),
    ("", ""),
    ("  \n ", ""),
    ("a <3 b > c", "a <3 b > c"),
    ("<p>a<br>b<br><br>c</p>d", "a\nb\nc\n\nd"),
    ("<ul><li>one<ul><li>in <b>n</b>er</li><li><p>x</p><p>y</p></li></ul></li><li>two</li></ul>z",
     "- one\n  - in ner\n  - x\n\n    y\n\n- two\n\nz"),
    ("<ol start=3><li>c<li>d<ul><li>e</ul><li>f</ol>", "3. c\n4. d\n   - e\n5. f"),
    ("<ul><li></li><li>a<h2>b</h2></ul></ul>c", "- a\n\n  ## b\n\nc"),
    ("<table><tr><th>A<th>B|x</tr><tr><td>1<br>2<ul><li>3</ul></td><td></td></tr></table>z",
     "| A | B\\|x |\n| --- | --- |\n| 1 2 3 | |\n\nz"),
    ("<table><tr><td>a<table><tr><td>b</table>c", "| a b c |\n| --- |"),
    ("x<pre>\n\n a &lt;b&gt;\n\t<b>c</b>\n</pre>y", "x\n\n```\n\n a <b>\n\tc\n```\n\ny"),
    ("<pre></pre><pre>q", "```\n```\n\n```\nq\n```"),
    ("<a href=/r?a>k <img alt=\"A\" src='i.png'></a> l <a name=x>m</a>", "[k ![A](i.png)](/r?a) l m"),
    ("<a href='/u?a&amp;b'> t </a>u <a href=x>un<a href=y>v", "[t](/u?a&b) u [un](x)[v](y)"),
    ("&#233;&#xE9;&eacute;&Eacute; &nope; &#0;&#xD800;&#x1F600;&nbsp;&amp;lt;&amp", "éééÉ &nope; ��\U0001f600 &lt;&amp"),
    ("a￿b&#65535;c", "a￾b￿c"),
    ("<script>x</script><SCRIPTS>y<header>z</header><nav>m</nav >", "y\n\nz"),
])
def test_markdown_rules(spark, html, want):
    assert one(spark, web.page_to_markdown(F.col("h")), h=html) == want


def test_markdown_of_long_pages(spark):
    """Lists deeper than the stack, and more pieces than a slice."""
    got = one(spark, web.page_to_markdown(F.col("h")), h="<ul><li>a" * 40 + "</ul>" * 40 + "<p>b" * 300)
    lines = got.split("\n")
    assert lines[0] == "- a" and lines[31] == "  " * 31 + "- a" and lines[39] == "  " * 31 + "- a"
    assert got.count("\n\nb") == 300


def test_markdown_is_not_an_interpreted_fold(spark):
    """A fold of SQL functions copies its state at every piece: no lambda is left in the plan."""
    df = spark.createDataFrame([("<p>a",), ("b",)], "h string").select(web.page_to_markdown(F.col("h")).alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    assert one(spark, web.page_to_markdown(F.col("h")), h="a&#65279;b") == "a\ufeffb"


def test_retry_delays(spark):
    df = spark.createDataFrame([(503, 0), (429, 3), (500, 9), (404, 1), (None, 1)], "status int, attempt int")
    assert [(r.retryable, r.delay_ms) for r in calls.classify_retryable(df).collect()] == [
        (True, 1000), (True, 8000), (True, 30000), (False, None), (False, None)]


def test_paging_by_key_covers_everything(spark):
    rows = spark.createDataFrame([(i, ["A"] if i % 2 else ["A", "B"], f"s{i}", "b") for i in range(30)],
                                 "msg_id long, labels array<string>, subject string, body string")
    seen, token = [], None
    while page := messages.list_messages_by_label(rows, label_ids=["B"], max_results=4, page_token=token).collect():
        seen += [r.msg_id for r in page]
        token = seen[-1]
    assert seen == list(range(0, 30, 2))


def test_label_and_read_changes(spark):
    rows = spark.createDataFrame([(1, ["A", "UNREAD"], False), (2, ["A"], False), (3, ["B"], True)],
                                 "msg_id long, labels array<string>, is_read boolean")
    changes = spark.createDataFrame([(1, ["S", "A"], ["UNREAD", "X"]), (3, None, ["B"])],
                                    "msg_id long, add array<string>, remove array<string>")
    got = {r.msg_id: r.labels for r in messages.modify_labels(rows, changes).collect()}
    assert got == {1: ["A", "S"], 2: ["A"], 3: []}
    flags = spark.createDataFrame([(1, None), (3, False)], "msg_id long, is_read boolean")
    assert {r.msg_id: r.is_read for r in messages.mark_read(rows, flags).collect()} == {1: True, 2: False, 3: False}


def test_hot_conversation_is_limited_before_the_shuffle(spark, tmp_path):
    _turns(spark).write.parquet(str(tmp_path / "t"))
    plan = messages.list_conversation_messages(spark.read.parquet(str(tmp_path / "t")), 2)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_spread_deals_a_hot_key_evenly(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS conv_id").coalesce(1)
    assert spread(rows, None) is rows
    dealt = spread(rows, 10).groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("conv_id") == 1, 1)).alias("hot")).collect()
    assert len(dealt) == 10 and max(r.n for r in dealt) <= 400 and max(r.hot for r in dealt) <= 200


def test_materialise_uses_the_shared_folder(spark):
    kept = materialise(spark.range(5), "test")
    assert kept.count() == 5
    assert all(shared_dir(spark).split(":")[-1] in f for f in kept.inputFiles())


def test_a_deep_page_reads_its_ranges(spark, tmp_path):
    from veilframe.operators.messages import store_pages
    rows = spark.range(10_000).selectExpr("if(id = 77, null, id * 13 % 10007) AS msg_id", "concat('m', id) AS body")
    listing = store_pages(rows, str(tmp_path / "listing"), ranges=50)
    keys = sorted((-1 if r.msg_id is None else r.msg_id) for r in rows.collect())
    for skip, top in ((0, 30), (0, 0), (7777, 450), (9990, 25), (20_000, 5)):
        got = [(-1 if r.msg_id is None else r.msg_id) for r in listing.page(spark, top, skip).collect()]
        assert got == keys[skip : skip + (top or 25)]
    plan = listing.page(spark, 25, 7777)._jdf.queryExecution().executedPlan().toString()
    ranges = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ranges.count(",") <= 3 and "_range" in ranges
