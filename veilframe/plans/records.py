"""Registered queries over model answers, chats, messages, inquiries, pages, the
outbox and call logs, with their DuckDB statements.

The inputs are the given tables put into the shape of the operator by plain SQL that
both engines read (``_AS_*``), over all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import model_output as MO
from veilframe.functions import payloads as P
from veilframe.functions import web
from veilframe.operators import calls as CA
from veilframe.operators import chat as CH
from veilframe.operators import inquiries as IQ
from veilframe.operators import messages as ME
from veilframe.operators import outbox as OB
from veilframe.operators import pages as PG
from veilframe.operators import search as SE
from veilframe.sources.session import asked_spread, keep_last_key, new_folder, spread
from veilframe.sources.tables import table, text_table


def _from(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def _duck(sql: str, *names: str) -> str:
    return sql.format(**{n: n for n in names})


# --- model answers -----------------------------------------------------------

_AS_ANSWERS = """
SELECT event_id, CASE event_id % 7
  WHEN 0 THEN 'Sure: ' || props || ' done.'
  WHEN 1 THEN 'List [' || CAST(event_id AS STRING) || ', 2, "x"] end'
  WHEN 2 THEN '[{{"k": ' || CAST(event_id AS STRING) || '}}]'
  WHEN 3 THEN 'broken {{not json}} then [1, ' || CAST(event_id AS STRING) || ']'
  WHEN 4 THEN 'nothing here ' || event_type
  WHEN 5 THEN 'twice {{"k": 1, "k": ' || CAST(event_id AS STRING) || '}}'
  ELSE 'two {{"a": 1}} and {{"b": 2}}' END AS answer
FROM {events}
"""
_JSON_IN_DUCK = r"""
SELECT event_id, CASE
  WHEN event_id % 7 = 5 THEN '{"k":' || event_id || '}'
  WHEN json_valid(regexp_extract(answer, '(?s)\{.*\}')) THEN regexp_extract(answer, '(?s)\{.*\}')
  WHEN json_valid(regexp_extract(answer, '(?s)\[.*\]')) THEN regexp_extract(answer, '(?s)\[.*\]')
  END AS j FROM (""" + _duck(_AS_ANSWERS, "events") + ")"


def extract_json(spark, sf_dir):
    keep_last_key(spark)
    answers = _from(spark, sf_dir, _AS_ANSWERS, "events")
    return answers.select("event_id", MO.extract_json(F.col("answer")).alias("parsed"))


def extract_json_with_schema(spark, sf_dir):
    keep_last_key(spark)
    answers = _from(spark, sf_dir, _AS_ANSWERS, "events")
    parsed = answers.select("event_id", MO.extract_json(F.col("answer"), "k bigint").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"))


_AS_LINES = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '\u00a0 ' || text || ' \u2003\ufeff' WHEN turn % 3 = 1 THEN '' END AS ready, text
FROM {conversations}
"""


def response_text(spark, sf_dir):
    """Answers in parts: one output per line, one content part per sentence."""
    lines = _from(spark, sf_dir, _AS_LINES, "conversations")
    response = lines.select("conv_id", "turn", F.expr("""named_struct(
      'output_text', ready,
      'output', concat(array(named_struct('content', cast(null as
          array<struct<text:string,output_text:string>>))),
        transform(split(text, '\n'), l -> named_struct('content',
          transform(split(l, '[.]'), (p, i) -> named_struct(
            'text', if(i % 2 = 0, p, ''), 'output_text', if(i % 2 = 0, null, p)))))))""").alias("r"))
    return response.select("conv_id", "turn", MO.response_text(F.col("r")).alias("content"))


_RESPONSE_SQL = r"""
SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN chr(160) || ' ' || text || ' ' || chr(8195) || chr(65279)
  ELSE chr(10) || replace(text, '.', '') END, '^[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$', '', 'g') AS content
FROM conversations
"""


def first_text_block(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("""
      CASE WHEN turn % 4 = 3 THEN cast(array() as array<struct<type:string,text:string>>)
        ELSE array(named_struct('type', if(turn % 2 = 0, 'text', 'tool_use'), 'text', text),
                   named_struct('type', 'text', 'text', role)) END""").alias("content"))
    return blocks.select(
        "conv_id", "turn", MO.first_text_block(F.col("content")).alias("content"))


_BLOCK_SQL = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS content
FROM conversations"""


# --- chat payloads -----------------------------------------------------------

def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def chat_system_first(spark, sf_dir):
    return CH.chat_payload_system_first(_turns(spark, sf_dir), max_tokens=512)


def chat_system_first_in_parts(spark, sf_dir):
    return CH.chat_payload_system_first(_turns(spark, sf_dir), json_mode=True, turns_per_part=3)


def chat_system_field(spark, sf_dir):
    return CH.chat_payload_system_field(_turns(spark, sf_dir))


def chat_system_field_in_parts(spark, sf_dir):
    return CH.chat_payload_system_field(_turns(spark, sf_dir), turns_per_part=2)


def chat_history_last(spark, sf_dir):
    return CH.chat_payload_history_last(_turns(spark, sf_dir))


def chat_history_last_in_parts(spark, sf_dir):
    return CH.chat_payload_history_last(_turns(spark, sf_dir), turns_per_part=2)


def _chat_ctes(per_part: int) -> str:
    return f"""
WITH f AS (
  SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn,
    min(turn) FILTER (role != 'system') AS first_spoken FROM conversations GROUP BY conv_id),
t AS (
  SELECT c.*, turn // {per_part} AS part, first_turn // {per_part} AS first_part,
    last_turn // {per_part} AS last_part, last_turn, first_turn, first_spoken,
    turn = first_turn AND role = 'system' AS is_prompt
  FROM conversations c JOIN f USING (conv_id)),
h AS (SELECT conv_id, text AS prompt FROM t WHERE is_prompt),
l AS (SELECT conv_id, text AS last_text FROM t WHERE turn = last_turn),
p AS (
  SELECT conv_id, part, first_part, last_part, first_turn, last_turn,
    coalesce(string_agg(CASE WHEN NOT is_prompt THEN to_json({{'role': role, 'content': text}})::VARCHAR
      || CASE WHEN turn < last_turn THEN ',' ELSE '' END END, '' ORDER BY turn), '') AS spoken,
    coalesce(string_agg(CASE WHEN role != 'system' AND turn < last_turn THEN
      CASE WHEN turn > first_spoken THEN ',' ELSE '' END || to_json({{
        'role': CASE role WHEN 'assistant' THEN 'model' ELSE role END,
        'parts': [{{'text': text}}]}})::VARCHAR END, '' ORDER BY turn), '') AS history
  FROM t GROUP BY ALL)
SELECT p.conv_id, part - first_part AS part, part = last_part AS is_last,"""


_CHAT_FROM = " FROM p LEFT JOIN h ON h.conv_id = p.conv_id LEFT JOIN l ON l.conv_id = p.conv_id"


def _system_first_sql(per_part: int, extra: str) -> str:
    return _chat_ctes(per_part) + f"""
  CASE WHEN part = first_part THEN '{{"model":"{CH.SYSTEM_FIRST_MODEL}","messages":['
    || coalesce(to_json({{'role': 'system', 'content': nullif(prompt, '')}})::VARCHAR
      || CASE WHEN first_turn < last_turn THEN ',' ELSE '' END, '') ELSE '' END
  || spoken || CASE WHEN part = last_part THEN '],"temperature":0.7{extra}}}' ELSE '' END AS body
""".replace("coalesce(to_json({'role': 'system', 'content': nullif(prompt, '')})::VARCHAR",
            "coalesce(CASE WHEN prompt != '' THEN to_json({'role': 'system', 'content': prompt})::VARCHAR END"
            ) + _CHAT_FROM


def _system_field_sql(per_part: int) -> str:
    return _chat_ctes(per_part) + f"""
  CASE WHEN part = first_part THEN '{{"model":"{CH.SYSTEM_FIELD_MODEL}","max_tokens":2048,'
    || CASE WHEN prompt != '' THEN '"system":' || to_json(prompt)::VARCHAR || ',' ELSE '' END
    || '"messages":[' ELSE '' END
  || spoken || CASE WHEN part = last_part THEN ']}}' ELSE '' END AS body""" + _CHAT_FROM


def _history_sql(per_part: int) -> str:
    return _chat_ctes(per_part) + """
  CASE WHEN part = first_part THEN '{"history":[' ELSE '' END || history
    || CASE WHEN part = last_part THEN ']}' ELSE '' END AS body,
  CASE WHEN part = first_part THEN prompt END AS system_instruction,
  CASE WHEN part = last_part THEN last_text END AS message""" + _CHAT_FROM


# --- message tables ----------------------------------------------------------

_AS_MESSAGES = """
SELECT conv_id * 100 + turn AS msg_id, conv_id AS thread_id, role,
  'Re: thread ' || CAST(conv_id AS STRING) AS subject, text AS body,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN %s ELSE %s END AS labels,
  (conv_id + turn) % 3 != 0 AS is_read
FROM {conversations}
"""
_SPARK_MESSAGES = _AS_MESSAGES.replace(
    "%s", "array('INBOX', upper(role), 'UNREAD')", 1).replace("%s", "array('INBOX', upper(role))", 1)
_DUCK_MESSAGES = _duck(_AS_MESSAGES.replace(
    "%s", "['INBOX', upper(role), 'UNREAD']", 1).replace("%s", "['INBOX', upper(role)]", 1),
    "conversations")


def messages(spark, sf_dir):
    return _from(spark, sf_dir, _SPARK_MESSAGES, "conversations")


def messages_by_label(spark, sf_dir):
    page = ME.list_messages_by_label(
        messages(spark, sf_dir), query="EN", label_ids=("UNREAD", "USER"), page_token=1000)
    return page.select("msg_id", "thread_id", F.array_join("labels", ",").alias("labels"))


_BY_LABEL_SQL = f"""SELECT msg_id, thread_id, array_to_string(labels, ',') AS labels
FROM ({_DUCK_MESSAGES}) WHERE msg_id > 1000 AND list_contains(labels, 'UNREAD')
  AND list_contains(labels, 'USER') AND (contains(lower(subject), 'en') OR contains(lower(body), 'en'))
ORDER BY msg_id LIMIT 100"""


def messages_page(spark, sf_dir):
    page = ME.list_messages_page(
        messages(spark, sf_dir), filter="is_read", search="thread 1", top=0, skip=10,
        orderby=(F.desc("thread_id"), "msg_id"))
    return page.select("msg_id", "subject")


_PAGE_SQL = f"""SELECT msg_id, subject FROM ({_DUCK_MESSAGES})
WHERE is_read AND (contains(lower(subject), 'thread 1') OR contains(lower(body), 'thread 1'))
ORDER BY thread_id DESC, msg_id LIMIT 25 OFFSET 10"""


def messages_deep_page(spark, sf_dir):
    """A page far back, through the directory of a stored listing."""
    listing = ME.store_pages(messages(spark, sf_dir), new_folder(spark, "listing"), ranges=16)
    return listing.page(spark, top=40, skip=400).select("msg_id", "subject")


_DEEP_PAGE_SQL = f"""SELECT msg_id, subject FROM ({_DUCK_MESSAGES}) ORDER BY msg_id LIMIT 40 OFFSET 400"""


def message_by_id(spark, sf_dir):
    return ME.get_message(messages(spark, sf_dir), 100).select("msg_id", "role", "body")


def labels_modified(spark, sf_dir):
    changes = messages(spark, sf_dir).select(
        "msg_id",
        F.expr("CASE WHEN thread_id % 2 = 0 AND msg_id % 5 != 0 THEN array('STARRED', 'INBOX') END")
        .alias("add"),
        F.expr("CASE WHEN thread_id % 2 = 0 THEN array('UNREAD', 'ABSENT') END").alias("remove"))
    changed = ME.modify_labels(messages(spark, sf_dir), changes)
    return changed.select("msg_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


_MODIFY_SQL = f"""SELECT msg_id, array_to_string(list_sort(CASE WHEN thread_id % 2 = 0 THEN
  list_filter(CASE WHEN msg_id % 5 != 0 THEN list_append(labels, 'STARRED') ELSE labels END,
    lambda x: x NOT IN ('UNREAD', 'ABSENT')) ELSE labels END), ',') AS labels
FROM ({_DUCK_MESSAGES})"""


def marked_read(spark, sf_dir):
    changes = messages(spark, sf_dir).select(
        "msg_id", F.expr("CASE WHEN thread_id % 2 = 0 THEN CASE WHEN msg_id % 5 = 0 THEN false END ELSE is_read END")
        .alias("is_read"))
    return ME.mark_read(messages(spark, sf_dir), changes).select("msg_id", "is_read")


_READ_SQL = f"""SELECT msg_id, CASE WHEN thread_id % 2 = 0 THEN msg_id % 5 != 0 ELSE is_read END AS is_read
FROM ({_DUCK_MESSAGES})"""


def conversations_listed(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn(
        "platform", F.expr("CASE WHEN conv_id % 3 = 0 THEN 'messenger' ELSE 'instagram' END"))
    return ME.list_conversations(turns).select(
        "conv_id", "updated_turn", F.array_join("participants", ",").alias("participants"))


_LISTED_SQL = """SELECT conv_id, max(turn) AS updated_turn,
  array_to_string(list_sort(list(DISTINCT role)), ',') AS participants
FROM conversations WHERE conv_id % 3 != 0 GROUP BY conv_id ORDER BY updated_turn DESC, conv_id LIMIT 25"""


def conversation_messages(spark, sf_dir):
    return ME.list_conversation_messages(_turns(spark, sf_dir), 2).select(
        "conv_id", "turn", "role", "position")


_NEWEST_SQL = """SELECT conv_id, turn, role,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS position
FROM conversations QUALIFY position <= 2"""


# --- inquiries ---------------------------------------------------------------

AS_INQUIRIES = """
SELECT event_id,
  CASE event_type WHEN 'view' THEN 'instagram' WHEN 'signup' THEN 'instagram' WHEN 'error' THEN 'fax'
    ELSE 'email' END AS canal,
  event_type AS source,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE 'user' || CAST(user_id AS STRING) END AS expediteur,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE props END AS texte,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS horodatage,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'x' || CAST(event_id - event_id % 3 AS STRING) END AS external_id
FROM {events}
"""
_DUCK_INQUIRIES = _duck(AS_INQUIRIES, "events")
_AS_OF = "2024-01-20 12:00:00"


def inquiries(spark, sf_dir):
    return _from(spark, sf_dir, AS_INQUIRIES, "events")


def _moment(df: DataFrame):
    """``_AS_OF`` in the timestamp type of the table."""
    return F.lit(_AS_OF).cast(df.schema["horodatage"].dataType)


def inquiries_validated(spark, sf_dir):
    return IQ.validate_inquiries(inquiries(spark, sf_dir)).select("event_id", "canal", "error_code")


_VALIDATED_SQL = f"""SELECT event_id, canal, CASE WHEN canal NOT IN ('instagram', 'email') THEN 'INVALID_FIELD'
  WHEN expediteur = '' OR texte IS NULL THEN 'MISSING_FIELDS' END AS error_code
FROM ({_DUCK_INQUIRIES})"""


def inquiries_logged(spark, sf_dir):
    found = inquiries(spark, sf_dir)
    return IQ.log_inquiries(found, _moment(found)).select(
        "canal", "source", "expediteur", "texte", "external_id",
        F.date_format("horodatage", "yyyy-MM-dd HH:mm:ss").alias("horodatage"))


_LOGGED_SQL = f"""
WITH v AS (
  SELECT canal, source, expediteur, texte, external_id,
    coalesce(horodatage, TIMESTAMP '{_AS_OF}') AS horodatage
  FROM ({_DUCK_INQUIRIES}) WHERE canal IN ('instagram', 'email') AND expediteur != '' AND texte IS NOT NULL),
d AS (
  SELECT * FROM v WHERE external_id IS NULL
  UNION ALL
  SELECT * FROM v WHERE external_id IS NOT NULL QUALIFY row_number() OVER (
    PARTITION BY external_id ORDER BY horodatage, canal, expediteur, texte, source) = 1)
SELECT canal, source, expediteur, texte, external_id,
  strftime(horodatage, '%Y-%m-%d %H:%M:%S') AS horodatage FROM d"""


def _stats(range_):
    def query(spark, sf_dir):
        found = inquiries(spark, sf_dir)
        return IQ.inquiry_stats(found, _moment(found), range_)
    return query


def _stats_sql(where: str) -> str:
    return f"""SELECT canal, source, count(*) AS n_inquiries, count(DISTINCT expediteur) AS n_senders
FROM ({_DUCK_INQUIRIES}) WHERE {where} GROUP BY ALL"""


# --- pages and search --------------------------------------------------------

_AS_URLS = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || url WHEN 1 THEN replace(url, 'http', 'HTTP') || ' '
  WHEN 2 THEN replace(replace(url, 'https://', ''), 'http://', '') ELSE url END AS url
FROM {pages}
"""
_AS_PAYLOADS = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Title: ' || lang || ' Markdown Content:  ' || text || '  '
  END AS payload FROM {documents}
"""


def urls_normalized(spark, sf_dir):
    return PG.normalize_urls(_from(spark, sf_dir, _AS_URLS, "pages"))


_URLS_SQL = f"""SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url)
  ELSE 'https://' || trim(url) END AS url FROM ({_duck(_AS_URLS, "pages")})"""


def envelopes_stripped(spark, sf_dir):
    return _from(spark, sf_dir, _AS_PAYLOADS, "documents").select(
        "doc_id", web.strip_envelope(F.col("payload")).alias("body"))


_STRIPPED_SQL = rf"""SELECT doc_id, CASE WHEN contains(payload, 'Markdown Content:') THEN
  regexp_replace(payload[strpos(payload, 'Markdown Content:') + 17:], '^\s+|\s+$', '', 'g')
  ELSE payload END AS body FROM ({_duck(_AS_PAYLOADS, "documents")})"""


def pages_markdown(spark, sf_dir):
    return PG.pages_to_markdown(text_table(spark, sf_dir, "pages")).select(
        "page_id", "markdown")


#: what the tags of the given pages come to, written down by hand
_MARKDOWN_SQL = r"""WITH kept AS (SELECT page_id, regexp_replace(regexp_replace(html, '\s+', ' ', 'g'),
    '(?i)<!--.*?-->|<!doctype[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<script>.*?</script>|<style>.*?</style>', '', 'g')
    AS html FROM pages),
  broken AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '<h1>', chr(10) || chr(10) || '# ', 'g'), '<br>', chr(10), 'g'),
    '</?(p|div|article|footer|body|html)( [^>]*)?>|</h1>', chr(10) || chr(10), 'g'), '</?b>', '', 'g') AS text FROM kept),
  decoded AS (SELECT page_id, replace(replace(replace(replace(text,
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS text FROM broken)
SELECT page_id, trim(regexp_replace(regexp_replace(text, ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  ' ' || chr(10)) AS markdown FROM decoded"""


#: a page for every order: lists in lists, numbers that go on, a table, preformatted text,
#: attributes in all quotes, references of all kinds
_ORDER_PAGES = r"""
WITH lines AS (SELECT l_orderkey, array_sort(collect_list(struct(
    l_linenumber AS n, CAST(l_partkey AS STRING) AS part, CAST(l_quantity AS INT) AS qty))) AS of FROM {lineitem}
  GROUP BY l_orderkey)
SELECT o_orderkey, concat(
  '<!DOCTYPE html><html><head><title>Order</title></head><body><nav><a href="/">home</a></nav>',
  '<h1 class=top>Order &#35;', o_orderkey, '</h1>\n<p>Of <i>customer</i>\n &lt;', o_custkey, '&gt; &amp;amp; others<br/>caf&eacute; &#x263A;</p>',
  '<ul><li>Status ', o_orderstatus, '<ol start=', o_orderkey % 5 + 1, '><li>', o_orderpriority, '</li><li>key<ul><li>deep</ul></ol></li>',
  '<li><p><a title=x href=\'/c/', o_custkey, '?a=1&amp;b=2\'> the customer </a></ul>',
  '<TABLE border=1><thead><tr><th>line</th><th>part | number</th></tr></thead><tbody>',
  array_join(transform(coalesce(of, array()), x -> concat('<tr><td>', x.n, '<td><p><a href=/p/', x.part, '>', x.part,
    '</a>&nbsp;x</p><div>', x.qty, '</div></tr>')), ''), '</tbody></table>',
  '<pre>\nkey\t', o_orderkey, '\n  a &lt; b\n</pre><hr><h3>End</h3><script>if (a < b) x("</p>")</script></body></html>') AS html
FROM {orders} LEFT JOIN lines ON l_orderkey = o_orderkey"""


def order_pages_markdown(spark, sf_dir):
    pages = spread(_from(spark, sf_dir, _ORDER_PAGES, "orders", "lineitem"), asked_spread(spark))
    return PG.pages_to_markdown(pages).select("o_orderkey", "markdown")


#: the same from the tables, without a page in between
_ORDER_PAGES_SQL = r"""
WITH lines AS (SELECT l_orderkey, string_agg('| ' || l_linenumber || ' | [' || l_partkey || '](/p/' || l_partkey || ') x '
    || l_quantity::INTEGER || ' |' || chr(10), '' ORDER BY l_linenumber, l_partkey::VARCHAR, l_quantity::INTEGER) AS rows
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, concat_ws(chr(10),
  '# Order #' || o_orderkey, '', 'Of customer <' || o_custkey || '> &amp; others', 'café ☺', '',
  '- Status ' || o_orderstatus,
  '  ' || (o_orderkey % 5 + 1) || '. ' || o_orderpriority, '  ' || (o_orderkey % 5 + 2) || '. key', '     - deep',
  '- [the customer](/c/' || o_custkey || '?a=1&b=2)', '',
  '| line | part \| number |', '| --- | --- |', coalesce(rows, ''),
  '```', 'key' || chr(9) || o_orderkey, '  a < b', '```', '', '---', '', '### End') AS markdown
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey"""


def documents_searched(spark, sf_dir):
    return PG.search_documents(
        table(spark, sf_dir, "documents"), "hesh the thand Ertion", language="en", page=2)


_SEARCH_SQL = """SELECT doc_id, lang, score FROM (
  SELECT doc_id, lang, (contains(lower(text), 'hesh')::INTEGER + contains(lower(text), 'the')::INTEGER
    + contains(lower(text), 'thand')::INTEGER + contains(lower(text), 'ertion')::INTEGER)::INTEGER AS score
  FROM documents WHERE lang = 'en') WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10"""


#: two words that most texts have and one that few have
RANKED_QUERY = "Of the haat"


def documents_ranked(spark, sf_dir):
    """The second page of a ranked search over an index of all documents."""
    index = SE.build_index(text_table(spark, sf_dir, "documents"), new_folder(spark, "search-index"))
    return SE.search_index(spark, index, RANKED_QUERY, num_results=25, page=2)


def documents_ranked_by_language(spark, sf_dir):
    index = SE.build_index(text_table(spark, sf_dir, "documents"), new_folder(spark, "search-index"))
    return SE.search_index(spark, index, "der la haat the die", "de")


def _ranked_sql(query: str, where: str, limit: str) -> str:
    words = ", ".join(f"'{w}'" for w in query.lower().split())
    return f"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
c AS (SELECT doc_id, lang, len(w) AS length, t, len(list_filter(w, lambda x: x = t)) AS tf
  FROM d, (SELECT unnest([{words}]) AS t) WHERE list_contains(w, t)),
f AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c, a GROUP BY t, n)
SELECT doc_id, lang, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM c JOIN f USING (t), a WHERE {where} GROUP BY doc_id, lang ORDER BY score DESC, doc_id {limit}"""


#: the same turns with null and tied conversations and places
_ODD_TURNS = """SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id END AS conv_id,
  CASE WHEN turn % 3 <> 2 THEN turn // 2 END AS turn, CASE WHEN turn <> 4 THEN role END AS role, text FROM {conversations}"""


def chat_system_first_odd_keys(spark, sf_dir):
    odd = _from(spark, sf_dir, _ODD_TURNS.replace("//", "div"), "conversations")
    return CH.chat_payload_system_first(odd, turns_per_part=100_000).select("conv_id", "part", "is_last", "body")


_ODD_CHAT_SQL = f"""
SELECT conv_id, 0::BIGINT AS part, true AS is_last, '{{"model":"{CH.SYSTEM_FIRST_MODEL}","messages":['
  || string_agg(CASE WHEN role IS NULL THEN to_json({{'content': text}})::VARCHAR
    ELSE to_json({{'role': role, 'content': text}})::VARCHAR END, ','
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text) || '],"temperature":0.7}}' AS body
FROM ({_duck(_ODD_TURNS, "conversations")}) GROUP BY conv_id"""


# --- outbox ------------------------------------------------------------------

_CHANNELS = ("mail_list", "smtp", "graph_mail", "raw_mail", "sms", "dm", "webhook")
_AS_OUTBOX = """
SELECT c_custkey AS msg_id,
  CASE c_custkey % 7 WHEN 0 THEN 'mail_list' WHEN 1 THEN 'smtp' WHEN 2 THEN 'graph_mail' WHEN 3 THEN 'raw_mail'
    WHEN 4 THEN 'sms' WHEN 5 THEN 'dm' ELSE 'webhook' END AS channel,
  'desk' || CAST(c_nationkey AS STRING) || '@example.com' AS from_email,
  CASE WHEN c_custkey % 2 = 0 THEN 'Desk ' || c_mktsegment END AS from_name,
  '+1555' || CAST(c_custkey AS STRING) AS from_number,
  lower(c_name) || '@example.org' AS to_email,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'whatsapp:+33' || CAST(c_custkey AS STRING) END AS to_number,
  CASE WHEN c_custkey % 3 = 0 THEN 'whatsapp' ELSE 'sms' END AS sms_channel,
  'r' || CAST(c_custkey AS STRING) AS recipient_id, 'ig' || CAST(c_nationkey AS STRING) AS account_id,
  'About "' || c_mktsegment || '" é' AS subject,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Dear ' || c_name || ', your balance changed. ' || c_mktsegment
    || ' / <b>ok?</b> àéî' END AS body,
  CASE WHEN c_custkey % 2 = 0 THEN 'html' ELSE 'text' END AS body_type,
  '<p>' || c_name || '</p>' AS html,
  CASE WHEN c_custkey % 5 = 0 THEN 'cc@example.net' END AS cc, CAST(NULL AS STRING) AS bcc,
  CASE WHEN c_custkey % 4 = 1 THEN 'answers@example.net' END AS reply_to,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'https://hook.example/' || CAST(c_custkey AS STRING) END AS url,
  CASE WHEN c_custkey % 2 = 0 THEN 'PUT' END AS method
FROM {customer}
"""


def outbox(spark, sf_dir):
    """Customers as addressees; the list and map columns are built the Spark way."""
    return _from(spark, sf_dir, _AS_OUTBOX, "customer").select(
        "*",
        F.expr("""CASE WHEN msg_id % 19 = 0 THEN cast(array() as array<struct<email:string,name:string>>)
          ELSE array(named_struct('email', to_email, 'name', from_name),
                     named_struct('email', 'second@example.org', 'name', null)) END""").alias("to_list"),
        F.expr("""CASE WHEN msg_id % 3 = 0 THEN map('Content-Type', 'text/plain', 'X-Id', string(msg_id))
          WHEN msg_id % 3 = 1 THEN map('X-Id', string(msg_id)) END""").alias("headers"),
    )


_DUCK_OUTBOX = _duck(_AS_OUTBOX, "customer")
_ERROR_SQL = """CASE
  WHEN channel IN ('mail_list', 'graph_mail') AND msg_id % 19 = 0 THEN 'MISSING_FIELDS'
  WHEN channel IN ('graph_mail', 'raw_mail', 'sms', 'dm', 'webhook') AND body IS NULL THEN 'MISSING_FIELDS'
  WHEN channel = 'sms' AND to_number = '' THEN 'MISSING_FIELDS'
  WHEN channel = 'webhook' AND url IS NULL THEN 'MISSING_FIELDS' END"""


def outbox_validated(spark, sf_dir):
    return OB.validate_outbox(outbox(spark, sf_dir)).select("msg_id", "channel", "error_code")


def outbox_built(spark, sf_dir):
    return OB.build_outbox(outbox(spark, sf_dir))


_NAME = "coalesce(',\"{0}\":' || to_json({1})::VARCHAR, '')"
_PAYLOAD_SQL = {
    "mail_list": rf"""'{{"From":{{"Email":' || to_json(from_email)::VARCHAR || {_NAME.format("Name", "from_name")}
      || '}},"To":[{{"Email":' || to_json(to_email)::VARCHAR || {_NAME.format("Name", "from_name")}
      || '}},{{"Email":"second@example.org"}}],"Subject":' || to_json(subject)::VARCHAR
      || ',"HTMLPart":' || to_json(html)::VARCHAR || '}}'""",
    "smtp": rf"""'{{"from":' || to_json(CASE WHEN from_name IS NOT NULL THEN from_name || ' <' || from_email || '>'
        ELSE from_email END)::VARCHAR || ',"to":' || to_json(to_email)::VARCHAR
      || {_NAME.format("cc", "cc")} || {_NAME.format("replyTo", "reply_to")} || ',"subject":' || to_json(subject)::VARCHAR
      || {_NAME.format("text", "body")} || ',"html":' || to_json(html)::VARCHAR || '}}'""",
    "graph_mail": r"""'{"message":{"subject":' || to_json(subject)::VARCHAR || ',"body":{"contentType":"'
      || CASE body_type WHEN 'html' THEN 'HTML' ELSE 'Text' END || '","content":' || to_json(body)::VARCHAR
      || '},"toRecipients":[{"emailAddress":{"address":' || to_json(to_email)::VARCHAR
      || '}},{"emailAddress":{"address":"second@example.org"}}],"ccRecipients":['
      || coalesce('{"emailAddress":{"address":' || to_json(cc)::VARCHAR || '}}', '') || '],"bccRecipients":[]}}'""",
    "raw_mail": r"""replace(replace(rtrim(to_base64(encode('From: ' || from_email || chr(13) || chr(10)
      || 'To: ' || to_email || chr(13) || chr(10) || coalesce('Cc: ' || cc || chr(13) || chr(10), '')
      || 'Subject: ' || subject || chr(13) || chr(10) || 'MIME-Version: 1.0' || chr(13) || chr(10)
      || 'Content-Type: ' || CASE body_type WHEN 'html' THEN 'text/html' ELSE 'text/plain' END
      || '; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || body)), '='), '+', '-'), '/', '_')""",
    "sms": r"""'{"from":"' || CASE sms_channel WHEN 'whatsapp' THEN 'whatsapp:' ELSE '' END || from_number
      || '","to":"' || to_number || '","body":' || to_json(body)::VARCHAR || '}'""",
    "dm": r"""to_json({'recipient': to_json({'comment_id': recipient_id})::VARCHAR,
      'message': to_json({'text': body})::VARCHAR})::VARCHAR""",
    "webhook": r"""'{"method":"' || coalesce(method, 'POST') || '","headers":{' || CASE msg_id % 3
        WHEN 0 THEN '"Content-Type":"text/plain","X-Id":"' || msg_id || '"'
        WHEN 1 THEN '"Content-Type":"application/json","X-Id":"' || msg_id || '"'
        ELSE '"Content-Type":"application/json"' END || '},"body":' || to_json(body)::VARCHAR || '}'""",
}
_BUILT_SQL = f"""SELECT msg_id, channel, CASE WHEN {_ERROR_SQL} IS NULL THEN CASE channel
  {" ".join(f"WHEN '{c}' THEN {sql}" for c, sql in _PAYLOAD_SQL.items())} END END AS payload_json,
  {_ERROR_SQL} AS error_code FROM ({_DUCK_OUTBOX})"""


def payload_raw_mail(spark, sf_dir):
    """Every customer's message as a raw mail."""
    col = F.col
    return outbox(spark, sf_dir).select("msg_id", P.payload_raw_mail(
        col("to_email"), col("subject"), F.coalesce("body", "html"), col("body_type"),
        col("from_email"), col("cc"), col("bcc")).alias("raw"))


_RAW_SQL = f"""SELECT msg_id, {_PAYLOAD_SQL["raw_mail"].replace("|| body)", "|| coalesce(body, html))")} AS raw
FROM ({_DUCK_OUTBOX})"""


def smtp_settings(spark, sf_dir):
    settings = outbox(spark, sf_dir).select(
        "msg_id", "from_name", "from_email",
        F.expr("CASE msg_id % 3 WHEN 0 THEN 465 WHEN 1 THEN 2525 END").alias("port"),
        F.expr("CASE WHEN msg_id % 5 = 0 THEN true END").alias("secure"))
    port, secure = F.col("port"), F.col("secure")
    return settings.select(
        "msg_id", P.from_header(F.col("from_name"), F.col("from_email")).alias("from_header"),
        P.smtp_port(port).alias("port"), P.smtp_secure(port, secure).alias("secure"),
        P.smtp_require_tls(port, secure).alias("require_tls"))


_SMTP_SQL = f"""SELECT msg_id, from_header, port, secure, NOT secure AND port = 587 AS require_tls FROM (
  SELECT msg_id, CASE WHEN from_name IS NOT NULL THEN from_name || ' <' || from_email || '>' ELSE from_email END
      AS from_header, (CASE msg_id % 3 WHEN 0 THEN 465 WHEN 1 THEN 2525 ELSE 587 END)::INTEGER AS port,
    msg_id % 5 = 0 OR msg_id % 3 = 0 AS secure FROM ({_DUCK_OUTBOX}))"""


# --- call logs ---------------------------------------------------------------

_AS_LOG = """
SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'garbage ' || event_type ELSE
  '[' || CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PATCH' END || '] /api/' || event_type
  || '?u=' || CAST(user_id AS STRING) || ' → ' || CASE event_id % 8 WHEN 0 THEN '500' WHEN 1 THEN '404'
    WHEN 2 THEN '429' WHEN 3 THEN '503' WHEN 4 THEN '502' ELSE '200' END
  || ' (' || CAST(event_id * 37 % 5000 AS STRING) || 'ms)' END AS line
FROM {events}
"""
AS_ENVELOPES = """
SELECT event_id, ts, CASE WHEN event_id % 4 = 0
  THEN '{{"ok": false, "error": {{"code": "' || CASE event_id % 3 WHEN 0 THEN 'PROVIDER_ERROR' ELSE 'INTERNAL_ERROR'
    END || '", "message": "m"}}, "meta": {{"durationMs": ' || CAST(event_id * 37 % 5000 AS STRING)
    || ', "provider": "' || event_type || '"}}}}'
  ELSE '{{"ok": true, "data": ' || props || ', "meta": {{"durationMs": ' || CAST(event_id * 37 % 5000 AS STRING)
    || ', "provider": "' || event_type || '"}}}}' END AS envelope
FROM {events}
"""


def request_log(spark, sf_dir):
    return CA.parse_request_log(_from(spark, sf_dir, _AS_LOG, "events")).drop("line")


_LOG_RX = r"'^\[([A-Z]+)\] (.*) → (\d+) \((\d+)ms\)$'"
_LOG_SQL = f"""SELECT event_id, nullif(regexp_extract(line, {_LOG_RX}, 1), '') AS method,
  nullif(regexp_extract(line, {_LOG_RX}, 2), '') AS url,
  nullif(regexp_extract(line, {_LOG_RX}, 3), '')::INTEGER AS status,
  nullif(regexp_extract(line, {_LOG_RX}, 4), '')::BIGINT AS duration_ms
FROM ({_duck(_AS_LOG, "events")})"""


def envelopes(spark, sf_dir):
    return CA.parse_envelopes(_from(spark, sf_dir, AS_ENVELOPES, "events"))


def calls_rolled_up(spark, sf_dir):
    rolled = CA.call_rollup(envelopes(spark, sf_dir))
    return rolled.withColumns({c: F.round(c, 6) for c in ("ok_rate", "avg_ms", "p50_ms")})


_CALLS = f"""SELECT event_id, (envelope->>'$.ok')::BOOLEAN AS ok, envelope->>'$.error.code' AS error_code,
  envelope->>'$.meta.provider' AS provider, (envelope->>'$.meta.durationMs')::BIGINT AS duration_ms
  FROM ({_duck(AS_ENVELOPES, "events")})"""
_ROLLED_SQL = f"""SELECT provider, count(*) AS n_calls, round(avg(ok::INTEGER), 6) AS ok_rate,
  round(avg(duration_ms), 6) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
  max(duration_ms) AS max_ms FROM ({_CALLS}) GROUP BY provider"""


def errors_rolled_up(spark, sf_dir):
    return CA.error_rollup(envelopes(spark, sf_dir))


_ERRORS_SQL = f"""SELECT provider, error_code, count(*) AS n_errors FROM ({_CALLS})
WHERE error_code IS NOT NULL GROUP BY ALL"""


def retries_classified(spark, sf_dir):
    log = CA.parse_request_log(_from(spark, sf_dir, _AS_LOG, "events"))
    tried = log.withColumn("attempt", F.expr("cast(event_id % 7 as int)"))
    return CA.classify_retryable(tried).select("event_id", "status", "retryable", "delay_ms")


_RETRY_SQL = f"""SELECT event_id, status, coalesce(status IN (429, 500, 502, 503, 504), false) AS retryable,
  CASE WHEN status IN (429, 500, 502, 503, 504) THEN least(1000 * 2 ** (event_id % 7), 30000)::BIGINT END AS delay_ms
FROM ({_LOG_SQL})"""


QUERIES = {
    "extract_json": (extract_json, f"SELECT event_id, json(j)::VARCHAR AS parsed FROM ({_JSON_IN_DUCK})"),
    "extract_json_with_schema": (
        extract_json_with_schema,
        f"SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN (j->>'$.k')::BIGINT END AS k FROM ({_JSON_IN_DUCK})"),
    "response_text": (response_text, _RESPONSE_SQL),
    "first_text_block": (first_text_block, _BLOCK_SQL),
    "chat_system_first": (chat_system_first, _system_first_sql(1024, ',"max_tokens":512')),
    "chat_system_first_in_parts": (
        chat_system_first_in_parts, _system_first_sql(3, ',"response_format":{"type":"json_object"}')),
    "chat_system_field": (chat_system_field, _system_field_sql(1024)),
    "chat_system_field_in_parts": (chat_system_field_in_parts, _system_field_sql(2)),
    "chat_history_last": (chat_history_last, _history_sql(1024)),
    "chat_history_last_in_parts": (chat_history_last_in_parts, _history_sql(2)),
    "messages_by_label": (messages_by_label, _BY_LABEL_SQL),
    "messages_page": (messages_page, _PAGE_SQL),
    "messages_deep_page": (messages_deep_page, _DEEP_PAGE_SQL),
    "message_by_id": (
        message_by_id, f"SELECT msg_id, role, body FROM ({_DUCK_MESSAGES}) WHERE msg_id = 100"),
    "labels_modified": (labels_modified, _MODIFY_SQL),
    "marked_read": (marked_read, _READ_SQL),
    "conversations_listed": (conversations_listed, _LISTED_SQL),
    "conversation_messages": (conversation_messages, _NEWEST_SQL),
    "inquiries_validated": (inquiries_validated, _VALIDATED_SQL),
    "inquiries_logged": (inquiries_logged, _LOGGED_SQL),
    "inquiry_stats_today": (_stats("today"), _stats_sql(
        f"horodatage BETWEEN date_trunc('day', TIMESTAMP '{_AS_OF}') AND TIMESTAMP '{_AS_OF}'")),
    "inquiry_stats_week": (_stats("week"), _stats_sql(
        f"horodatage BETWEEN date_trunc('day', TIMESTAMP '{_AS_OF}') - INTERVAL 6 DAYS AND TIMESTAMP '{_AS_OF}'")),
    "inquiry_stats_all": (_stats("all"), _stats_sql("true")),
    "urls_normalized": (urls_normalized, _URLS_SQL),
    "envelopes_stripped": (envelopes_stripped, _STRIPPED_SQL),
    "pages_markdown": (pages_markdown, _MARKDOWN_SQL),
    "order_pages_markdown": (order_pages_markdown, _ORDER_PAGES_SQL),
    "documents_searched": (documents_searched, _SEARCH_SQL),
    "documents_ranked": (documents_ranked, _ranked_sql(RANKED_QUERY, "true", "LIMIT 25 OFFSET 25")),
    "documents_ranked_by_language": (documents_ranked_by_language, _ranked_sql(
        "der la haat the die", "lang = 'de'", "LIMIT 10")),
    "chat_system_first_odd_keys": (chat_system_first_odd_keys, _ODD_CHAT_SQL),
    "outbox_validated": (
        outbox_validated, f"SELECT msg_id, channel, {_ERROR_SQL} AS error_code FROM ({_DUCK_OUTBOX})"),
    "outbox_built": (outbox_built, _BUILT_SQL),
    "payload_raw_mail": (payload_raw_mail, _RAW_SQL),
    "smtp_settings": (smtp_settings, _SMTP_SQL),
    "request_log": (request_log, _LOG_SQL),
    "calls_rolled_up": (calls_rolled_up, _ROLLED_SQL),
    "errors_rolled_up": (errors_rolled_up, _ERRORS_SQL),
    "retries_classified": (retries_classified, _RETRY_SQL),
}
