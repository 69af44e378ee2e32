"""Registered streaming queries: each drains a file stream of a given table. Their
statements are those of the batch result that the stream has to reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.plans import masking, records
from veilframe.plans.detection import DEFAULT, _DOCS
from veilframe.sources.session import new_folder
from veilframe.sources.tables import CSV, read_texts, stream, stream_texts, table
from veilframe.streaming.answers import AnswerRestorer
from veilframe.streaming.calls import call_rollup_stream, hourly_calls, hourly_durations
from veilframe.streaming.inquiries import (
    closed_day_senders, daily_inquiries, daily_senders, inquiry_log, inquiry_stats_stream, log_inquiries_stream,
)
from veilframe.streaming.masking import ConversationMasker, mask_stream, span_figures
from veilframe.streaming.run import drain
from veilframe.streaming.state import StatefulMasker, use_rocksdb


def mask_stream_documents(spark, sf_dir):
    masked = mask_stream(stream(spark, sf_dir, "documents"), config=DEFAULT)
    return drain(masked.select("doc_id", "masked"), "masked-documents")


def mask_conversation_stream(spark, sf_dir):
    masker = ConversationMasker(new_folder(spark, "masked-conversations"), config=DEFAULT)
    masker.start(stream(spark, sf_dir, "conversations"), availableNow=True).awaitTermination()
    return masker.masked(spark).select("conv_id", "turn", "role", "masked")


def mask_conversation_state(spark, sf_dir):
    """The same with operator state instead of a mapping table."""
    masker = StatefulMasker(new_folder(spark, "masked-by-state"), config=DEFAULT)
    masker.start(stream(use_rocksdb(spark), sf_dir, "conversations"), availableNow=True).awaitTermination()
    return masker.masked(spark).select("conv_id", "turn", "role", "masked")


#: when a turn was sent and answered: every eleventh answer comes too late
_SENT_AT = "timestamp_seconds(1700000000 + conv_id * 60 + turn)"
_WAIT = "CASE WHEN (conv_id + turn) % 11 = 0 THEN 7200 ELSE 60 * (turn % 7) END"


def restore_stream(spark, sf_dir):
    """Mask a stream of turns, echo it, and restore the echoes that come within an hour."""
    base = new_folder(spark, "restored-answers")
    masker = ConversationMasker(f"{base}/masker", config=DEFAULT)
    masker.start(stream(spark, sf_dir, "conversations"), availableNow=True).awaitTermination()
    schema = table(spark, sf_dir, "conversations").schema.add("masked", "string")
    echoes = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/masker/masked")
    sent = echoes.selectExpr("conv_id", "turn", f"{_SENT_AT} AS sent_at", "masked")
    answers = echoes.selectExpr(
        "conv_id", "turn", f"timestamp_seconds(unix_timestamp({_SENT_AT}) + {_WAIT}) AS answered_at", "masked AS content")
    restorer = AnswerRestorer(base, masker.mapping)
    restorer.start(sent, answers, availableNow=True).awaitTermination()
    return restorer.restored(spark).select("conv_id", "turn", "content", "restored")


_RESTORE_STREAM_SQL = masking.O.statement(masking._ctes(masking._CONVERSATIONS) + [masking._RESTORED], f"""
SELECT conv_id, turn, masked AS content, restored
FROM conversations JOIN masked ON masked.scope = conv_id AND masked.item = turn
JOIN restored ON restored.scope = conv_id AND restored.item = turn WHERE {_WAIT} <= 3600""")


def _event_stream(spark, sf_dir, sql):
    return spark.sql(sql, events=stream(spark, sf_dir, "events"))


def _filled(table, stream_):
    """The table after everything available was read."""
    table.start(stream_, availableNow=True).awaitTermination()
    return table.read(stream_.sparkSession)


def _inquiry_stream(spark, sf_dir):
    return _event_stream(spark, sf_dir, records.AS_INQUIRIES).withColumn(
        "horodatage", F.expr("cast(horodatage as timestamp)"))


def inquiries_logged_stream(spark, sf_dir):
    log = inquiry_log(new_folder(spark, "inquiries"), F.lit(records._AS_OF).cast("timestamp"))
    return _filled(log, _inquiry_stream(spark, sf_dir)).select(
        "canal", "source", "expediteur", "texte", "external_id",
        F.date_format("horodatage", "yyyy-MM-dd HH:mm:ss").alias("horodatage"))


def inquiry_stats_daily_stream(spark, sf_dir):
    daily = _filled(daily_inquiries(new_folder(spark, "inquiry-stats")), _inquiry_stream(spark, sf_dir))
    return daily.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_DAILY_SQL = f"""
SELECT strftime(date_trunc('day', horodatage), '%Y-%m-%d') AS day, canal, source,
  count(*)::BIGINT AS n_inquiries
FROM ({records._DUCK_INQUIRIES}) WHERE horodatage IS NOT NULL GROUP BY ALL"""


def calls_hourly_stream(spark, sf_dir):
    calls = _event_stream(spark, sf_dir, records.AS_ENVELOPES).withColumn(
        "ts", F.expr("cast(ts as timestamp)"))
    hourly = _filled(hourly_calls(new_folder(spark, "calls")), calls)
    return hourly.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


_HOURLY_SQL = f"""
WITH c AS (SELECT * FROM ({records._CALLS}) JOIN (SELECT event_id, ts FROM events) USING (event_id))
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, provider, count(*) AS n_calls,
  count(*) FILTER (NOT ok) AS n_failed, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms
FROM c GROUP BY ALL"""


def inquiries_logged_watermark(spark, sf_dir):
    """One inquiry per id within the watermark's state; which one is open, so the ids are shown.
    All rows come in one batch here, before any watermark: none is late."""
    now = F.lit(records._AS_OF).cast("timestamp")
    return drain(log_inquiries_stream(_inquiry_stream(spark, sf_dir), now).select("external_id"), "inquiry-ids")


_IDS_SQL = f"""
WITH valid AS (SELECT * FROM ({records._DUCK_INQUIRIES})
  WHERE canal IN ('instagram', 'email') AND expediteur != '' AND texte IS NOT NULL)
SELECT DISTINCT external_id FROM valid WHERE external_id IS NOT NULL
UNION ALL SELECT external_id FROM valid WHERE external_id IS NULL"""


def inquiry_stats_watermark(spark, sf_dir):
    """Figures of the days that the watermark, a day behind the last inquiry, has closed."""
    days = drain(inquiry_stats_stream(_inquiry_stream(spark, sf_dir)), "closed-days")
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_CLOSED_DAYS_SQL = f"""
SELECT * FROM ({_DAILY_SQL}) WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <=
  (SELECT max(horodatage) - INTERVAL 1 DAY FROM ({records._DUCK_INQUIRIES}))"""


def calls_hourly_watermark(spark, sf_dir):
    """Figures of the hours that the watermark, ten minutes behind the last call, has closed."""
    calls = _event_stream(spark, sf_dir, records.AS_ENVELOPES).withColumn(
        "ts", F.expr("cast(ts as timestamp)"))
    hours = drain(call_rollup_stream(calls), "closed-hours")
    return hours.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


_CLOSED_HOURS_SQL = f"""
SELECT * FROM ({_HOURLY_SQL}) WHERE strptime(hour, '%Y-%m-%d %H') + INTERVAL 1 HOUR <=
  (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def call_durations_stream(spark, sf_dir):
    """Quantiles of durations by sketch. Groups of fewer than 800 calls, as all are here, are exact."""
    calls = _event_stream(spark, sf_dir, records.AS_ENVELOPES).withColumn(
        "ts", F.expr("cast(ts as timestamp)"))
    hourly = _filled(hourly_durations(new_folder(spark, "durations")), calls)
    return hourly.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


_DURATIONS_SQL = f"""
WITH c AS (SELECT * FROM ({records._CALLS}) JOIN (SELECT event_id, ts FROM events) USING (event_id))
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, provider, count(duration_ms) AS n_timed,
  quantile_disc(duration_ms, 0.5)::BIGINT AS p50, quantile_disc(duration_ms, 0.95)::BIGINT AS p95,
  quantile_disc(duration_ms, 0.99)::BIGINT AS p99
FROM c WHERE duration_ms IS NOT NULL GROUP BY ALL"""


_TEXTS = "doc_id long, lang string, text string"


def _written(spark, sf_dir, fmt):
    """The documents in files of another format."""
    path = new_folder(spark, f"documents-{fmt}")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows.write.options(**({**CSV, "quoteAll": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    return path


def _read_back(fmt):
    return lambda spark, sf_dir: read_texts(spark, _written(spark, sf_dir, fmt), fmt, _TEXTS)


def _streamed_back(fmt):
    def query(spark, sf_dir):
        masked = mask_stream(stream_texts(spark, _written(spark, sf_dir, fmt), _TEXTS, fmt), config=DEFAULT)
        return drain(masked.select("doc_id", "masked"), f"masked-{fmt}")

    return query


_TEXTS_SQL = "SELECT doc_id, lang, text FROM documents"


def _near(estimate: str, exact: str):
    """Within five standard errors of the sketch, or one."""
    return F.expr(f"abs({estimate} - {exact}) <= greatest(1.0, 5 * 1.04 / 64 * {exact})")


#: days that are closed
_CLOSED = "2024-01-21 00:00:00"


def inquiry_senders_stream(spark, sf_dir):
    """Senders of closed days, exact, and whether the estimate is as near as it should be."""
    inquiries, base = _inquiry_stream(spark, sf_dir), new_folder(spark, "senders")
    about = _filled(daily_senders(f"{base}/about"), inquiries)
    exact = _filled(closed_day_senders(f"{base}/exact", F.lit(_CLOSED).cast("timestamp")), inquiries)
    both = about.join(exact, ["day", "canal", "source"])
    return both.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "canal", "source", "n_inquiries",
                       "n_senders", _near("n_senders_about", "n_senders").alias("near"))


_SENDERS_SQL = f"""
SELECT strftime(date_trunc('day', horodatage), '%Y-%m-%d') AS day, canal, source, count(*)::BIGINT AS n_inquiries,
  count(DISTINCT expediteur) AS n_senders, true AS near
FROM ({records._DUCK_INQUIRIES}) WHERE horodatage < TIMESTAMP '{_CLOSED}' GROUP BY ALL"""


def span_figures_stream(spark, sf_dir):
    """Spans of a stream of documents by source, with the estimate of values held against the exact number."""
    renamed = stream(spark, sf_dir, "documents").withColumnRenamed("source", "doc_source")
    about = _filled(span_figures(new_folder(spark, "span-figures"), ["doc_source"], config=DEFAULT), renamed)
    exact = masking.span_rollup_sources(spark, sf_dir).select("doc_source", "category", "n_values")
    return about.join(exact, ["doc_source", "category"]).select(
        "doc_source", "category", "n_spans", "n_values", _near("n_values_about", "n_values").alias("near"))


QUERIES = {
    "mask_stream_documents": (mask_stream_documents, masking._masked_sql(
        _DOCS, "SELECT scope AS doc_id, masked FROM masked")),
    "mask_conversation_stream": (mask_conversation_stream, masking._masked_sql(
        masking._CONVERSATIONS, "SELECT conv_id, turn, role, masked FROM masked "
        "JOIN conversations ON conv_id = scope AND turn = item")),
    "mask_conversation_state": (mask_conversation_state, masking._masked_sql(
        masking._CONVERSATIONS, "SELECT conv_id, turn, role, masked FROM masked "
        "JOIN conversations ON conv_id = scope AND turn = item")),
    "restore_stream": (restore_stream, _RESTORE_STREAM_SQL),
    "inquiries_logged_watermark": (inquiries_logged_watermark, _IDS_SQL),
    "inquiry_stats_watermark": (inquiry_stats_watermark, _CLOSED_DAYS_SQL),
    "calls_hourly_watermark": (calls_hourly_watermark, _CLOSED_HOURS_SQL),
    "texts_from_json": (_read_back("json"), _TEXTS_SQL),
    "texts_from_csv": (_read_back("csv"), _TEXTS_SQL),
    "texts_from_orc": (_read_back("orc"), _TEXTS_SQL),
    "mask_stream_json": (_streamed_back("json"), masking._masked_sql(
        _DOCS, "SELECT scope AS doc_id, masked FROM masked")),
    "mask_stream_csv": (_streamed_back("csv"), masking._masked_sql(
        _DOCS, "SELECT scope AS doc_id, masked FROM masked")),
    "call_durations_stream": (call_durations_stream, _DURATIONS_SQL),
    "inquiry_senders_stream": (inquiry_senders_stream, _SENDERS_SQL),
    "span_figures_stream": (span_figures_stream, f"SELECT *, true AS near FROM ({masking._ROLLUP_SOURCES_SQL})"),
    "inquiries_logged_stream": (inquiries_logged_stream, records._LOGGED_SQL),
    "inquiry_stats_daily_stream": (inquiry_stats_daily_stream, _DAILY_SQL),
    "calls_hourly_stream": (calls_hourly_stream, _HOURLY_SQL),
}
