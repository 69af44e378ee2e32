"""The outbox: one wide message table in, one request body per message out.

Columns (null where a channel does not use them): ``msg_id, channel, from_email,
from_name, from_number, to_email, to_list ARRAY<STRUCT<email,name>>, to_number,
recipient_id, account_id, subject, body, html, body_type, cc, bcc, url, method,
headers MAP<STRING,STRING>, sms_channel``; ``reply_to`` may be left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import payloads as P

MISSING_FIELDS = "MISSING_FIELDS"


def _missing(*names: str) -> Column:
    """Some field is null or empty."""
    hit = F.lit(False)
    for name in names:
        hit = hit | (F.coalesce(F.col(name), F.lit("")) == "")
    return hit


def _no_recipients() -> Column:
    return F.coalesce(F.size("to_list"), F.lit(0)) <= 0


def validate_outbox(outbox: DataFrame) -> DataFrame:
    """Adds ``error_code`` by the required fields of each channel."""
    lacking = {
        "mail_list": _missing("from_email", "subject", "html") | _no_recipients(),
        "smtp": _missing("from_email", "to_email", "subject") | (
            _missing("body") & _missing("html")),
        "graph_mail": _missing("subject", "body") | _no_recipients(),
        "raw_mail": _missing("to_email", "subject", "body"),
        "sms": _missing("to_number", "body"),
        "dm": _missing("account_id", "recipient_id", "body"),
        "webhook": _missing("url") | F.col("body").isNull(),
    }
    code = F.when(~F.coalesce(F.col("channel").isin(*lacking), F.lit(False)), "INVALID_FIELD")
    for channel, condition in lacking.items():
        code = code.when((F.col("channel") == channel) & condition, MISSING_FIELDS)
    return outbox.withColumn("error_code", code)


def build_outbox(outbox: DataFrame) -> DataFrame:
    """``msg_id, channel, payload_json, error_code``; no body for a rejected message.
    A projection, so the same on a batch and on a stream."""
    col = F.col
    reply_to = col("reply_to") if "reply_to" in outbox.columns else F.lit(None).cast("string")
    addresses = F.transform("to_list", lambda t: t["email"])
    listed = lambda c: F.when(col(c).isNotNull(), F.array(col(c)))
    bodies = {
        "mail_list": P.payload_recipient_list(
            col("from_email"), col("from_name"), col("to_list"), col("subject"), col("html")),
        "smtp": F.to_json(F.struct(
            P.from_header(col("from_name"), col("from_email")).alias("from"),
            col("to_email").alias("to"), col("cc"), col("bcc"), reply_to.alias("replyTo"), col("subject"),
            col("body").alias("text"), col("html"))),
        "graph_mail": P.payload_graph_mail(
            addresses, col("subject"), col("body"), col("body_type"), listed("cc"), listed("bcc")),
        "raw_mail": P.payload_raw_mail(
            col("to_email"), col("subject"), col("body"), col("body_type"), col("from_email"),
            col("cc"), col("bcc")),
        "sms": P.payload_sms(col("from_number"), col("to_number"), col("body"), col("sms_channel")),
        "dm": P.payload_dm(col("recipient_id"), col("body")),
        "webhook": P.payload_webhook(col("method"), col("headers"), col("body")),
    }
    payload = F.when(col("error_code").isNotNull(), F.lit(None).cast("string"))
    for channel, body in bodies.items():
        payload = payload.when(col("channel") == channel, body)
    return validate_outbox(outbox).select(
        "msg_id", "channel", payload.alias("payload_json"), "error_code")
