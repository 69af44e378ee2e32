"""Expressions that build the request bodies of the outgoing channels. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail header lines, ports, prefixes and defaults of the channels.
WHATSAPP_PREFIX = "whatsapp:"
SMTP_PORT = 587
SMTPS_PORT = 465
WEBHOOK_METHOD = "POST"
JSON_CONTENT = ("Content-Type", "application/json")


def payload_recipient_list(from_email: Column, from_name: Column, to: Column, subject: Column,
                           html: Column) -> Column:
    """``From/To/Subject/HTMLPart``; ``to`` is ``ARRAY<STRUCT<email,name>>``. Absent
    names are left out, as ``to_json`` does with nulls."""
    return F.to_json(F.struct(
        F.struct(from_email.alias("Email"), from_name.alias("Name")).alias("From"),
        F.transform(to, lambda t: F.struct(t["email"].alias("Email"), t["name"].alias("Name")))
        .alias("To"),
        subject.alias("Subject"), html.alias("HTMLPart"),
    ))


def payload_graph_mail(to: Column, subject: Column, body: Column, body_type: Column,
                       cc: Column, bcc: Column, save_to_sent: Column | None = None) -> Column:
    """A mail as nested objects; missing cc and bcc become empty lists. With
    ``save_to_sent`` (null means yes) the form for applications."""
    def addresses(column: Column) -> Column:
        some = F.coalesce(column, F.array().cast("array<string>"))
        return F.transform(some, lambda a: F.struct(
            F.struct(a.alias("address")).alias("emailAddress")))

    message = F.struct(
        subject.alias("subject"),
        F.struct(
            F.when(body_type == "html", "HTML").otherwise("Text").alias("contentType"),
            body.alias("content"),
        ).alias("body"),
        addresses(to).alias("toRecipients"), addresses(cc).alias("ccRecipients"),
        addresses(bcc).alias("bccRecipients"),
    )
    fields = [message.alias("message")]
    if save_to_sent is not None:
        fields.append(F.coalesce(save_to_sent, F.lit(True)).alias("saveToSentItems"))
    return F.to_json(F.struct(*fields))


def base64url(text: Column) -> Column:
    """Without padding and without the line ends of the MIME alphabet."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def payload_raw_mail(to: Column, subject: Column, body: Column, body_type: Column,
                     from_: Column, cc: Column, bcc: Column) -> Column:
    """An RFC 822 text in base64url: headers in fixed order, absent ones left out."""
    def header(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}: "), value))

    kind = F.when(body_type == "html", "text/html").otherwise("text/plain")
    head = F.concat_ws(
        "\r\n",
        header("From", from_), F.concat(F.lit("To: "), to), header("Cc", cc), header("Bcc", bcc),
        F.concat(F.lit("Subject: "), subject), F.lit("MIME-Version: 1.0"),
        F.concat(F.lit("Content-Type: "), kind, F.lit("; charset=utf-8")),
    )
    return base64url(F.concat(head, F.lit("\r\n\r\n"), body))


def from_header(name: Column, email: Column) -> Column:
    return F.when(name != "", F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(email)


def smtp_port(port: Column) -> Column:
    return F.coalesce(F.nullif(port, F.lit(0)), F.lit(SMTP_PORT))


def smtp_secure(port: Column, secure: Column) -> Column:
    return F.coalesce(secure, smtp_port(port) == SMTPS_PORT)


def smtp_require_tls(port: Column, secure: Column) -> Column:
    return ~smtp_secure(port, secure) & (smtp_port(port) == SMTP_PORT)


def sms_number(number: Column, channel: Column) -> Column:
    prefixed = F.when(number.startswith(WHATSAPP_PREFIX), number).otherwise(
        F.concat(F.lit(WHATSAPP_PREFIX), number))
    return F.when(channel == "whatsapp", prefixed).otherwise(number)


def payload_sms(from_: Column, to: Column, body: Column, channel: Column) -> Column:
    return F.to_json(F.struct(
        sms_number(from_, channel).alias("from"), sms_number(to, channel).alias("to"),
        body.alias("body"),
    ))


def payload_dm(recipient_id: Column, message: Column) -> Column:
    """Recipient and message are JSON texts inside the JSON."""
    return F.to_json(F.struct(
        F.to_json(F.struct(recipient_id.alias("comment_id"))).alias("recipient"),
        F.to_json(F.struct(message.alias("text"))).alias("message"),
    ))


def webhook_method(method: Column) -> Column:
    return F.coalesce(F.nullif(method, F.lit("")), F.lit(WEBHOOK_METHOD))


def webhook_headers(headers: Column) -> Column:
    """JSON content type unless the caller's headers (a map) name another."""
    name, value = JSON_CONTENT
    own = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    return F.when(F.map_contains_key(own, name), own).otherwise(
        F.map_concat(F.create_map(F.lit(name), F.lit(value)), own))


def payload_webhook(method: Column, headers: Column, body: Column) -> Column:
    return F.to_json(F.struct(
        webhook_method(method).alias("method"), webhook_headers(headers).alias("headers"),
        body.alias("body"),
    ))
