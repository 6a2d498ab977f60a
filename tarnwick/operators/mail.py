"""Mail: candidate filters, predicates, the person graph, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import text as T


def candidates(mail: DataFrame, sender: str | None = None, like: str | None = None, unlike: str | None = None, received_from: str | None = None, received_to: str | None = None) -> DataFrame:
    """Mail that meets all given clauses; times are compared as ISO text, so a bare date as upper bound excludes that day's timed rows."""
    out = mail
    if sender:
        out = out.where(F.lower("sender") == sender.lower())
    if like:
        out = out.where(F.contains(F.lower("sender"), F.lit(like.lower())))
    if unlike:
        out = out.where(~F.contains(F.lower("sender"), F.lit(unlike.lower())))
    if received_from:
        out = out.where(F.col("received") >= received_from)
    if received_to:
        out = out.where(F.col("received") <= received_to)
    return out


def search(mail: DataFrame, since: str | None = None, until: str | None = None, unread: bool = False, attachments: bool = False, sender: str = "", subject: str = "", body: str = "", query: str = "", limit: int = 50) -> DataFrame:
    """Newest mail first under an inclusive date range, flags and substrings."""
    has = lambda c, s: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(s.lower()))
    out = mail
    if since:
        out = out.where(F.to_date("received") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.to_date("received") <= F.lit(until).cast("date"))
    if unread:
        out = out.where("unread")
    if attachments:
        out = out.where("has_attachments")
    for col, s in (("sender", sender), ("subject", subject), ("body", body)):
        if s:
            out = out.where(has(col, s))
    if query:
        out = out.where(has("subject", query) | has("body", query) | has("sender", query))
    return out.orderBy(F.desc("received"), "mail_id").limit(limit)


def person_edges(mail: DataFrame) -> DataFrame:
    """(mail_id, person, rel): SENT and RECEIVED edges of the addresses in both headers, each once."""
    one = lambda col, rel: mail.select("mail_id", F.explode(T.addresses(F.col(col))).alias("person"), F.lit(rel).alias("rel"))
    return one("sender", "SENT").unionByName(one("recipients", "RECEIVED")).distinct()


def mail_id(identifier, subject, received, sender):
    return F.substring(F.sha1(F.concat_ws("|", identifier, subject, received, sender)), 1, 20)


def markdown(mail: DataFrame) -> DataFrame:
    """(mail_id, markdown): header lines and body."""
    line = lambda name, c: F.concat(F.lit(f"- **{name}:** "), F.coalesce(F.col(c), F.lit("")))
    return mail.select("mail_id", F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("subject", F.lit("(no subject)"))), F.lit(""), line("From", "sender"), line("To", "recipients"), line("Date", "received"), F.lit(""), F.coalesce("body", F.lit(""))).alias("markdown"))
