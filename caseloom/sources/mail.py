"""Mailboxes: maildir trees, a CSV with raw messages, or rows (locator, raw), to records, events and links.

Messages are parsed by the standard library in Arrow batches; all else is columns. Replies link to what they answer,
thread roots and machine notices claim to be runs, and a subject groups only what nothing stronger has threaded.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import DIRECT, HEURISTIC, JOINED, Shaped, shaped

_FIELDS = "locator string, seq long, subject string, sender string, to_ string, cc string, date_iso string, mid string, irt string, body string"
#: Fixed values that results depend on.
BOT = r"noreply|no-reply|donotreply|do-not-reply|mailer-daemon|postmaster|notifications|automated|auto-confirm|bounce"


def read_maildir(spark: SparkSession, path: str) -> DataFrame:
    """(locator, raw, seq) of every file below ``path``; ``seq`` is a hash of the path, so that no task numbers all files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("path").alias("locator"), F.decode("content", "ISO-8859-1").alias("raw")).withColumn("seq", F.shiftrightunsigned(F.xxhash64("locator"), 4))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(locator, raw, seq) of an mbox file, cut at its From lines."""
    whole = spark.read.text(path, wholetext=True, lineSep=None).select(F.split("value", r"(?m)^From (?=\S+@?\S* .*\d{4}\s*$)").alias("m"))
    parts = whole.select(F.posexplode("m").alias("seq", "raw")).filter("trim(raw) <> ''")
    return parts.select(F.concat(F.lit(path + "#"), F.col("seq").cast("string")).alias("locator"), F.regexp_replace("raw", r"^[^\n]*\d{4}\s*\n", "").alias("raw"), F.col("seq").cast("long").alias("seq"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for loc, raw, seq in zip(pdf.locator, pdf.raw, pdf.seq):
            m = email.message_from_string(raw or "", policy=email.policy.compat32)
            get = lambda h: str(m.get(h, "") or "")
            try:
                when = email.utils.parsedate_to_datetime(get("Date")).isoformat() if get("Date") else None
            except (ValueError, TypeError):
                when = None
            body = None
            for part in m.walk():
                if part.get_content_type() == "text/plain":
                    data = part.get_payload(decode=True)
                    body = (data.decode("utf-8", "replace") if data is not None else str(part.get_payload()))[:400]
                    break
            rows.append((loc, seq, get("Subject"), get("From"), get("To"), get("Cc"), when, get("Message-ID"), get("In-Reply-To"), body))
        yield pd.DataFrame(rows, columns=["locator", "seq", "subject", "sender", "to_", "cc", "date_iso", "mid", "irt", "body"])


def shape(messages: DataFrame, slug: str) -> Shaped:
    """Rows (locator, raw, seq) to the canonical tables."""
    source = f"email:{slug}"
    m = messages.select("locator", "raw", "seq").mapInPandas(_parse, _FIELDS)
    m = m.withColumn("from_", X.address(F.col("sender"))).withColumn("date_raw", F.col("date_iso"))
    mid = F.coalesce(F.nullif(F.regexp_replace(F.trim("mid"), "^<|>$", ""), F.lit("")), F.left(F.sha1(F.concat_ws("|", F.coalesce("from_", F.lit("")), F.coalesce("date_raw", F.lit("")), "subject").cast("binary")), F.lit(16)))
    m = m.withColumn("mid", mid).withColumn("irt", F.nullif(F.regexp_replace(F.trim("irt"), "^<|>$", ""), F.lit("")))
    eid = F.concat(F.lit(f"email:{slug}:"), F.col("mid"))
    m = m.withColumn("eid", eid).withColumn("norm", X.subject_key(F.col("subject"))).withColumn("bot", F.coalesce(F.lower("from_").rlike(BOT), F.lit(False)))
    entities = m.select(F.col("eid").alias("entity_id"), F.lit(source).alias("source"), F.lit("email").alias("type"), F.create_map(F.lit("subject"), F.col("subject"), F.lit("body"), F.col("body"), F.lit("from"), F.col("from_"), F.lit("to"), F.array_join(X.addresses(F.col("to_")), ","), F.lit("cc"), F.array_join(X.addresses(F.col("cc")), ",")).alias("attrs"), X.pooled_text(F.col("subject"), F.col("body")).alias("text"), F.lit(DIRECT).alias("tier"), "locator", F.left("subject", F.lit(200)).alias("snippet"), "seq")
    everyone = F.explode(F.array_distinct(F.concat(F.array("from_"), X.addresses(F.col("to_")), X.addresses(F.col("cc"))))).alias("who")
    people = m.select(everyone, "seq").filter("who is not null").groupBy("who").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    persons = people.select(F.concat(F.lit("person:"), "who").alias("entity_id"), F.lit(source).alias("source"), F.lit("person").alias("type"), F.create_map(F.lit("email"), F.col("who"), F.lit("is_bot"), F.lower("who").rlike(BOT).cast("string")).alias("attrs"), F.lit(DIRECT).alias("tier"), "seq")
    action = F.when(F.col("irt").isNotNull(), "replied").when(F.col("subject").rlike(r"(?i)^\s*(fwd?|fw)\s*:"), "forwarded").otherwise("sent")
    m = m.withColumn("action", action)
    ts = F.col("date_raw").try_cast("timestamp")
    events = m.select(F.concat_ws(":", F.lit("evt"), F.lit(source), "mid", "action").alias("event_id"), F.col("eid").alias("entity_id"), "action", F.lit(source).alias("source"), F.col("date_raw").alias("ts_raw"), ts.alias("ts"), F.col("date_raw").isNotNull().alias("has_time"), F.when(F.col("from_").isNotNull(), F.concat(F.lit("person:"), "from_")).alias("actor"), F.lit(DIRECT).alias("tier"), "locator", "seq")

    def link(df, target, method, tier, why, rank=None, virtual=False, fallback=False, at=0):
        return df.select(F.col("eid").alias("src"), target.alias("target"), F.lit(method).alias("method"), F.lit(tier).alias("tier"), why.alias("rationale"), F.lit(None).cast("string").alias("materialise"), F.lit(virtual).alias("virtual"), F.lit(rank is not None).alias("anchors"), F.lit(rank).cast("int").alias("anchor_rank"), F.lit(fallback).alias("fallback"), (F.col("seq") * 4 + at).alias("decl_seq"))

    links = link(m.filter("irt is not null"), F.concat(F.lit(f"email:{slug}:"), "irt"), "in-reply-to", JOINED, F.concat(F.lit("In-Reply-To <"), "irt", F.lit(">")))
    links = links.unionByName(link(m.filter("bot"), F.col("eid"), "standalone", DIRECT, F.lit("a notice by a machine is its own run"), 0, at=1))
    links = links.unionByName(link(m.filter("not bot and irt is null"), F.col("eid"), "thread-root", DIRECT, F.lit("the thread starts here"), 3, at=2))
    links = links.unionByName(link(m.filter("not bot and norm <> ''"), F.concat(F.lit(f"thread:{slug}:"), "norm"), "subject-thread", HEURISTIC, F.concat(F.lit("same subject: "), F.left("norm", F.lit(60))), 6, True, True, at=3))
    return shaped(messages.sparkSession, entities.unionByName(persons, allowMissingColumns=True), events, None, links)
