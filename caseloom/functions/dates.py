"""Dates as sources write them, to timestamps; what cannot be read is null. Day comes before month where either could."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATES = (r"yyyy-M-d", r"d/M/yyyy", r"M/d/yyyy", r"d-MMM-yyyy", r"d MMM yyyy", r"MMM d, yyyy", r"yyyy/M/d")
TIMES = ("H:mm:ss", "H:mm")


def parse_date(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATES], iso(s)).cast("date")


def iso(c: Column) -> Column:
    """ISO 8601, naive values as UTC."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))


def parse_timestamp(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    timed = [F.try_to_timestamp(s, F.lit(f"{d} {t}")) for d in DATES[:3] + DATES[6:] for t in TIMES]
    return F.coalesce(iso(s), *timed, parse_date(s).cast("timestamp"))


def has_time(c: Column) -> Column:
    """Whether the text has a time of day: a bare date has none."""
    return F.coalesce(F.trim(c.cast("string")).rlike(r"\d[T ]+\d{1,2}:"), F.lit(False))


def mail_date(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\s*\([^)]*\)\s*$", ""), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss")))


def session_time(c: Column) -> Column:
    """The first 19 characters, an offset dropped: the reading that session splits use."""
    return F.left(c.cast("string"), F.lit(19)).try_cast("timestamp")
