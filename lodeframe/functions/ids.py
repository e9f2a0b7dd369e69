"""Column helpers for being ids and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the id that refers to nothing.
NIL_ID = "0" * 36
BLANKS = " \t\r\n\f\v\u00a0"


def norm_id(c: Column | str) -> Column:
    """An id without blanks around it, without hyphens and in lower case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.translate(F.btrim(c, F.lit(BLANKS)), "-", ""))


def ref_id(c: Column | str) -> Column:
    """norm_id, but null where the id refers to nothing (null, empty, blank or nil)."""
    return F.nullif(F.nullif(norm_id(c), F.lit("")), F.lit(NIL_ID))


def refers(c: Column | str) -> Column:
    """Whether an id refers to something. Nearly every id shows that by its first digits, before its form is computed."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c.rlike(r"[^\s\u00a00-]") | ref_id(c).isNotNull())


def referred_id(c: Column | str) -> Column:
    """norm_id of an id that refers to something; never null, so that no join or grouping tests it for null again."""
    return F.coalesce(norm_id(c), F.lit(""))


def month_of_ns(c: Column) -> Column:
    """Months since year 0 of a time in nanoseconds since 1970 (UTC); null stays null."""
    day = F.lit(86_400_000_000_000)
    date = F.date_from_unix_date(F.call_function("div", c - F.pmod(c, day), day).cast("int"))
    return F.year(date) * 12 + F.month(date) - 1


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * F.lit(1_000_000).cast("long") + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def id_created_ms(c: Column | str) -> Column:
    """Milliseconds held in the first 48 bits of the uuid that follows the four digits of the shard."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(norm_id(c), 5, 12), 16, 10).cast("long")


def time_bucket_ms(ns: Column) -> Column:
    """Start, in milliseconds, of the one-second bucket that holds a time in nanoseconds."""
    return F.floor(F.floor(ns / F.lit(1_000_000)) / F.lit(1000)).cast("long") * 1000


def cut_bytes(c: Column | str, capacity: int) -> Column:
    """A string cut to capacity - 1 bytes, a split character at the end being replaced."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c.cast("binary"), 1, capacity - 1).cast("string")
