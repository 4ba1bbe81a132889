"""Date parsing; what cannot be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import as_column

#: Month names with their plain spellings.
MONTHS = {
    "ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8,
    "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12,
}


def parse_iso(c) -> Column:
    """ISO 8601; without an offset it is UTC (the session time zone of this library)."""
    c = F.trim(as_column(c))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))


def parse_local_date(c, zone: str = "Europe/Istanbul", months: dict[str, int] = MONTHS) -> Column:
    """`d month yyyy [hh:mm]` in a zone, as an instant; an impossible day is null."""
    text = F.lower(F.regexp_replace(as_column(c), "İ", "i"))
    pattern = r"(?U)(\d{1,2})\s+(\p{L}+)\s+(\d{4})(?:\s+(\d{1,2}):(\d{2}))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    as_int = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).try_cast("int")
    return F.try_make_timestamp(as_int(3), number[part(2)], as_int(1), as_int(4), as_int(5), F.lit(0).cast("decimal(16,6)"), F.lit(zone))


def parse_published(c) -> Column:
    return F.coalesce(parse_iso(c), parse_local_date(c))


def published_or_fallback(published_raw, scraped_at, now) -> Column:
    return F.coalesce(parse_published(published_raw), as_column(scraped_at), as_column(now))


def date_range(start, end, now, days: int = 3) -> tuple[Column, Column]:
    """Both ends in order; a missing range is the last days."""
    a = F.coalesce(as_column(start), as_column(now) - F.expr(f"INTERVAL {days} DAYS"))
    b = F.coalesce(as_column(end), as_column(now))
    return F.least(a, b), F.greatest(a, b)
