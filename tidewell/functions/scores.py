"""Ranks, confidences and vector arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import as_column, fold

#: Rank of geocode states; words that make a place precise.
GEOCODE_RANK = {"resolved": 4, "approximate": 3, "pending": 2, "failed": 1, "not_needed": 0}
PRECISE_HINTS = "mahallesi mahalle sokak cadde caddesi bulvar blv meydani kavsagi otoyolu".split()


def rank_of(c, ranks: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(table[as_column(c)], F.lit(default))


def geocode_rank(c) -> Column:
    return rank_of(c, GEOCODE_RANK, -1)


def category_priority(c, order: list[str]) -> Column:
    """Place of a category in a list, 1 first; others 99."""
    return rank_of(c, {k: i for i, k in enumerate(order, 1)}, 99)


def any_of(words: list[str]) -> str:
    """A pattern of any of the words as they stand; without words it matches nothing."""
    return "|".join(re.escape(w) for w in words) or "(?!)"


def any_hint(c, hints: list[str]) -> Column:
    """Whether the folded text contains any of the hints."""
    return fold(c).rlike(any_of(hints))


def place_specificity(c, hints: list[str] = PRECISE_HINTS) -> Column:
    """Number of tokens up to 8, 10 more for a precise word, 1 more for a comma; empty is -1."""
    text = fold(c)
    score = F.least(F.size(F.split(text, " ")), F.lit(8)) + F.when(text.rlike(any_of(hints)), 10).otherwise(0) + F.when(F.contains(as_column(c), F.lit(",")), 1).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", -1).otherwise(score)


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 for a zero vector, null for different lengths."""
    a, b = as_column(a), as_column(b)
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), add)
    size = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), add))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot, size(a) * size(b)), F.lit(0.0)))


def valid_vector(v, dim: int) -> Column:
    v = as_column(v)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def hit_confidence(blob, address, hint, district, kind, address_type, importance, region_hints, precise_hints, precise_types, admin_types) -> Column:
    """Additive score of a geocoder hit in 0..1, 3 decimals. blob is the folded text of the hit."""
    blob, addr, hint_f = as_column(blob), fold(address), F.nullif(fold(hint), F.lit(""))
    tokens = F.filter(F.regexp_extract_all(addr, F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 2) & ~t.isin(list(region_hints)))
    share = F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: F.contains(blob, t))), F.size(tokens)), F.lit(0.0))
    types = [fold(kind), fold(address_type)]
    is_in = lambda names: F.coalesce(types[0].isin(list(names)), F.lit(False)) | F.coalesce(types[1].isin(list(names)), F.lit(False))
    precise = addr.rlike(any_of(precise_hints))
    score = F.when((addr != "") & F.contains(blob, addr), 0.42).otherwise(0.0) + 0.33 * share
    score += F.when(hint_f.isNull(), 0.0).when((fold(district) == hint_f) | F.contains(blob, hint_f), 0.22).otherwise(-0.14)
    score += F.when(blob.rlike(any_of(region_hints)), 0.15).otherwise(-0.08)
    admin = is_in(admin_types)
    score += F.when(precise, F.when(is_in(precise_types), 0.14).otherwise(0.0) - F.when(admin, 0.30).otherwise(0.0)).otherwise(F.when(admin, 0.08).otherwise(0.0))
    score += 0.08 * F.least(F.greatest(F.coalesce(as_column(importance).try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def keyword_confidence(n) -> Column:
    return F.round(F.least(F.lit(0.92), 0.45 + 0.10 * (as_column(n) - 1)), 4)


def marker_radius(confidence) -> Column:
    c = F.coalesce(as_column(confidence), F.lit(0.5))
    c = F.when(c > 1, c / 100).otherwise(c)
    return 8 + F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 10


def event_tone(event, status) -> Column:
    """First fitting severity of an event."""
    e, s = F.lower(as_column(event)), F.lower(F.coalesce(as_column(status), F.lit("")))
    return (
        F.when(s.isin("failed", "error") | e.rlike("fail|error"), "error")
        .when(s.isin("cancelled") | e.rlike("cancel|skip|retry|warn"), "warning")
        .when(s.isin("completed", "success") | e.rlike("complete|success|finish"), "success")
        .otherwise("info")
    )


def error_class(message) -> Column:
    m = F.lower(as_column(message))
    return F.when(F.contains(m, F.lit("document failed validation")), "validation").when(F.contains(m, F.lit("duplicate key")), "duplicate_key").when(m.isNull(), None).otherwise("other")


def event_details(c) -> Column:
    """JSON text as a map of strings; what does not parse is an empty map."""
    return F.coalesce(F.from_json(as_column(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
