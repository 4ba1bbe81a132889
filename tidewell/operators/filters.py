"""Predicates of the read API and of the recompute jobs, as Columns to be conjoined."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import host
from tidewell.functions.scores import any_of
from tidewell.functions.text import as_column, fold, normalize_token


def split_values(values: list[str]) -> list[str]:
    """Comma-separated parts, trimmed, without repeats that differ in case only, in order."""
    out: dict[str, str] = {}
    for part in (p.strip() for v in values for p in v.split(",")):
        if part:
            out.setdefault(part.casefold(), part)
    return list(out.values())


def by_source(source: str, column: str = "source_list") -> Column:
    name = source.split("://", 1)[-1].split("/", 1)[0].lower()
    return F.array_contains(F.transform(column, lambda x: F.lower(x)), name)


def by_values(column: str, values: list[str], allowed: list[str], aliases: dict[str, str] | None = None) -> Column:
    """column in the given values after alias lookup; an unknown value raises ValueError."""
    known = {v.casefold(): v for v in allowed} | {k.casefold(): v for k, v in (aliases or {}).items()}
    wanted = []
    for v in split_values(values):
        if v.casefold() not in known:
            raise ValueError(f"unknown value of {column}: {v}")
        wanted.append(known[v.casefold()])
    return F.col(column).isin(list(dict.fromkeys(wanted)))


def by_date(column: str, start=None, end=None) -> Column:
    """Both ends included; a missing end is open."""
    parts = [F.col(column) >= F.lit(start).cast("timestamp")] if start is not None else []
    parts += [F.col(column) <= F.lit(end).cast("timestamp")] if end is not None else []
    return merge_filters(parts)


def merge_filters(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def search_terms(query: str) -> tuple[list[str], list[str], list[str]]:
    """Words, phrases and excluded words of a query such as: fire "main street" -sports."""
    import re

    phrases = [p.lower() for p in re.findall(r'"([^"]+)"', query)]
    rest = re.sub(r'"[^"]*"', " ", query).lower().split()
    clean = lambda w: re.sub(r"[^\w]", "", w)
    return [clean(w) for w in rest if not w.startswith("-") and clean(w)], phrases, [clean(w) for w in rest if w.startswith("-") and clean(w)]


def text_search(query: str, weights: dict[str, int]) -> tuple[Column, Column]:
    """(predicate, score) over several text columns: any word, all phrases, no excluded word; score sums weights."""
    terms, phrases, excluded = search_terms(query)
    lower = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in weights}
    tokens = {c: F.split(t, r"[^\p{L}\p{N}_]+") for c, t in lower.items()}
    has = lambda words: reduce(lambda a, b: a | b, [F.arrays_overlap(t, F.array(*[F.lit(w) for w in words])) for t in tokens.values()])
    keep = has(terms) if terms else F.lit(bool(phrases))
    for p in phrases:
        keep = keep & reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for t in lower.values()])
    if excluded:
        keep = keep & ~has(excluded)
    score = sum((weight * F.array_contains(tokens[c], w).cast("int") for c, weight in weights.items() for w in terms), F.lit(0))
    return keep, score


def has_valid_point(point="location") -> Column:
    p = as_column(point)
    return F.coalesce((p["type"] == "Point") & (F.size(p["coordinates"]) == 2) & ~F.exists(p["coordinates"], lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def is_active(column="record_status") -> Column:
    return ~as_column(column).eqNullSafe(F.lit("merged_duplicate"))


def visible(active: str | None, pending: str | None, column: str = "dataset_generation") -> Column:
    """Rows of the active generation; before the first one, rows without a generation; with no state, all."""
    if active:
        return F.col(column) == active
    return F.col(column).isNull() if pending else F.lit(True)


def within_lookback(column: str, now: Column, days: int) -> Column:
    """Not older than days; an unknown date passes."""
    return F.col(column).isNull() | (F.col(column) >= now - F.expr(f"INTERVAL {days} DAYS"))


def within_last_n_days(column: str, now: Column, n: int) -> Column:
    """In the last n days, n from 1 to 3; an unknown date fails."""
    n = min(max(n, 1), 3)
    return F.coalesce(F.col(column).between(now - F.expr(f"INTERVAL {n} DAYS"), now), F.lit(False))


def in_bbox(lat: str, lng: str, box: tuple[float, float, float, float]) -> Column:
    """box is (south, north, west, east); an unknown point fails."""
    south, north, west, east = box
    return F.coalesce(F.col(lat).between(south, north) & F.col(lng).between(west, east), F.lit(False))


def needs_recompute(mode: str, versions: dict[str, str]) -> Column:
    """Rows that a recompute of that mode selects. Absent equals null everywhere."""
    if mode == "stale-version":
        return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in versions.items()])
    if mode == "district-fallback":
        return F.col("geocode_provider").eqNullSafe(F.lit("district_fallback"))
    if mode == "missing-point":
        return F.col("lat").isNull() | F.col("lng").isNull()
    if mode == "approximate-without-district":
        return F.col("geocode_status").eqNullSafe(F.lit("approximate")) & F.col("district_predicted").isNull()
    if mode == "all":
        return F.lit(True)
    raise ValueError(f"unknown mode {mode}")


def dup_candidates(a: str, b: str, disjoint_sources: bool) -> Column:
    """Join condition of duplicate candidates: same generation, another document, active, perhaps other sources."""
    on = F.col(f"{a}.dataset_generation").eqNullSafe(F.col(f"{b}.dataset_generation")) & (F.col(f"{a}.raw_document_id") != F.col(f"{b}.raw_document_id")) & is_active(f"{b}.record_status")
    return on & ~F.arrays_overlap(f"{a}.source_list", f"{b}.source_list") if disjoint_sources else on


def is_precise_place(c, hints: list[str]) -> Column:
    return fold(c).rlike(any_of(hints))


def is_generic_place(c, generic: list[str], precise: list[str], neighborhood=None, district=None) -> Column:
    """Names of clubs, authorities and the like, unless precise or backed by a neighborhood or district."""
    backed = F.lit(False)
    for x in (neighborhood, district):
        if x is not None:
            backed = backed | (F.coalesce(F.trim(as_column(x)), F.lit("")) != "")
    return F.coalesce(fold(c).rlike(r"\b(?:" + any_of(generic) + r")\b") & ~is_precise_place(c, precise) & ~backed, F.lit(False))


def is_district_level(address, district, hint) -> Column:
    a = fold(address)
    return F.coalesce(a == fold(district), F.lit(False)) | F.coalesce(a == fold(hint), F.lit(False))


def is_malformed_neighborhood(c, suffix_words: list[str]) -> Column:
    text = F.coalesce(fold(c), F.lit(""))
    return (text == "") | F.split(text, " ")[0].isin(suffix_words)


def story_rules(c, rules: dict[str, str]) -> dict[str, Column]:
    """A flag per topic; rules are patterns over the folded text."""
    return {f"is_{name}": F.coalesce(fold(c).rlike(pattern), F.lit(False)) for name, pattern in rules.items()}


def is_location_label(c, labels=("ORG", "FAC", "GPE", "LOC", "LOCATION", "PLACE", "ADDRESS", "DISTRICT", "NEIGHBORHOOD")) -> Column:
    return F.upper(F.regexp_replace(as_column(c), "^[BI]-", "")).isin(list(labels))


def known_sources(df: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose source is active, and the others. The sources side is small, but Spark decides how to join."""
    active = sources.filter("active").select(F.lower("domain").alias("_domain"))
    keyed = df.withColumn("_domain", host(F.col("source")))
    return keyed.join(active, "_domain", "left_semi").drop("_domain"), keyed.join(active, "_domain", "left_anti").drop("_domain")


def normalized_in(column: str, values: list[str]) -> Column:
    return normalize_token(column).isin([v for v in values])
