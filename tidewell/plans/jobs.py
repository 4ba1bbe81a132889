"""Composite jobs: geocoding, materialization, ingest, refresh, recompute and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import content_hash, dedupe_hash, geo_query_key
from tidewell.functions.text import clean_text, fold, summary, text_payload
from tidewell.operators import aggregates, classify, dedup, dictionary, filters, geo, merge, places, windows
from tidewell.operators.embed import embed
from tidewell.sources import tables

#: Added to lexical scores, so that any lexical match goes before any cosine.
LEXICAL_FIRST = 2


def geocode(cands: DataFrame, places: DataFrame, cache: DataFrame, id_col: str, now: Column, box, confidence: Column) -> DataFrame:
    """(id, attempt, status, failure_type, lat, lng, confidence, provider) of every attempt: cache, then places."""
    inputs = geo.geocode_inputs(cands, id_col)
    asked = geo.cached_geocodes(inputs, cache, now)
    fresh = asked.filter("hit IS NULL").select("key", "address", "hint").dropDuplicates(["key"])
    best = geo.rank_hits(fresh, places, "key", confidence).select("key", "lat", "lng", "confidence", F.lit("places").alias("found_by"))
    rows = asked.join(best, "key", "left").select(
        id_col, "attempt", "key", F.coalesce("hit.lat", "lat").alias("lat"), F.coalesce("hit.lng", "lng").alias("lng"), F.coalesce("hit.confidence", "confidence").alias("confidence"),
        F.coalesce("provider", "found_by").alias("provider"), F.lit(False).alias("is_district"),
    )
    return geo.geocode_status(rows, box).drop("is_district")


def materialize(
    raw: DataFrame, keywords: DataFrame, order: list[str], gazetteer: DataFrame | None = None, points: DataFrame | None = None, centroids: DataFrame | None = None,
    exemplars: DataFrame | None = None, make_embedder: Callable | None = None, now: Column | None = None, **place_rules,
) -> DataFrame:
    """raw(raw_document_id, title, content, published_at, source_list, dataset_generation) as source records.

    Text is cleaned, hashed and classified by keywords, and with exemplars(category, vector) and an embedder by the
    classifier chain. With gazetteer the best place gives district and location text (place_rules go to
    extract_places()). points(key, pos, lat, lng, importance) are what a geocoder found for the query key of a place; a
    record without one falls back to the centroid of its district, centroids(district, lat, lng), and is approximate.
    Without a place nothing is needed. A missing published_at is now, where that is given.
    """
    rows = raw.select("raw_document_id", "dataset_generation", "published_at", "source_list", clean_text("title").alias("title"), clean_text("content").alias("body"))
    if now is not None:
        rows = rows.withColumn("published_at", F.coalesce("published_at", now))
    rows = rows.withColumn("summary", summary("body")).withColumns({"text_hash": content_hash("title", "body"), "dedupe_hash": dedupe_hash("title", "body", "summary")})
    rows = rows.withColumn("payload", text_payload("title", "summary", "body"))
    short = rows.withColumn("_body", F.left("body", F.lit(1000)))
    matches = dictionary.match_keywords(short, keywords, "raw_document_id", {"title": 3.0, "summary": 2.0, "_body": 1.0})
    by_words = classify.category_scores(matches, "raw_document_id", order).select("raw_document_id", "category", "confidence")
    by_vector = None
    if exemplars is not None and make_embedder is not None:
        vectors = rows.select("raw_document_id", embed(F.nullif("payload", F.lit("")), make_embedder).alias("vector"))
        by_vector = classify.semantic_classify(vectors, exemplars, "raw_document_id", "vector")
    out = rows.join(classify.classify_chain(rows, by_words, by_vector, "raw_document_id", order), "raw_document_id")
    return out if gazetteer is None else located(out, gazetteer, points, centroids, **place_rules)


def located(records: DataFrame, gazetteer: DataFrame, points: DataFrame | None, centroids: DataFrame | None, **place_rules) -> DataFrame:
    """records with district, location_text, lat, lng, geocode_status and geocode_provider, from their payload."""
    found = places.extract_places(records, gazetteer, "raw_document_id", "payload", title="title", **place_rules)
    best = found.groupBy("raw_document_id").agg(F.min_by(F.struct("place", "span"), "rank").alias("b"), F.min_by("district", F.when(F.col("district").isNotNull(), F.col("rank"))).alias("district"))
    rows = records.join(best.select("raw_document_id", F.col("b.place").alias("location_text"), "district"), "raw_document_id", "left")
    rows = rows.withColumn("key", F.when(F.col("location_text").isNotNull(), geo_query_key("location_text", "district")))
    hit = F.max_by(F.struct("lat", "lng"), F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("pos"))).alias("hit")
    hits = points.groupBy("key").agg(hit) if points is not None else None
    rows = rows.join(hits, "key", "left") if hits is not None else rows.withColumn("hit", F.lit(None).cast("struct<lat:double,lng:double>"))
    if centroids is not None:
        rows = rows.join(centroids.select("district", F.struct("lat", "lng").alias("middle")), "district", "left")
    else:
        rows = rows.withColumn("middle", F.lit(None).cast("struct<lat:double,lng:double>"))
    exact, near = F.col("hit").isNotNull(), F.col("middle").isNotNull()
    status = F.when(F.col("location_text").isNull(), "not_needed").when(exact, "resolved").when(near, "approximate").otherwise("failed")
    point = F.coalesce("hit", "middle")
    return rows.withColumns({
        "lat": point["lat"], "lng": point["lng"], "geocode_status": status, "geocode_provider": F.when(status == "resolved", "places").when(status == "approximate", "district_fallback"),
    }).drop("key", "hit", "middle")


def ingest(raw: DataFrame, keywords: DataFrame, order: list[str], make_embedder: Callable | None = None, threshold: float = 0.90, planes: int = 0) -> DataFrame:
    """(record_id, leader, tier): hash duplicates lead to their first record; the rest, in id order, to the best
    earlier leader that matches lexically, else, with make_embedder, to the one with the nearest vector.

    Only first records of a hash reach the dearer tiers. Rows whose embedding fails have no semantic match. planes is
    that of semantic_duplicates: 0 compares all vectors.
    """
    rows = materialize(raw, keywords, order).withColumnRenamed("raw_document_id", "record_id").checkpoint()
    hashed = dedup.hash_duplicates(rows, "dedupe_hash", "record_id").select("record_id", F.col("first_id").alias("leader"))
    firsts = rows.join(hashed.filter("record_id <> leader").select("record_id"), "record_id", "left_anti")
    lexical = dedup.lexical_duplicates(firsts, "record_id", "title", "body", "source_list").select("a", "b", (F.col("combined") + LEXICAL_FIRST).alias("score"))
    pairs = lexical
    if make_embedder is not None:
        vectors = firsts.select("record_id", embed("payload", make_embedder).alias("vector")).checkpoint()
        near = dedup.semantic_duplicates(vectors, "record_id", "vector", threshold, planes)
        both = lexical.unionByName(near.select("a", "b", F.col("similarity").alias("score")))
        pairs = both.groupBy("a", "b").agg(F.max("score").alias("score"))
    pairs = pairs.checkpoint()
    led = dedup.leaders(pairs, firsts, "record_id").select(F.col("id").alias("record_id"), F.col("leader").alias("matched"))
    scores = pairs.select(F.col("b").alias("record_id"), F.col("a").alias("matched"), "score")
    led = led.join(scores, ["record_id", "matched"], "left")
    both = rows.select("record_id").join(hashed, "record_id", "left").join(led, "record_id", "left")
    first_of = led.select(F.col("record_id").alias("leader"), F.col("matched").alias("next"))
    both = both.join(first_of, "leader", "left")
    tier = F.when(F.col("leader") < F.col("record_id"), "hash").when(F.col("score") >= LEXICAL_FIRST, "lexical").when(F.col("score").isNotNull(), "semantic").otherwise("new")
    return both.select("record_id", F.coalesce("next", "matched", "record_id").alias("leader"), tier.alias("tier"))


def ingest_records(stored_: DataFrame, raw: DataFrame, keywords: DataFrame, order: list[str], categories: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """The record table after a batch, and (status, n): each leader of ingest() over stored and new documents is one record
    with its group merged in, in order of canonical rank.

    stored_ and raw have the columns of materialize()'s input. A batch that is written again changes nothing, as a
    document's later row replaces the earlier one.
    """
    both = tables.last_wins(stored_.withColumn("_new", F.lit(0)).unionByName(raw.withColumn("_new", F.lit(1))), ["raw_document_id"], ["_new"])
    led = ingest(both.drop("_new"), keywords, order, **options).checkpoint()
    records = materialize(both.drop("_new"), keywords, order).withColumnRenamed("raw_document_id", "record_id")
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in (("geocode_status", "string"), ("location_text", "string"), ("lat", "double"), ("lng", "double"), ("district", "string"))]
    records = records.select("*", *blank).join(led.select("record_id", "leader"), "record_id")
    merged = merge.merge_groups(windows.canonical_rank(records, "leader"), "leader", "canonical_rank", "record_id", categories)
    status = led.join(both.select(F.col("raw_document_id").alias("record_id"), "_new"), "record_id").filter("_new = 1")
    return merged, status.select(F.when(F.col("tier") == "new", "inserted").otherwise(F.concat(F.lit("merged_"), "tier")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def refresh(new: DataFrame, sessions: DataFrame, root: str, generation: str, allowed_skips: list[str]) -> str | None:
    """Publish a generation unless the gate names a reason, which is returned."""
    reason = aggregates.publish_gate(sessions, allowed_skips).first()["reason"]
    if reason is None:
        tables.publish(new.withColumn("dataset_generation", F.lit(generation)), root, generation)
    return reason


def reclassify(records: DataFrame, keywords: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records with clean text and a new category, and the counted transitions (a dry run writes neither)."""
    rows = records.withColumns({"title": clean_text("title"), "body": clean_text("body"), "old_category": F.col("category")}).drop("category")
    matches = dictionary.match_keywords(rows, keywords, "record_id", {"title": 3.0, "body": 1.0})
    best = classify.category_scores(matches, "record_id", order).select("record_id", "category")
    out = rows.join(best, "record_id", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    return out, aggregates.category_transitions(out.select("old_category", F.col("category").alias("new_category")))


def merge_duplicates(records: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merged records of equal hash, and the counters."""
    ranked = windows.canonical_rank(records)
    return merge.merge_groups(ranked, "dedupe_hash", "canonical_rank", "record_id", categories), merge.merge_report(records, "dedupe_hash")


def recompute(records: DataFrame, raw: DataFrame, sources: DataFrame, mode: str, versions: dict[str, str], again: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows that the mode selects, recomputed by again(), and counts per status; rows without parents are counted."""
    rows = tables.recompute_inputs(records.filter(filters.needs_recompute(mode, versions)), raw, sources)
    done = again(rows.filter("has_raw AND has_source").drop("has_raw", "has_source"))
    missing = rows.filter("NOT (has_raw AND has_source)").agg(F.count("*").alias("n")).select(F.lit("missing_parent").alias("status"), "n")
    return done, aggregates.status_counts(done, "geocode_status").unionByName(missing)


def evaluate(variants: dict[str, DataFrame], labels: DataFrame, id_col: str) -> DataFrame:
    """Confusion per variant of predictions(id, predicted) against labels(id, expected), in one aggregate."""
    out = None
    for name, p in variants.items():
        part = labels.join(p, id_col, "left").select(F.lit(name).alias("variant"), "predicted", "expected")
        out = part if out is None else out.unionByName(part)
    return aggregates.district_confusion(out)


def evaluation_report(variants: dict[str, DataFrame], labels: DataFrame, id_col: str, live: DataFrame | None = None, fields: DataFrame | None = None, pairs: DataFrame | None = None, logical: DataFrame | None = None) -> DataFrame:
    """(subject, measure, value) of all measures whose input is given: confusion per variant, live accuracy, accuracy of
    labelled fields (x and expected_x), of duplicate decisions and of logical places."""
    reports = [(None, evaluate(variants, labels, id_col))]
    reports += [("live", aggregates.live_accuracy(live))] if live is not None else []
    reports += [("fields", aggregates.labelled_accuracy(fields, [c.removeprefix("expected_") for c in fields.columns if c.startswith("expected_")]))] if fields is not None else []
    reports += [("duplicates", aggregates.duplicate_accuracy(pairs))] if pairs is not None else []
    reports += [("logical", aggregates.logical_accuracy(logical))] if logical is not None else []
    out = None
    for name, report in reports:
        measures = [c for c in report.columns if c != "variant"]
        subject = F.col("variant") if name is None else F.lit(name)
        part = report.select(subject.alias("subject"), F.inline(F.array(*[F.struct(F.lit(m.rstrip("_")).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
        out = part if out is None else out.unionByName(part)
    return out


def weak_labels(records: DataFrame, districts: list[str], title: str, source: str, id_col: str, most: int = 10) -> DataFrame:
    """Records whose title names exactly one district, at most `most` per source."""
    t = F.concat(F.lit(" "), F.regexp_replace(fold(title), "[^a-z0-9]+", " "), F.lit(" "))
    named = F.filter(F.array(*[F.when(F.contains(t, F.concat(F.lit(" "), fold(F.lit(d)), F.lit(" "))), F.lit(d)) for d in districts]), lambda x: x.isNotNull())
    rows = records.withColumn("named", named).filter(F.size("named") == 1).withColumn("expected", F.get("named", F.lit(0))).drop("named")
    return windows.cap_per_group(rows, [source], [id_col], most)


def list_records(records: DataFrame, predicate: Column, ts: str, id_col: str, offset: int = 0, limit: int = 20, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """A page of the filtered records, newest first, and the total before paging."""
    rows = records.filter(predicate & filters.is_active())
    return windows.page(rows, ts, id_col, offset, limit, most), rows.agg(F.count("*").alias("total"))


def map_points(records: DataFrame, predicate: Column, ts: str, id_col: str, limit: int = 500) -> DataFrame:
    """The newest records with coordinates; rows without a point drop after the limit, as on the map page."""
    rows = windows.page(records.filter(predicate & filters.is_active()), ts, id_col, 0, limit, 5000)
    return rows.filter("lat IS NOT NULL AND lng IS NOT NULL")


def record_detail(records: DataFrame, record_id, columns: list[str]) -> DataFrame:
    """One visible record with the rows merged into it; no row where it is unknown or itself merged away."""
    mine = records.filter((F.col("record_id") == record_id) | (F.col("duplicate_of_record_id") == record_id))
    return tables.with_related(mine, columns).filter(F.col("record_id") == record_id)


def bootstrap(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Empty tables where any of them has rows, so that a load starts clean; empty ones are returned as they are."""
    return {name: df if df.isEmpty() else df.limit(0) for name, df in frames.items()}
