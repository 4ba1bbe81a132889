"""Registered queries of predicates, scores, joins and evaluations over the given tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import dates, keys, scores, text
from tidewell.operators import aggregates, classify, dictionary, filters, geo, sets, windows
from tidewell.plans.registry import FOLD_SQL, now, query
from tidewell.sources import tables

# ---- predicates of the read API


@query("SELECT doc_id FROM documents WHERE lower(source) = 'src3'")
def by_source(t):
    return t.documents.withColumn("source_list", F.array("source")).filter(filters.by_source("https://SRC3/start")).select("doc_id")


@query("""SELECT count(*) FILTER (g = 'F') AS active_generation, count(*) FILTER (g IS NULL) AS before_the_first, count(*) AS without_state
  FROM (SELECT nullif(o_orderstatus, 'P') AS g FROM orders)""")
def visible(t):
    rows = t.orders.withColumn("dataset_generation", F.nullif("o_orderstatus", F.lit("P")))
    modes = {"active_generation": filters.visible("F", "O"), "before_the_first": filters.visible(None, "O"), "without_state": filters.visible(None, None)}
    return rows.agg(*[F.count_if(c).alias(n) for n, c in modes.items()])


@query("""SELECT event_id, ts IS NULL OR ts >= TIMESTAMP '2024-01-21' AS looked_back, coalesce(ts BETWEEN TIMESTAMP '2024-01-28' AND TIMESTAMP '2024-01-31', false) AS recent
  FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events)""")
def date_windows(t):
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return rows.select("event_id", filters.within_lookback("ts", now(), 10).alias("looked_back"), filters.within_last_n_days("ts", now(), 7).alias("recent"))


POINT_CASES = "CASE event_type WHEN 'view' THEN 'Line' WHEN 'signup' THEN NULL ELSE 'Point' END"


@query(f"""SELECT count(*) FILTER ({POINT_CASES} = 'Point' AND event_type <> 'click' AND value IS NOT NULL AND NOT isnan(value)) AS geocoded FROM events""")
def geocoded_total(t):
    coordinates = F.when(F.col("event_type") == "click", F.array("value")).otherwise(F.array("value", F.col("user_id").cast("double")))
    rows = t.events.select(F.struct(F.expr(POINT_CASES).alias("type"), coordinates.alias("coordinates")).alias("location"))
    return aggregates.geocoded_total(rows, filters.has_valid_point())


@query("SELECT c_custkey FROM customer WHERE c_acctbal / 100 BETWEEN 10 AND 60 AND c_nationkey BETWEEN 3 AND 17")
def in_bbox(t):
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("lat"), F.col("c_nationkey").cast("double").alias("lng"))
    return rows.filter(filters.in_bbox("lat", "lng", (10.0, 60.0, 3.0, 17.0))).select("c_custkey")


@query("""SELECT count(*) FILTER (v1 IS DISTINCT FROM 'F' OR v2 IS DISTINCT FROM '1-URGENT') AS stale_version, count(*) FILTER (v2 = '2-HIGH') AS district_fallback,
  count(*) FILTER (o_totalprice > 150000) AS missing_point, count(*) FILTER (v1 = 'F' AND v2 IS NULL) AS approximate_without_district, count(*) AS everything
  FROM (SELECT *, nullif(o_orderstatus, 'P') AS v1, nullif(o_orderpriority, '5-LOW') AS v2 FROM orders)""")
def needs_recompute(t):
    v1, v2 = F.nullif("o_orderstatus", F.lit("P")), F.nullif("o_orderpriority", F.lit("5-LOW"))
    rows = t.orders.select(v1.alias("v1"), v2.alias("v2"), F.when(v2 == "2-HIGH", "district_fallback").alias("geocode_provider"), F.when(F.col("o_totalprice") <= 150000, 1.0).alias("lat"), F.lit(2.0).alias("lng"), F.when(v1 == "F", "approximate").alias("geocode_status"), v2.alias("district_predicted"))
    versions = {"v1": "F", "v2": "1-URGENT"}
    modes = {"stale_version": "stale-version", "district_fallback": "district-fallback", "missing_point": "missing-point", "approximate_without_district": "approximate-without-district", "everything": "all"}
    return rows.agg(*[F.count_if(filters.needs_recompute(mode, versions)).alias(n) for n, mode in modes.items()])


@query("""SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id <> b.doc_id AND b.doc_id % 7 <> 0
  AND a.source <> b.source""")
def dup_candidates(t):
    rows = t.documents.select(F.col("doc_id").alias("raw_document_id"), F.col("lang").alias("dataset_generation"), F.array("source").alias("source_list"), F.when(F.col("doc_id") % 7 == 0, "merged_duplicate").alias("record_status"), "text")
    on = (F.col("a.text") == F.col("b.text")) & filters.dup_candidates("a", "b", True)
    return rows.alias("a").join(rows.alias("b"), on).select(F.col("a.raw_document_id").alias("a"), F.col("b.raw_document_id").alias("b"))


@query("""SELECT o_orderkey, contains(f, 'urgent') AS precise_place, regexp_matches(f, '\\b(specified|medium)\\b') AND NOT contains(f, 'urgent') AND o_orderstatus <> 'F' AS generic,
  f IN ('1 urgent', '2 high') AS district_level, split_part(f, ' ', 1) IN ('4', '5') AS malformed
  FROM (SELECT o_orderkey, o_orderstatus, lower(replace(o_orderpriority, '-', ' ')) AS f FROM orders)""")
def place_rules(t):
    p = F.col("o_orderpriority")
    generic = filters.is_generic_place(p, ["specified", "medium"], ["urgent"], neighborhood=F.when(F.col("o_orderstatus") == "F", "x").otherwise(" "))
    level = filters.is_district_level(p, F.lit("1 URGENT"), F.lit("2-high"))
    return t.orders.select("o_orderkey", filters.is_precise_place(p, ["urgent"]).alias("precise_place"), generic.alias("generic"), level.alias("district_level"), filters.is_malformed_neighborhood(p, ["4", "5"]).alias("malformed"))


@query("SELECT o_orderkey, contains(o_orderpriority, 'HIGH') OR contains(o_orderpriority, 'URGENT') AS is_pressing, starts_with(o_orderpriority, '5') AS is_low FROM orders")
def story_rules(t):
    flags = filters.story_rules("o_orderpriority", {"pressing": "high|urgent", "low": "^5 low$"})
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in flags.items()])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type")
def location_labels(t):
    label = F.expr("CASE event_type WHEN 'view' THEN 'B-loc' WHEN 'click' THEN 'I-ORG' WHEN 'error' THEN 'PER' ELSE 'B-MISC' END")
    return t.events.filter(filters.is_location_label(label)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(substr(source, 4) AS INTEGER) % 2 = 1 AS known FROM documents WHERE source IS NOT NULL")
def known_sources(t):
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example/x"))
    sources = t.documents.filter("source IS NOT NULL").select("source").distinct()
    sources = sources.select(F.concat(F.upper("source"), F.lit(".example")).alias("domain"), (F.substr("source", F.lit(4)).cast("int") % 2 == 1).alias("active"))
    known, rest = filters.known_sources(t.documents.filter("source IS NOT NULL").select("doc_id", site.alias("source")), sources)
    return known.select("doc_id", F.lit(True).alias("known")).unionByName(rest.select("doc_id", F.lit(False).alias("known")))


# ---- geography


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
  SELECT o_custkey AS key, o_orderkey AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, coalesce(nullif(o_totalprice % 7, 0), 0) DESC, pos) AS r FROM p WHERE pos <= 5) WHERE r = 1""")
def rank_hits(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    places = t.orders.select(F.col("o_custkey").alias("key"), F.row_number().over(w).alias("pos"), F.nullif(F.col("o_totalprice") % 7, F.lit(0.0)).alias("importance"), "o_totalprice", F.col("o_orderkey").alias("place"))
    out = geo.rank_hits(t.customer.select(F.col("c_custkey").alias("key")), places, "key", F.floor(F.col("o_totalprice") / 50000))
    return out.select("key", "place")


@query("""WITH c AS (SELECT o_custkey, max(o_totalprice) AS best FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' GROUP BY o_custkey)
  SELECT c_custkey AS key, CASE WHEN best IS NOT NULL THEN 'cache' END AS provider, best AS confidence FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def cached_geocodes(t):
    cache = t.orders.select(F.col("o_custkey").alias("normalized_query"), F.col("o_orderdate").alias("expires_at"), F.col("o_orderstatus").alias("status"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("district"))
    out = geo.cached_geocodes(t.customer.select(F.col("c_custkey").alias("key")), cache, F.lit("1995-06-01").cast("timestamp"))
    return out.select("key", "provider", "hit.confidence")


@query("SELECT 'dropped' AS what, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' UNION ALL SELECT 'kept', count(*) FROM orders WHERE coalesce(o_orderpriority NOT LIKE '1-%', true)")
def invalidate_cache(t):
    kept, dropped = geo.invalidate_cache(t.orders.withColumn("provider_version", F.col("o_orderpriority")), "1-")
    return dropped.select(F.lit("dropped").alias("what"), F.col("dropped").alias("n")).unionByName(kept.agg(F.lit("kept").alias("what"), F.count("*").alias("n")))


@query("WITH c AS (SELECT o_orderpriority AS d, min(o_totalprice) AS lat FROM orders WHERE o_orderpriority < '4' GROUP BY 1) SELECT o_orderkey, lat FROM orders LEFT JOIN c ON d = o_orderpriority")
def district_centroid(t):
    centroids = t.orders.filter("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("district")).agg(F.min("o_totalprice").alias("lat"), F.lit(0.0).alias("lng"))
    return geo.district_centroid(t.orders.withColumn("district", F.col("o_orderpriority")), centroids).select("o_orderkey", "lat")


@query("""WITH c AS (SELECT o_custkey AS id, o_orderpriority AS a, o_orderstatus AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
  k AS (SELECT id, lower(replace(a, '-', ' ')) || '|' || lower(h) AS key, min(pos) AS pos FROM c WHERE pos <= 8 GROUP BY 1, 2)
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS attempt, key FROM k""")
def geocode_inputs(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    cands = t.orders.select(F.col("o_custkey").alias("id"), F.row_number().over(w).alias("pos"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("neighborhood"), F.col("o_orderstatus").alias("district"))
    return geo.geocode_inputs(cands, "id").select("id", "attempt", "key")


@query("""SELECT o_orderkey, CASE WHEN contains(f, 'urgent') THEN 'fast' WHEN starts_with(f, '4') THEN 'none' END AS strategy, CASE WHEN contains(f, 'urgent') THEN 'gate' ELSE 'yard' END AS place
  FROM (SELECT o_orderkey, lower(replace(o_orderpriority, '-', ' ')) AS f FROM orders) WHERE contains(f, 'urgent') OR starts_with(f, '4')""")
def logical_places(t):
    rules = t.spark.createDataFrame([(2, "none", "^4 ", "yard"), (1, "fast", "urgent", "gate")], "priority int, strategy string, pattern string, place string")
    return geo.logical_places(t.orders, "o_orderkey", "o_orderpriority", rules)


@query("SELECT o_orderkey, lower(replace(o_orderpriority, '-', ' ')) || CASE WHEN o_orderstatus <> 'P' THEN '|' || lower(o_orderstatus) ELSE '' END AS key FROM orders")
def geo_query_key(t):
    return t.orders.select("o_orderkey", keys.geo_query_key("o_orderpriority", F.nullif("o_orderstatus", F.lit("P"))).alias("key"))


# ---- evaluations and states


@query("""SELECT CASE WHEN count(*) FILTER (skip IS NULL) > 0 AND count(*) FILTER (status = 'success') = count(*) FILTER (skip IS NULL) THEN 'success'
    WHEN count(*) FILTER (status IN ('success', 'partial')) > 0 THEN 'completed_with_errors' ELSE 'failed' END AS status,
  count(*) FILTER (skip IS NOT NULL) AS skipped, string_agg(DISTINCT skip, ',' ORDER BY skip) AS skip_reasons
  FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status, CASE event_type WHEN 'signup' THEN 'inactive' WHEN 'click' THEN 'late' END AS skip FROM events)""")
def run_status(t):
    rows = t.events.select(F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END").alias("status"), F.expr("CASE event_type WHEN 'signup' THEN 'inactive' WHEN 'click' THEN 'late' END").alias("skip_reason"))
    return aggregates.run_status(rows).withColumn("skip_reasons", F.array_join("skip_reasons", ","))


@query("""WITH p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN [o_orderpriority, o_orderstatus] WHEN o_orderkey % 3 = 1 THEN [o_orderstatus, o_orderpriority] ELSE [o_orderstatus] END AS predicted, [o_orderpriority, o_orderstatus] AS expected FROM orders)
  SELECT count(*) AS total, round(count(*) FILTER (predicted = expected) / count(*), 4) AS exact_share, round(count(*) FILTER (predicted[1] IS NOT DISTINCT FROM expected[1]) / count(*), 4) AS primary_share,
  round(count(*) FILTER (list_contains(predicted, expected[1])) / count(*), 4) AS contains_share FROM p""")
def live_accuracy(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    predicted = F.when(F.col("o_orderkey") % 3 == 0, F.array(p, s)).when(F.col("o_orderkey") % 3 == 1, F.array(s, p)).otherwise(F.array(s))
    out = aggregates.live_accuracy(t.orders.select(predicted.alias("predicted"), F.array(p, s).alias("expected")))
    return out.select("total", *[F.round(a, 6).alias(b) for a, b in (("exact", "exact_share"), ("primary_", "primary_share"), ("contains_", "contains_share"))])


@query("""SELECT round(count(*) FILTER ((o_totalprice > 100000) = (o_orderstatus = 'F')) / count(*), 4) AS accuracy, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus <> 'F') AS false_positive,
  count(*) FILTER (o_totalprice <= 100000 AND o_orderstatus = 'F') AS false_negative FROM orders""")
def duplicate_accuracy(t):
    rows = t.orders.select((F.col("o_totalprice") > 100000).alias("is_duplicate"), (F.col("o_orderstatus") == "F").alias("expected"))
    return aggregates.duplicate_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(t):
    return aggregates.status_counts(t.orders, "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def candidate_order(t):
    return windows.candidate_order(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first_scan(t):
    return windows.top_k(t.orders, [F.desc("o_orderdate"), "o_orderkey"], 50).select("o_orderkey")


@query("SELECT o_custkey AS doc, arg_max(o_orderpriority, floor(o_totalprice / 100000) * 10 - CAST(left(o_orderpriority, 1) AS INTEGER)) AS category FROM orders GROUP BY o_custkey")
def top_category(t):
    rows = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("category"), F.floor(F.col("o_totalprice") / 100000).alias("score"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))
    return windows.top_category(rows, "doc")


# ---- sets of candidates


@query("""WITH u AS (SELECT 0 AS part, o_orderkey AS pos, o_custkey AS doc, o_orderstatus AS name, floor(o_totalprice / 1000) AS score FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderstatus, floor(o_totalprice / 1000) FROM orders WHERE o_orderkey % 3 = 0)
  SELECT doc, name, CAST(min(part) AS INTEGER) AS part, arg_min(pos, part * 1000000000 + pos) AS pos, CAST(max(score) AS BIGINT) AS score FROM u GROUP BY doc, name""")
def union_candidates(t):
    rows = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 1000).alias("score"))
    return sets.union_candidates([rows.filter("pos % 2 = 0"), rows.filter("pos % 3 = 0")], ["doc", "name"]).select("doc", "name", "part", "pos", "score")


@query("""WITH c AS (SELECT o_orderkey, o_custkey AS doc, o_orderstatus AS name, o_orderpriority AS district, o_totalprice > 150000 AS explicit FROM orders),
  g AS (SELECT doc, name, count(DISTINCT district) AS kinds, bool_or(explicit) AS named FROM c GROUP BY doc, name)
  SELECT o_orderkey FROM c JOIN g USING (doc, name) WHERE kinds <= 1 OR NOT named OR explicit""")
def suppress_ambiguous(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("district"), (F.col("o_totalprice") > 150000).alias("explicit"))
    return sets.suppress_ambiguous(rows).select("o_orderkey")


PRECEDENCE = [("1-URGENT", "5-LOW"), ("2-HIGH", "4-NOT SPECIFIED")]


@query("""WITH r(preferred, shadowed) AS (VALUES ('1-URGENT', '5-LOW'), ('2-HIGH', '4-NOT SPECIFIED'))
  SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM r JOIN orders b ON b.o_orderpriority = preferred WHERE shadowed = a.o_orderpriority AND b.o_custkey = a.o_custkey)""")
def apply_precedence(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("district"), F.when(F.col("o_orderstatus") == "P", "here").alias("neighborhood"))
    return sets.apply_precedence(rows, t.spark.createDataFrame(PRECEDENCE, "preferred string, shadowed string")).select("o_orderkey")


@query("""WITH a AS (SELECT text, doc_id, min(doc_id) OVER (PARTITION BY text) AS record_id, source FROM documents WHERE source IS NOT NULL),
  f AS (SELECT record_id, source, min(CASE WHEN doc_id = record_id THEN 0 ELSE 1 END) AS late FROM a GROUP BY 1, 2)
  SELECT record_id, string_agg(source || '.example', ',' ORDER BY late, source || '.example') AS sites FROM f GROUP BY record_id""")
def source_sites(t):
    site = F.concat(F.lit("http://"), F.col("source"), F.lit(".example/a?b"))
    rows = t.documents.filter("source IS NOT NULL").select("text", "doc_id", site.alias("source_url"))
    first = rows.groupBy("text").agg(F.min("doc_id").alias("record_id"))
    rows = rows.join(first, rows["text"].eqNullSafe(first["text"])).select("record_id", "doc_id", "source_url")
    own = rows.filter("doc_id = record_id").select("record_id", "source_url", F.array(F.lit("")).alias("source_list"))
    return sets.source_sites(own, rows.filter("doc_id <> record_id").select("record_id", "source_url")).withColumn("sites", F.array_join("sites", ","))


@query("""SELECT o_orderkey AS record_id, CAST(o_orderkey % 2 = 0 AS INTEGER) AS fresh FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F'""")
def replace_generation(t):
    old = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("dataset_generation"), F.lit(0).alias("fresh"))
    new = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("record_id"), F.lit(1).alias("fresh"))
    return sets.replace_generation(old, new, "F").select("record_id", "fresh")


# ---- dictionaries and categories

ALIASES = [("north", "the", 2), ("north", "of the", 3), ("south", "und", 1), ("west", "que la", 1)]
WORDS_SQL = "list_filter(string_split_regex(" + FOLD_SQL.format("text") + ", '[^a-z0-9\\p{L}]+'), lambda x: x <> '')"


@query(f"""WITH a(venue, alias, priority) AS (VALUES {", ".join(f"('{v}', '{a}', {p})" for v, a, p in ALIASES)}), d AS (SELECT doc_id, ' ' || array_to_string({WORDS_SQL}, ' ') || ' ' AS s FROM documents)
  SELECT doc_id, arg_min(venue, priority * 10 + CASE venue WHEN 'north' THEN 0 WHEN 'south' THEN 1 ELSE 2 END) AS venue FROM d, a WHERE contains(s, ' ' || alias || ' ') GROUP BY doc_id""")
def match_named_venue(t):
    venues = t.spark.createDataFrame(ALIASES, "venue string, alias string, priority int")
    return dictionary.match_named_venue(t.documents, venues, "doc_id", "text")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'hall' WHEN 'de' THEN 'Halle' ELSE 'none' END AS venue FROM documents")
def district_venue(t):
    mapping = t.spark.createDataFrame([("en", "hall"), ("de", "Halle")], "district string, venue string")
    return dictionary.district_venue(t.documents.withColumn("district", F.col("lang")), mapping, "none").select("doc_id", "venue")


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w, {FOLD_SQL.format("text")} AS f FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, k AS keyword FROM d, (VALUES ('the'), ('und')) v(k) WHERE list_contains(w, k) AND (k <> 'the' OR contains(f, 'was') OR contains(f, 'they'))""")
def context_rule(t):
    kw = t.spark.createDataFrame([("e", "the"), ("g", "und")], "category string, keyword string")
    weak = t.spark.createDataFrame([("e", "the", ["was", "they"])], "category string, keyword string, hints array<string>")
    docs = t.documents.filter("text IS NOT NULL")
    return dictionary.context_rule(dictionary.match_keywords(docs, kw, "doc_id", {"text": 1.0}), weak, docs, "doc_id", "text").select("doc_id", "keyword")


@query(f"""WITH d AS (SELECT doc_id, {FOLD_SQL.format("text")} AS f FROM documents), s AS (SELECT doc_id, (contains(f, 'the')::INT + contains(f, 'was')::INT) / 2 AS e, (contains(f, 'und')::INT + contains(f, 'der')::INT + contains(f, 'mit')::INT) / 3 AS g FROM d)
  SELECT doc_id, CASE WHEN greatest(e, g) > 0 THEN CASE WHEN g >= e THEN 'german' ELSE 'english' END ELSE 'unknown' END AS category, round(greatest(e, g), 6) AS share FROM s WHERE e IS NOT NULL""")
def substring_category(t):
    out = classify.substring_category(t.documents.filter("text IS NOT NULL"), {"english": ["the", "was"], "german": ["und", "der", "mit"]}, "doc_id", "text")
    return out.withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS c, round(0.7 * max(o_totalprice) / 600000 + 0.3 * min(o_totalprice) / 600000, 9) AS s FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, c DESC) AS n FROM s)
  SELECT o_custkey AS id, CASE WHEN max(s) FILTER (n = 1) >= 0.3 AND (max(s) FILTER (n = 2) IS NULL OR max(s) FILTER (n = 1) - max(s) FILTER (n = 2) >= 0.08) THEN max(c) FILTER (n = 1) ELSE 'unknown' END AS category FROM r GROUP BY o_custkey""")
def semantic_score(t):
    sims = t.orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("category")).agg((F.max("o_totalprice") / 600000).alias("exemplar"), (F.min("o_totalprice") / 600000).alias("centroid"))
    return classify.semantic_score(sims, "id").select("id", "category")


# ---- scores and texts


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN false ELSE len(embedding) = 64 END AS valid FROM embeddings""")
def valid_vector(t):
    v = F.when(F.col("vec_id") % 5 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return t.embeddings.select("vec_id", scores.valid_vector(v, 64).alias("valid"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR contains(o_orderpriority, 'URGENT') THEN 'error' WHEN o_orderstatus = 'P' OR contains(o_orderpriority, 'HIGH') THEN 'warning' WHEN contains(o_orderpriority, 'LOW') THEN 'success' ELSE 'info' END AS tone FROM orders""")
def event_tone(t):
    event = F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN 'Job_FAILED' WHEN o_orderpriority LIKE '2%' THEN 'will retry' WHEN o_orderpriority LIKE '5%' THEN 'run finished' ELSE 'page' END")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'Error' WHEN 'P' THEN 'cancelled' ELSE NULL END")
    return t.orders.select("o_orderkey", scores.event_tone(event, status).alias("tone"))


@query("SELECT event_type AS kind, CASE event_type WHEN 'error' THEN 'validation' WHEN 'click' THEN 'duplicate_key' WHEN 'view' THEN NULL ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def error_classes(t):
    message = F.expr("CASE event_type WHEN 'error' THEN 'Document failed validation at x' WHEN 'click' THEN 'E11000 Duplicate Key' WHEN 'view' THEN NULL ELSE 'timeout' END")
    return t.events.select(F.col("event_type").alias("kind"), scores.error_class(message).alias("class")).groupBy("kind", "class").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_details(t):
    return t.events.select("event_id", scores.event_details("props")["k"].cast("int").alias("k"))


@query("""SELECT o_orderkey, 8 + 10 * CASE o_orderstatus WHEN 'P' THEN 0.5 WHEN 'F' THEN (25 * (o_orderkey % 4) + 25) / 100 ELSE floor(o_totalprice / 5000) / 128 END AS radius FROM orders""")
def marker_radius(t):
    c = F.expr("CASE o_orderstatus WHEN 'F' THEN 25D * (o_orderkey % 4) + 25 WHEN 'O' THEN floor(o_totalprice / 5000) / 128 END")
    return t.orders.select("o_orderkey", scores.marker_radius(c).alias("radius"))


@query("SELECT o_orderkey, least(a, b) AS start, greatest(a, b) AS stop FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-28' ELSE o_orderdate END AS a, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '1995-01-01' END AS b FROM orders)")
def date_range(t):
    a, b = dates.date_range(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), F.when(F.col("o_orderstatus") != "P", F.lit("1995-01-01").cast("timestamp")), now())
    return t.orders.select("o_orderkey", a.alias("start"), b.alias("stop"))


@query("SELECT doc_id, CASE WHEN contains(lower(source), lower(lang)) THEN source ELSE coalesce(lang, source) END AS place FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source || ' ' || upper(lang) ELSE source END AS source FROM documents)")
def displayed_location(t):
    where = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "source", F.upper("lang"))).otherwise(F.col("source"))
    return t.documents.select("doc_id", text.displayed_location(where, F.col("lang")).alias("place"))


@query("""SELECT doc_id, sha256(concat_ws(chr(10), nullif(trim(source), ''), nullif(trim(lang), ''), nullif(left(trim(text), 4000), ''))) AS payload FROM documents""")
def text_payload(t):
    return t.documents.select("doc_id", F.sha2(text.text_payload("source", "lang", "text"), 256).alias("payload"))


@query("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END AS INTEGER) AS priority, CAST(CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 1 ELSE -1 END AS INTEGER) AS geocode FROM orders")
def ranks(t):
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'failed' ELSE 'odd' END")
    return t.orders.select("o_orderkey", scores.category_priority("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("priority"), scores.geocode_rank(status).alias("geocode"))


# ---- writes and joins of tables


@query("""SELECT o_orderkey AS record_id, CAST(c_custkey IS NOT NULL AS INTEGER) AS has_raw, CAST(coalesce(c_mktsegment <> 'BUILDING', false) AS INTEGER) AS has_source
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey""")
def recompute_inputs(t):
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("raw_document_id"))
    raw = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("raw_document_id"), F.col("c_mktsegment").alias("source_id"), F.col("c_name").alias("title_raw"))
    sources = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("source_id")).distinct().withColumn("domain", F.col("source_id"))
    out = tables.recompute_inputs(records, raw, sources)
    return out.select("record_id", F.col("has_raw").cast("int").alias("has_raw"), F.col("has_source").cast("int").alias("has_source"))


@query("""WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_custkey DESC, o_orderkey DESC LIMIT 200)
  SELECT 'rejected' AS kind, count(*) AS n FROM r UNION ALL SELECT 'accepted', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def dead_letter(t):
    rows = t.orders.select(F.when(F.col("o_orderstatus") != "F", "bad").alias("error"), F.col("o_orderdate").alias("failed_at"), F.col("o_custkey").alias("attempt_count"))
    good, bad = tables.dead_letter(rows)
    return bad.agg(F.lit("rejected").alias("kind"), F.count("*").alias("n")).unionByName(good.agg(F.lit("accepted").alias("kind"), F.count("*").alias("n")))
