"""Registered queries over structures that they build and store: index, buckets, logs, streams, components, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scores import GEOCODE_RANK
from tidewell.operators import aggregates, dictionary, geo, merge, places
from tidewell.plans import jobs
from tidewell.plans.registry import FOLD_SQL, KEYWORDS, ORACLES, STRIP_SQL, TOKENS_SQL, query
from tidewell.sources import tables
from tidewell.sources.bucket_table import BucketTable
from tidewell.sources.manifest import Store, shared_path
from tidewell.sources.text_index import TextIndex
from tidewell.streaming import events as streams


def kept(df: DataFrame, root: str) -> DataFrame:
    """df computed and stored, so that the structure below root that it was read from can go."""
    out = df.checkpoint()
    Store(df.sparkSession, root).delete("")
    return out


def batches(df: DataFrame, key: str, n: int = 4) -> list[DataFrame]:
    """All rows of df in n batches, as they would arrive one after the other."""
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
SEARCH_SQL = f"""WITH d AS (SELECT doc_id, {WORDS.format("split_part(text, chr(10), 1)")} AS t, {WORDS.format("text")} AS b FROM documents),
  w AS (SELECT doc_id, list_distinct(t) AS t, list_distinct(b) AS b, ' ' || array_to_string(t, ' ') || ' ' AS ts, ' ' || array_to_string(b, ' ') || ' ' AS bs FROM d)
  SELECT 'words' AS search, doc_id, CAST(10 * len(list_intersect(t, ['queur', 'that', 'avec'])) + len(list_intersect(b, ['queur', 'that', 'avec'])) AS INTEGER) AS score
  FROM w WHERE list_has_any(b, ['queur', 'that', 'avec']) AND NOT list_has_any(b, ['pour'])
  UNION ALL SELECT 'phrase', doc_id, CAST(10 * len(list_intersect(t, ['und'])) + len(list_intersect(b, ['und'])) AS INTEGER)
  FROM w WHERE list_contains(b, 'und') AND (contains(ts, ' and the ') OR contains(bs, ' and the '))"""


@query(SEARCH_SQL)
def indexed_search(t):
    """Two searches of one index over titles (weight 10) and texts, built in batches that merge."""
    root = shared_path(t.spark, "index")
    docs = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))
    for batch in batches(docs, "doc_id"):
        TextIndex(t.spark, root, "doc_id", {"title": 10, "body": 1}, 16).add(batch)
    index = TextIndex(t.spark, root, "doc_id")
    found = [index.search(q).select(F.lit(name).alias("search"), "doc_id", "score") for name, q in (("words", "queur that avec -pour"), ("phrase", 'und "and the"'))]
    return kept(found[0].unionByName(found[1]), root)


@query("SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, max((o_orderdate, o_orderkey))[1] AS at, min(o_orderdate) AS created FROM orders GROUP BY o_custkey")
def bucketed_upserts(t):
    """Orders by year of arrival as upserts of their customers into a bucketed table; the first date stays."""
    root = shared_path(t.spark, "buckets")
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o"))
    first = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("created"))
    years = [r[0] for r in rows.select(F.year("at")).distinct().orderBy(F.year("at")).collect()]
    for n, year in enumerate(years):
        BucketTable(t.spark, root, ["k"], 16).upsert(rows.filter(F.year("at") == year).join(first, "k"), ["at", "o"], "created", n)
    return kept(BucketTable(t.spark, root, ["k"]).read().select("k", "v", "at", "created"), root)


@query("""WITH w AS (SELECT user_id, event_type, CAST(floor(day(ts) / 8) AS INTEGER) AS week FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
  f AS (SELECT *, min(week) OVER (PARTITION BY user_id) AS first FROM w)
  SELECT user_id, min(event_type) AS event_type, first AS batch FROM f WHERE week = first GROUP BY user_id, first""")
def deduped_batches(t):
    """Parts of the month as batches of a stream, the first one replayed: one row a user that is no known customer."""
    root = shared_path(t.spark, "dedupe")
    rows = t.events.select("user_id", "event_type", F.floor(F.dayofmonth("ts") / 8).cast("int").alias("week"))
    known = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    for n in (0, 0, 1, 2, 3):
        streams.dedupe_batch(rows.filter(F.col("week") == n).drop("week"), n, known, root, "user_id", 8)
    return kept(t.spark.read.parquet(root).select("user_id", "event_type", F.col("batch").cast("int").alias("batch")), root)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def bounded_log(t):
    """Events appended in batches to a log that keeps its newest 500."""
    root = shared_path(t.spark, "log")
    for batch in batches(t.events.select("event_id", "ts"), "event_id"):
        out = tables.append_events(batch, root, 500, ("ts", "event_id"))
    return kept(out, root)


METRE = 6_371_008.8
CUSTOMER_POINTS = "SELECT c_custkey AS id, 40 + (c_custkey * 37 % 1000) / 1000.0 AS lat, 29 + (c_custkey * 91 % 997) / 1000.0 AS lng FROM customer"


@query(f"""WITH RECURSIVE m AS (SELECT id, radians(CAST(lng AS DOUBLE)) * cos(radians(40.5)) * {METRE} AS x, radians(CAST(lat AS DOUBLE)) * {METRE} AS y FROM ({CUSTOMER_POINTS})),
  e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) < 900 AND abs(a.y - b.y) < 900 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 900.0 ** 2),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT a AS id, min(b) AS group_id FROM r GROUP BY a""")
def overlap_groups(t):
    """Customers closer than 900 m, transitively."""
    pts = t.customer.select(F.col("c_custkey").alias("id"), (40 + (F.col("c_custkey") * 37 % 1000) / 1000.0).alias("lat"), (29 + (F.col("c_custkey") * 91 % 997) / 1000.0).alias("lng"))
    return geo.overlap_groups(pts, "id", "lat", "lng", 900.0, 40.5)


CATEGORIES = ["en", "de", "fr", "es"]
MERGE_SQL = """WITH d AS (SELECT source, doc_id AS rank, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END AS category, CAST(doc_id * 7 % 10 AS DOUBLE) / 10 AS confidence,
    list_position(['en', 'de', 'fr', 'es'], CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lang END) AS p, sha256(text) AS body, n_chars AS size, length(text) AS len,
    doc_id * 13 % 5 AS state, doc_id % 5 > 1 AS point, lang || doc_id AS place FROM documents WHERE source IS NOT NULL),
  g AS (SELECT source, count(*) AS n, min(rank) AS record_id, list({'category': category, 'confidence': confidence, 'p': coalesce(p, 99)} ORDER BY rank) AS l,
    arg_max(body, (len, -rank)) AS body_sha, arg_max({'s': state, 't': CASE WHEN point THEN place END, 'u': point}, (state, point, CASE WHEN point THEN 1 ELSE -1 END, -rank)) AS b FROM d GROUP BY source),
  f AS (SELECT *, list_reduce(l, lambda a, x: CASE WHEN x.category <> 'unknown' AND (a.category = 'unknown' OR (x.category <> a.category AND (x.confidence > a.confidence + 1e-9 OR (abs(x.confidence - a.confidence) <= 1e-9 AND x.p < a.p)))) THEN x ELSE a END) AS c FROM g)
  SELECT source, CAST(n AS INTEGER) AS n, record_id, c.category AS category, c.confidence AS confidence, body_sha, b.t AS location_text, b.u AS has_point, CAST(b.s AS INTEGER) AS state FROM f"""


@query(MERGE_SQL)
def merge_fields(t):
    """All documents of a source as one record: categories that promote each other, places of all states."""
    states = F.array(*[F.lit(s) for s in sorted(GEOCODE_RANK, key=GEOCODE_RANK.get)])
    point = F.col("doc_id") % 5 > 1
    rows = t.documents.filter("source IS NOT NULL").select(
        "source", F.col("doc_id").alias("rank"), F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, "unknown").otherwise(F.col("lang")).alias("category"), (F.col("doc_id") * 7 % 10 / 10).alias("confidence"),
        F.array("source").alias("source_list"), F.col("text").alias("body"), F.left("text", F.lit(100)).alias("summary"), F.element_at(states, (F.col("doc_id") * 13 % len(GEOCODE_RANK) + 1).cast("int")).alias("geocode_status"),
        F.when(point, F.concat("lang", F.col("doc_id").cast("string"))).alias("location_text"), F.when(point, 40.0).alias("lat"), F.when(point, 29.0).alias("lng"), F.lit(None).cast("string").alias("district"),
    )
    out = merge.merge_groups(rows, "source", "rank", "record_id", CATEGORIES)
    state = (F.array_position(states, F.col("geocode_status")) - 1).cast("int")
    return out.select("source", "n", "record_id", "category", "confidence", F.sha2("body", 256).alias("body_sha"), "location_text", F.col("lat").isNotNull().alias("has_point"), state.alias("state"))


#: Frequent words of the documents as a gazetteer: districts, and neighbourhoods of which one lies in two of them.
GAZETTEER = [("und", "und", "district"), ("que", "que", "district"), ("that", "that", "district"), ("der", "und", "neighborhood"), ("der", "que", "neighborhood"), ("la", "que", "neighborhood"), ("the", "that", "neighborhood")]
PLACES_SQL = f"""WITH g(place, district, kind) AS (VALUES {", ".join(str(x) for x in GAZETTEER)}),
  d AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS k, generate_subscripts(w, 1) AS pos FROM d), s AS (SELECT *, {STRIP_SQL} AS cut FROM t),
  h AS (SELECT doc_id, pos, k AS span, place, district, kind, CASE WHEN k = place THEN 1.0 ELSE 0.9 END AS score FROM s JOIN g ON k = place OR cut = place),
  one AS (SELECT doc_id, any_value(district) AS hint FROM h WHERE kind = 'district' GROUP BY doc_id HAVING count(DISTINCT district) = 1),
  k AS (SELECT doc_id, pos, span, place, district, kind, score FROM h LEFT JOIN one USING (doc_id)
      WHERE NOT coalesce(kind = 'neighborhood' AND district <> hint AND EXISTS (SELECT 1 FROM h b WHERE b.doc_id = h.doc_id AND b.pos = h.pos AND b.kind = 'neighborhood' AND b.district = hint), false)
    UNION ALL SELECT a.doc_id, a.pos, a.span || ' ' || b.span, b.place, b.district, 'neighborhood', greatest(0.99, b.score) FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.kind = 'district' AND b.kind = 'neighborhood' AND a.district = b.district),
  u AS (SELECT doc_id, span, district, CASE WHEN kind = 'neighborhood' THEN place END AS neighborhood, min(pos) AS pos, max(score) AS score FROM k GROUP BY ALL),
  p AS (SELECT * FROM u WHERE NOT (district = 'que' AND neighborhood IS NULL AND doc_id IN (SELECT doc_id FROM u WHERE district = 'und'))),
  x AS (SELECT *, count(DISTINCT district) OVER (PARTITION BY doc_id, neighborhood) AS kinds, max(contains(span, district)) OVER (PARTITION BY doc_id, neighborhood) AS named FROM p),
  y AS (SELECT * FROM x WHERE neighborhood IS NULL OR kinds <= 1 OR NOT named OR contains(span, district))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, len(string_split(span, ' ')) DESC, pos, coalesce(neighborhood, district), district, neighborhood NULLS FIRST) AS INTEGER) AS rank,
    CAST(pos AS INTEGER) AS pos, span, coalesce(neighborhood, district) AS place, district, neighborhood, CAST(score AS DOUBLE) AS score FROM y"""


@query(PLACES_SQL)
def extract_places(t):
    """Places of all documents by a gazetteer of frequent words: prefixes, hints, precedence, ambiguous names."""
    gazetteer = t.spark.createDataFrame([(p, d, k, p) for p, d, k in GAZETTEER], "canonical_name string, district string, feature_type string, alias string")
    rules = t.spark.createDataFrame([("und", "que")], "preferred string, shadowed string")
    return places.extract_places(tables.spread(t.documents), gazetteer, "doc_id", "text", precedence=rules, most=1)


# ---- read API, reports, whole jobs

DASHBOARD_SQL = """WITH f AS (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS c, o_orderstatus = 'O' AS d, o_custkey % 3 <> 0 AS point, o_orderdate >= TIMESTAMP '1998-01-01' AS recent FROM orders WHERE o_totalprice > 1000)
  SELECT 'stats_total' AS facet, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM f WHERE c AND d UNION ALL SELECT 'stats_sources', NULL, count(DISTINCT o_custkey) FROM f WHERE c AND d
  UNION ALL SELECT 'stats_recent', NULL, count(*) FROM f WHERE c AND d AND recent UNION ALL SELECT 'stats_geocoded', NULL, count(*) FROM f WHERE c AND d AND point UNION ALL SELECT 'map_total', NULL, count(*) FROM f WHERE c AND d AND point
  UNION ALL SELECT 'stats_categories', o_orderpriority, count(*) FROM f WHERE c AND d GROUP BY 2 UNION ALL SELECT 'stats_districts', o_orderstatus, count(*) FROM f WHERE c AND d GROUP BY 2
  UNION ALL SELECT 'category_facets', o_orderpriority, count(*) FROM f WHERE d GROUP BY 2 UNION ALL SELECT 'district_facets', o_orderstatus, count(*) FROM f WHERE c GROUP BY 2"""


def as_orders(t) -> DataFrame:
    """Orders as records: those of status P are merged away, those of some customers have no point."""
    placed = F.col("o_custkey") % 3 != 0
    return t.orders.withColumns({"record_status": F.when(F.col("o_orderstatus") == "P", "merged_duplicate"), "lat": F.when(placed, F.lit(40.0)), "lng": F.when(placed, F.lit(29.0))})


@query(DASHBOARD_SQL)
def dashboard_page(t):
    names = {"category": "o_orderpriority", "district": "o_orderstatus", "source": "o_custkey", "ts": "o_orderdate"}
    wants = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "O"
    return aggregates.dashboard_facets(t.orders, names, F.lit("1998-01-01").cast("timestamp"), *wants, F.col("o_totalprice") > 1000, F.col("o_custkey") % 3 != 0)


@query("""WITH r AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'P')
  SELECT 'item' AS part, o_orderkey AS value FROM (SELECT * FROM r ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10) UNION ALL SELECT 'total', count(*) FROM r""")
def list_page(t):
    rows, total = jobs.list_records(as_orders(t), F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "o_orderdate", "o_orderkey", 10, 20)
    return rows.select(F.lit("item").alias("part"), F.col("o_orderkey").alias("value")).unionByName(total.select(F.lit("total").alias("part"), F.col("total").alias("value")))


@query("SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500) WHERE o_custkey % 3 <> 0")
def map_page(t):
    return jobs.map_points(as_orders(t), F.col("o_totalprice") > 1000, "o_orderdate", "o_orderkey", 500).select("o_orderkey")


@query(f"WITH k AS ({ORACLES['keyword_classify']}) SELECT lang AS old_category, coalesce(category, 'unknown') AS new_category, count(*) AS n FROM documents LEFT JOIN k USING (doc_id) GROUP BY ALL")
def reclassify_documents(t):
    records = tables.spread(t.documents).select(F.col("doc_id").alias("record_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"), F.col("lang").alias("category"))
    return jobs.reclassify(records, t.spark.createDataFrame(KEYWORDS, "category string, keyword string"), ["function", "romance", "german", "phrase"])[1]


@query("""SELECT unnest(['lang', 'source', 'n_chars']) AS field, unnest([count(*) FILTER (lang IS DISTINCT FROM lower(left(source, 2))), count(*) FILTER (source IS DISTINCT FROM lower(source)), count(*) FILTER (n_chars IS DISTINCT FROM length(text))]) AS changed,
  count(*) AS total FROM documents""")
def change_report(t):
    old = t.documents.select(F.col("lang").alias("old_lang"), F.col("source").alias("old_source"), F.col("n_chars").alias("old_n_chars"), F.lower(F.left("source", F.lit(2))).alias("new_lang"), F.lower("source").alias("new_source"), F.length("text").alias("new_n_chars"))
    return aggregates.change_report(old, ["lang", "source", "n_chars"])


@query("""SELECT event_type AS district, count(*) AS total, count(*) FILTER (value > 20) AS succeeded, round(count(*) FILTER (value > 20) / count(*), 3) AS success_rate FROM events WHERE event_type <> '' GROUP BY event_type""")
def geocodes_by_district(t):
    return aggregates.geocodes_by_district(t.events.select((F.col("value") > 20).alias("ok"), F.col("event_type").alias("district")))


@query("SELECT event_id, props AS address, event_type AS failure_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC, props LIMIT 100")
def failed_addresses(t):
    rows = t.events.select("event_id", (F.col("event_type") != "error").alias("ok"), F.col("props").alias("address"), F.col("event_type").alias("failure_type"))
    return aggregates.failed_addresses(rows, "event_id")


@query("""WITH p AS (SELECT variant, CASE WHEN n_chars >= least THEN 'good' END AS p, CASE WHEN quality = 1 THEN 'good' END AS e FROM labels LEFT JOIN documents USING (doc_id), (VALUES ('any', 250), ('long', 1000)) v(variant, least)),
  m AS (SELECT variant, count(*) AS total, count(*) FILTER (p IS NOT DISTINCT FROM e) AS correct, count(*) FILTER (p IS NULL AND e IS NOT NULL) AS fn, count(*) FILTER (p IS NOT NULL AND e IS NULL) AS fp FROM p GROUP BY variant),
  d AS (SELECT round(count(*) FILTER ((toxic = 1) = (quality = 0)) / count(*), 4) AS accuracy, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fn FROM labels)
  SELECT variant AS subject, unnest(['total', 'correct', 'false_negative', 'false_positive', 'wrong', 'accuracy']) AS measure, unnest([CAST(total AS DOUBLE), correct, fn, fp, 0, round(correct / total, 4)]) AS value FROM m
  UNION ALL SELECT 'duplicates', unnest(['accuracy', 'false_positive', 'false_negative']), unnest([CAST(accuracy AS DOUBLE), fp, fn]) FROM d""")
def evaluation_report(t):
    good = lambda least: t.documents.select("doc_id", F.when(F.col("n_chars") >= least, "good").alias("predicted"))
    labels = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("expected"))
    pairs = t.labels.select((F.col("toxic") == 1).alias("is_duplicate"), (F.col("quality") == 0).alias("expected"))
    return jobs.evaluation_report({"any": good(250), "long": good(1000)}, labels, "doc_id", pairs=pairs)


STRIP_WORD = STRIP_SQL.replace("k LIKE", "lower({0}) LIKE").replace("length(k)", "length({0})").replace("left(k", "left({0}").replace("ELSE k", "ELSE {0}")
LINK_WORDS_SQL = f"""WITH g AS (SELECT DISTINCT a, {FOLD_SQL.format("a")} AS f FROM (SELECT unnest(string_split_regex(text, '[\\s,;:.!?()\\[\\]"]+')) AS a FROM benchmark) WHERE length(a) BETWEEN 8 AND 14),
  t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\s,;:.!?()\\[\\]"]+'), lambda x: x <> '') AS w FROM documents)),
  v AS (SELECT DISTINCT word, word AS s0, {STRIP_WORD.format("word")} AS s1 FROM t WHERE length(word) >= 3), c AS (SELECT *, {STRIP_WORD.format("s1")} AS s2 FROM v),
  s AS (SELECT word, turn, s, {FOLD_SQL.format("s")} AS f FROM (SELECT word, 0 AS turn, s0 AS s FROM c UNION ALL SELECT word, 1, s1 FROM c WHERE s1 <> s0 UNION ALL SELECT word, 2, s2 FROM c WHERE s2 <> s1)),
  m AS (SELECT word, turn, 1 AS place, a, 'exact' AS tier, 1.0 AS score FROM s JOIN g ON s = a UNION ALL SELECT word, turn, 2, a, 'normalized', 0.95 FROM s JOIN g USING (f)
    UNION ALL SELECT word, turn, 4, a, 'fuzzy', CAST(2 AS DOUBLE) * least(length(s.f), length(g.f)) / (length(s.f) + length(g.f)) FROM s JOIN g ON left(s.f, 3) = left(g.f, 3) AND abs(length(s.f) - length(g.f)) = 1
      AND list_contains(list_transform(range(1, greatest(length(s.f), length(g.f)) + 1), lambda i: CASE WHEN length(s.f) > length(g.f) THEN left(s.f, CAST(i AS INTEGER) - 1) || substr(s.f, CAST(i AS INTEGER) + 1) ELSE left(g.f, CAST(i AS INTEGER) - 1) || substr(g.f, CAST(i AS INTEGER) + 1) END), CASE WHEN length(s.f) > length(g.f) THEN g.f ELSE s.f END) AND least(length(s.f), length(g.f)) >= 8 AND regexp_full_match(s.f, '\\p{{L}}+') AND regexp_full_match(g.f, '\\p{{L}}+')),
  b AS (SELECT word, arg_min({{'a': a, 'tier': tier, 'score': score}}, (turn, place, -score, a)) AS b FROM m GROUP BY word),
  h AS (SELECT doc_id, b.a AS canonical_name, min(pos) AS pos, arg_min({{'word': word, 'tier': b.tier, 'score': b.score}}, pos) AS f FROM t JOIN b USING (word) WHERE length(word) >= 3 GROUP BY 1, 2)
  SELECT doc_id, canonical_name, CAST(pos AS INTEGER) AS pos, f.word AS word, f.tier AS tier, CAST(f.score AS DOUBLE) AS score FROM h"""


@query(LINK_WORDS_SQL)
def link_words(t):
    """Words of all documents against long words of the benchmark: exact, folded and fuzzy, with and without endings."""
    split = F.explode(F.split("text", r"[\s,;:.!?()\[\]\"]+"))
    aliases = t.benchmark.select(split.alias("alias")).filter(F.length("alias").between(8, 14)).distinct()
    gazetteer = aliases.select(F.col("alias").alias("canonical_name"), F.lit(None).cast("string").alias("district"), F.lit("place").alias("feature_type"), "alias", F.lit(True).alias("allow_fuzzy"))
    return dictionary.link_words(tables.spread(t.documents), gazetteer, "doc_id", "text").drop("district")
