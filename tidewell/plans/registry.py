"""Registered queries of the library over the given tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import dates, keys, text
from tidewell.operators import aggregates, classify, dedup, dictionary, filters, geo, merge, sets, windows
from tidewell.operators.embed import embed, hash_embedder
from tidewell.plans import jobs
from tidewell.sources import pages as page_job
from tidewell.sources import tables
from tidewell.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"
HTML_PARAGRAPH = r"(?s)<p>(.*?)</p>"


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def now():
    return F.lit(NOW).cast("timestamp")


# ---- facets, counts, pages


@query("SELECT lang AS key, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang")
def bucket_counts(t):
    return aggregates.bucket_counts(t.documents, "lang")


@query(f"SELECT count(*) AS total, count(DISTINCT event_type) AS n_sources, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY) AS n_recent FROM events")
def stats_meta(t):
    return aggregates.stats_meta(t.events, "event_type", "ts", now() - F.expr("INTERVAL 3 DAYS"))


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'meta' END AS facet,
  coalesce(o_orderstatus, o_orderpriority) AS key, count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS n_recent
  FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def stats(t):
    return aggregates.stats(t.orders, ["o_orderstatus", "o_orderpriority"], "o_custkey", "o_orderdate", F.lit("1998-01-01").cast("timestamp"))


@query("""WITH f AS (SELECT o_orderpriority AS c, o_orderstatus AS d, o_orderpriority IN ('1-URGENT', '2-HIGH') AS wc, o_orderstatus = 'O' AS wd FROM orders WHERE o_totalprice > 1000)
  SELECT 'category' AS facet, c AS key, count(*) FILTER (wd) AS n FROM f GROUP BY c HAVING count(*) FILTER (wd) > 0
  UNION ALL SELECT 'district', d, count(*) FILTER (wc) FROM f GROUP BY d HAVING count(*) FILTER (wc) > 0
  UNION ALL SELECT 'total', NULL, count(*) FILTER (wc AND wd) FROM f""")
def dashboard_facets(t):
    wants = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "O"
    return aggregates.dashboard(t.orders, "o_orderpriority", "o_orderstatus", *wants, F.col("o_totalprice") > 1000)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20")
def page_newest(t):
    return windows.page(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey", 20, 50)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'")
def filtered_total(t):
    keep = filters.merge_filters([filters.by_values("o_orderstatus", ["f,O"], ["F", "O", "P"]), filters.by_date("o_orderdate", "1994-01-01", "1996-12-31")])
    return t.orders.filter(keep).agg(F.count("*").alias("total"))


@query("""WITH d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+') AS w FROM documents)
  SELECT doc_id, 2 * (CASE WHEN list_contains(w, 'queur') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'that') THEN 1 ELSE 0 END + CASE WHEN list_contains(w, 'avec') THEN 1 ELSE 0 END) AS score
  FROM d WHERE list_has_any(w, ['queur', 'that', 'avec']) AND NOT list_has_any(w, ['pour'])""")
def text_search(t):
    keep, score = filters.text_search("queur that avec -pour", {"text": 2})
    return t.documents.filter(keep).select("doc_id", score.alias("score"))


@query("SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def active_only(t):
    rows = t.orders.withColumn("record_status", F.when(F.col("o_orderstatus") == "P", "merged_duplicate"))
    return aggregates.bucket_counts(rows.filter(filters.is_active()), "o_orderpriority")


@query("SELECT CAST(sum(n) FILTER (key IN ('en', 'fr')) AS BIGINT) AS selected, CAST(sum(n) AS BIGINT) AS all_keys FROM (SELECT lang AS key, count(*) AS n FROM documents GROUP BY lang)")
def filter_summary(t):
    return aggregates.filter_summary(aggregates.bucket_counts(t.documents, "lang"), ["en", "fr"])


@query(f"""SELECT CASE event_type WHEN 'click' THEN 'reading' WHEN 'view' THEN 'reading' WHEN 'purchase' THEN 'sale' ELSE 'other' END AS category, count(*) AS n,
  count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR) AS live, count(DISTINCT user_id) AS n_sources FROM events GROUP BY 1""")
def feed_counts(t):
    return aggregates.feed_counts(t.events, "event_type", {"click": "reading", "view": "reading", "purchase": "sale"}, "ts", now(), "user_id")


@query(f"""WITH f AS (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '{NOW}' - ts) / 60) AS BIGINT) AS m FROM events ORDER BY ts DESC, event_id LIMIT 8)
  SELECT event_id, ts, m <= 90 AS is_recent, CASE WHEN m < 60 THEN 'min' WHEN m < 1440 THEN 'hour' ELSE 'day' END AS age_unit, CASE WHEN m < 60 THEN m WHEN m < 1440 THEN m // 60 ELSE m // 1440 END AS age FROM f""")
def newest_feed(t):
    return windows.newest_feed(t.events.select("event_id", "ts"), "ts", "event_id", now())


# ---- text, hashes, urls


@query(r"""SELECT doc_id, sha256(nullif(trim(regexp_replace(text, '\s+', ' ', 'g'), ' -+|/'), '')) AS cleaned FROM documents""")
def clean_text(t):
    return t.documents.select("doc_id", F.sha2(text.clean_text("text"), 256).alias("cleaned"))


@query(r"""SELECT doc_id, sha256(trim(trim(split_part(text, chr(10), 1)) || chr(10) || trim(text), E' \n\t\r')) AS content_hash FROM documents""")
def content_hash(t):
    return t.documents.select("doc_id", keys.content_hash(F.split_part("text", F.lit("\n"), F.lit(1)), "text").alias("content_hash"))


@query(r"""WITH c AS (SELECT doc_id, trim(left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' -+|/'), 280), ' -+|/') AS s FROM documents)
  SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+')[1:80], ' ')) AS dedupe_hash FROM c""")
def dedupe_hash(t):
    return t.documents.select("doc_id", keys.dedupe_hash(F.lit(None).cast("string"), "text", text.summary("text")).alias("dedupe_hash"))


@query("SELECT page_id, sha256('web' || '::' || url) AS idempotency_key FROM pages")
def idempotency_key(t):
    return t.pages.select("page_id", keys.idempotency_key(F.lit("web"), "url").alias("idempotency_key"))


@query(r"""WITH u AS (SELECT page_id, rtrim(regexp_replace(trim(url), '#.*$', ''), '/') AS url, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS host FROM pages)
  SELECT page_id, url, host, split_part(regexp_replace(host, '^www\.', ''), '.', 1) AS site FROM u""")
def page_urls(t):
    return t.pages.select("page_id", keys.normalize_url("url").alias("url"), keys.host("url").alias("host"), keys.site_key("url").alias("site"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
  c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS h FROM b)
  SELECT page_id, sha256(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS text_sha FROM c""")
def html_to_text(t):
    return page_job.page_text(t.pages).select("page_id", F.sha2("text", 256).alias("text_sha"))


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(replace(lower(regexp_replace(translate(text, '{text.FOLD_FROM}', '{text.FOLD_TO}'), '[’'']', '', 'g')), '-', ' '), '\\s+', ' ', 'g'))) AS folded FROM documents""")
def fold_text(t):
    return t.documents.select("doc_id", F.sha2(text.fold("text"), 256).alias("folded"))


@query("SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def parse_iso(t):
    return t.orders.select("o_orderkey", dates.parse_published(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("parsed"))


@query("""WITH w AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(p_type, ' ')) AS l FROM part)
  SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ',') AS merged FROM w""")
def merge_sources(t):
    return t.part.select("p_partkey", F.array_join(sets.merge_sources(F.split("p_name", " "), F.split("p_type", " ")), ",").alias("merged"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
  SELECT p_partkey, round(len(list_intersect(a, b)) / least(len(a), len(b)), 4) AS overlap FROM w""")
def token_overlap(t):
    return t.part.select("p_partkey", F.round(sets.token_overlap(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")), 4).alias("overlap"))


# ---- pages


LINKS = r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), 1) - 1 AS pos FROM pages),
  a AS (SELECT lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS source, page_id, pos,
    rtrim(regexp_replace(CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END, '#.*$', ''), '/') AS link FROM l),
  f AS (SELECT source, link AS url, min((page_id, pos)) AS first_at FROM a WHERE link LIKE 'http%://%' GROUP BY source, link),
  r AS (SELECT source, url, row_number() OVER (PARTITION BY source ORDER BY first_at, url) AS pos FROM f)
  SELECT source, url, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 30"""


@query(LINKS)
def extract_links(t):
    return page_job.extract_links(t.pages)


@query()
def extract_articles(t):
    return page_job.extract_articles(t.pages)


FOLD_SQL = "trim(regexp_replace(replace(lower(regexp_replace(translate({0}, '" + text.FOLD_FROM + "', '" + text.FOLD_TO + "'), '[’'']', '', 'g')), '-', ' '), '\\s+', ' ', 'g'))"


def html_sql(html: str) -> str:
    """keys.html_to_text() in SQL."""
    out = f"regexp_replace(regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


#: A paragraph with one of these ends an article; this one closes many of the pages.
STOP_PHRASES = ["the and attion to thanedble"]
PARAGRAPHS = f"""WITH p AS (SELECT page_id, html, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) AS pos FROM pages),
  c AS (SELECT page_id, pos, {html_sql("x")} AS x, {{title}} AS title FROM p),
  s AS (SELECT *, min(pos) FILTER ({{stop}}) OVER (PARTITION BY page_id) AS last FROM c)
  SELECT page_id, sha256(string_agg(x, chr(10) ORDER BY pos)) AS content_sha FROM s WHERE (last IS NULL OR pos < last) AND length(x) >= 20 AND {FOLD_SQL.format("x")} IS DISTINCT FROM {FOLD_SQL.format("title")} GROUP BY page_id"""


@query(PARAGRAPHS.format(title="''", stop="false"))
def select_paragraphs(t):
    found = F.posexplode(F.regexp_extract_all("html", F.lit(HTML_PARAGRAPH), 1)).alias("pos", "raw")
    rows = t.pages.select("page_id", found).select("page_id", "pos", keys.html_to_text("raw").alias("text"), F.lit("").alias("title"))
    return page_job.select_paragraphs(rows, []).select("page_id", F.sha2("content", 256).alias("content_sha"))


@query(PARAGRAPHS.format(title=html_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"), stop=f"regexp_matches({FOLD_SQL.format('x')}, '{STOP_PHRASES[0]}')"))
def select_all_paragraphs(t):
    """With titles and stop phrases."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(HTML_PARAGRAPH), 1)).alias("pos", "raw")
    title = keys.html_to_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    rows = t.pages.select("page_id", title.alias("title"), found).select("page_id", "pos", keys.html_to_text("raw").alias("text"), "title")
    return page_job.select_paragraphs(rows, STOP_PHRASES).select("page_id", F.sha2("content", 256).alias("content_sha"))


@query("SELECT page_id, (html IS NULL OR html = '' OR contains(lower(html), 'cf-challenge') OR contains(lower(html), 'cf-chl-widget') OR contains(lower(html), 'your request was blocked') OR (length(html) < 15000 AND (contains(lower(html), 'just a moment') OR contains(lower(html), 'attention required') OR contains(lower(html), 'id=\"challenge-platform\"')))) AS blocked FROM pages")
def is_blocked(t):
    return t.pages.select("page_id", page_job.is_blocked("html").alias("blocked"))


# ---- duplicates and merging


@query("WITH f AS (SELECT text, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id, first_id, n FROM documents JOIN f USING (text)")
def hash_duplicates(t):
    return dedup.hash_duplicates(t.documents.withColumn("h", F.sha2("text", 256)), "h", "doc_id")


LEXICAL = r"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body FROM documents WHERE text IS NOT NULL),
  k AS (SELECT doc_id, {fold_title} AS ft, {fold_body} AS fb FROM d),
  s AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(ft, '[\p{{L}}\p{{N}}_]+')), lambda x: length(x) >= 2 AND x NOT IN ({stop})) AS tt,
    list_filter(list_distinct(regexp_extract_all(left(fb, 900), '[\p{{L}}\p{{N}}_]+')), lambda x: length(x) >= 2 AND x NOT IN ({stop})) AS bt FROM k),
  w AS (SELECT doc_id, len(bt) AS n, unnest(bt) AS w FROM s),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / least(any_value(x.n), any_value(y.n)) AS o FROM w x JOIN w y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2),
  q AS (SELECT a, b, floor(o * 10000 + 0.5) / 10000 AS body_score, len(list_intersect(x.tt, y.tt)) AS shared,
    floor(CASE WHEN least(len(x.tt), len(y.tt)) > 0 THEN len(list_intersect(x.tt, y.tt)) / least(len(x.tt), len(y.tt)) ELSE 0 END * 10000 + 0.5) / 10000 AS title_score
    FROM p JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE o >= 0.4455),
  r AS (SELECT *, floor((CAST(0.35 AS DOUBLE) * title_score + CAST(0.65 AS DOUBLE) * body_score) * 10000 + 0.5) / 10000 AS combined FROM q)
  SELECT a, b, body_score, title_score, combined FROM r WHERE body_score >= 0.9 OR (body_score >= 0.72 AND title_score >= 0.45 AND shared >= 1) OR (combined >= 0.64 AND shared >= 2)"""


@query(LEXICAL.format(fold_title=FOLD_SQL.format("title"), fold_body=FOLD_SQL.format("body"), stop=", ".join(f"'{w}'" for w in dedup.STOP_WORDS)))
def lexical_duplicates(t):
    docs = tables.spread(t.documents).filter("text IS NOT NULL").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))
    return dedup.lexical_duplicates(docs, "doc_id", "title", "body", with_ratio=False)


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.4")
def semantic_duplicates(t):
    return dedup.semantic_duplicates(t.embeddings, "vec_id", "embedding", 0.4).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query()
def leaders(t):
    pairs = dedup.semantic_duplicates(t.embeddings, "vec_id", "embedding", 0.4).withColumnRenamed("similarity", "score").checkpoint()
    return dedup.leaders(pairs, t.embeddings, "vec_id")


def as_records(docs: DataFrame) -> DataFrame:
    """Documents in the columns of source records."""
    return docs.select(
        F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("dedupe_hash"), F.col("lang").alias("category"), F.lit(0.5).alias("confidence"), F.array("source").alias("source_list"),
        F.col("text").alias("body"), F.left("text", F.lit(100)).alias("summary"), F.lit("pending").alias("geocode_status"), F.lit(None).cast("string").alias("location_text"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("timestamp").alias("published_at"),
    )


@query("SELECT doc_id AS record_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS canonical_rank FROM documents")
def canonical_rank(t):
    return windows.canonical_rank(as_records(t.documents)).select("record_id", F.col("canonical_rank").cast("long").alias("canonical_rank"))


@query("""WITH s AS (SELECT sha256(text) AS h, lower(source) AS source, min(doc_id) AS first_at FROM documents GROUP BY 1, 2), g AS (SELECT h, string_agg(source, ',' ORDER BY first_at) AS sources FROM s GROUP BY h)
  SELECT h AS dedupe_hash, min(doc_id) AS record_id, count(*) AS n, any_value(sources) AS sources FROM documents JOIN g ON sha256(text) = h GROUP BY h""")
def merge_groups(t):
    ranked = windows.canonical_rank(as_records(t.documents))
    merged = merge.merge_groups(ranked, "dedupe_hash", "canonical_rank", "record_id", ["en", "de", "fr", "es"])
    return merged.select("dedupe_hash", "record_id", F.col("n").cast("long").alias("n"), F.array_join("source_list", ",").alias("sources"))


@query("SELECT count(*) FILTER (n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS merged_rows, count(*) FILTER (n = 1) AS singletons FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def merge_report(t):
    return merge.merge_report(as_records(t.documents), "dedupe_hash")


@query("""WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text), d AS (SELECT doc_id, source, first FROM documents JOIN f USING (text))
  SELECT m.doc_id AS record_id, count(r.doc_id) AS n_related, coalesce(string_agg(CAST(r.doc_id AS VARCHAR), ',' ORDER BY r.doc_id DESC), '') AS related
  FROM d m LEFT JOIN d r ON r.first = m.doc_id AND r.doc_id <> r.first WHERE m.doc_id = m.first GROUP BY m.doc_id""")
def with_related(t):
    rec = as_records(t.documents).withColumn("dataset_generation", F.lit("g1"))
    first = rec.groupBy("dedupe_hash").agg(F.min("record_id").alias("first"))
    rec = rec.join(first, "dedupe_hash").withColumn("duplicate_of_record_id", F.when(F.col("first") != F.col("record_id"), F.col("first")))
    out = tables.with_related(rec, ["published_at", "record_id"])
    return out.select("record_id", F.coalesce(F.size("related"), F.lit(0)).cast("long").alias("n_related"), F.coalesce(F.array_join(F.col("related.record_id").cast("array<string>"), ","), F.lit("")).alias("related"))


@query("""WITH h AS (SELECT doc_id, sha256('text:' || text) AS one FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, one || sha256(unhex(one)) AS hex FROM h),
  v AS (SELECT doc_id, list_transform(range(64), lambda i: (strpos('0123456789abcdef', substr(hex, CAST(2 * i + 1 AS INTEGER), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, CAST(2 * i + 2 AS INTEGER), 1)) - 1) AS v FROM b)
  SELECT doc_id, len(list_filter(v, lambda x: x > 127)) AS n_positive, list_position(v, list_max(v)) AS largest FROM v""")
def hash_embedding(t):
    rows = t.documents.filter("text IS NOT NULL").select("doc_id", embed("text", lambda: hash_embedder(64)).alias("v"))
    n = F.size(F.filter("v", lambda x: x > 0)).cast("long")
    return rows.select("doc_id", n.alias("n_positive"), F.array_position("v", F.array_max("v")).cast("int").alias("largest"))


# ---- dictionaries and categories

KEYWORDS = [("function", "the"), ("function", "and"), ("function", "that"), ("romance", "que"), ("romance", "les"), ("romance", "pour"), ("german", "und"), ("german", "der"), ("phrase", "of the")]


@query("""WITH k(category, keyword, prio) AS (VALUES """ + ", ".join(f"('{c}', '{k}', {['function', 'romance', 'german', 'phrase'].index(c) + 1})" for c, k in KEYWORDS) + """),
  d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(""" + FOLD_SQL.format("text") + """, '[^a-z0-9\\p{L}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents WHERE text IS NOT NULL),
  m AS (SELECT doc_id, category, prio, count(*) AS n FROM d, k WHERE contains(s, ' ' || keyword || ' ') GROUP BY ALL)
  SELECT doc_id, arg_max(category, n * 100 - prio) AS category, CAST(max(n) AS DOUBLE) AS score, CAST(round(least(0.92, 0.45 + 0.10 * (arg_max(n, n * 100 - prio) - 1)), 4) AS DOUBLE) AS confidence FROM m GROUP BY doc_id""")
def keyword_classify(t):
    kw = t.spark.createDataFrame(KEYWORDS, "category string, keyword string")
    matches = dictionary.match_keywords(tables.spread(t.documents), kw, "doc_id", {"text": 1.0})
    return classify.category_scores(matches, "doc_id", ["function", "romance", "german", "phrase"]).select("doc_id", "category", "score", "confidence")


TOKENS_SQL = "list_filter(string_split_regex(" + FOLD_SQL + ", '[^a-z0-9\\p{{L}}]+'), lambda x: x <> '')"
STRIP_SQL = "CASE " + " ".join(f"WHEN k LIKE '%{e}' AND length(k) > {len(e) + 2} THEN left(k, length(k) - {len(e)})" for e in text.CASE_SUFFIXES) + " ELSE k END"
LINK_SQL = f"""WITH a AS (SELECT DISTINCT item_id, array_to_string({TOKENS_SQL.format("text")}[1:3], ' ') AS alias FROM benchmark),
  d AS (SELECT doc_id, {TOKENS_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d), r AS (SELECT doc_id, pos, w, unnest([1, 2, 3]) AS n FROM p),
  k AS (SELECT doc_id, pos, array_to_string(w[pos : pos + n - 1], ' ') AS k FROM r WHERE pos + n - 1 <= len(w)), s AS (SELECT *, {STRIP_SQL} AS cut FROM k),
  h AS (SELECT doc_id, pos, k, item_id, 1.0 AS score FROM s JOIN a ON k = alias UNION ALL SELECT doc_id, pos, k, item_id, 0.9 FROM s JOIN a ON cut = alias AND k <> alias)
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, k AS span, item_id AS canonical_name_MORE_ FROM h"""


def linked(t) -> DataFrame:
    """The first three words of every benchmark item, found in all documents as written or without a case ending."""
    lead = F.array_join(F.slice(F.filter(dictionary.tokens("text"), lambda x: x != ""), 1, 3), " ")
    aliases = t.benchmark.select(F.col("item_id").alias("canonical_name"), F.lit("").alias("district"), lead.alias("alias"))
    return dictionary.link_dictionary(tables.spread(t.documents).filter("text IS NOT NULL"), aliases, "doc_id", "text", 3)


@query(LINK_SQL.replace("_MORE_", ""))
def link_dictionary(t):
    return linked(t).select("doc_id", "pos", "span", "canonical_name")


@query(LINK_SQL.replace("_MORE_", ", CAST(score AS DOUBLE) AS score, CASE WHEN score = 1.0 THEN 'exact' ELSE 'suffix' END AS tier"))
def link_dictionary_tiers(t):
    return linked(t).select("doc_id", "pos", "span", "canonical_name", "score", "tier")


@query("""WITH c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i)
  SELECT label, CAST(i AS INTEGER) AS dim, round(m, 6) AS mean FROM c""")
def centroids(t):
    rows = aggregates.centroids(t.embeddings, "label", "embedding")
    return rows.select("label", F.posexplode("centroid").alias("dim", "mean")).select("label", "dim", F.round("mean", 6).alias("mean"))


@query("""WITH c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
  p AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY label),
  s AS (SELECT vec_id, p.label AS category, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, p)
  SELECT vec_id, arg_max(category, s) AS category, round(max(s), 4) AS similarity FROM s GROUP BY vec_id""")
def nearest_prototype(t):
    protos = aggregates.centroids(t.embeddings, "label", "embedding").select(F.col("label").alias("category"), F.col("centroid").alias("vector"))
    sims = classify.nearest_prototype(t.embeddings, protos, "vec_id", "embedding")
    return sims.groupBy("vec_id").agg(F.max_by("category", "similarity").alias("category"), F.round(F.max("similarity"), 4).alias("similarity"))


@query("SELECT o_orderpriority AS old_category, o_orderstatus AS new_category, count(*) AS n FROM orders GROUP BY ALL")
def category_transitions(t):
    return aggregates.category_transitions(t.orders.select(F.col("o_orderpriority").alias("old_category"), F.col("o_orderstatus").alias("new_category")))


# ---- crawls, sinks


SESSIONS = "SELECT user_id, count(*) AS listed, count(*) FILTER (event_type <> 'error') AS parsed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id"


def as_sessions(t):
    rows = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("parsed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return rows.withColumn("errors", F.lit(0)).withColumn("status", aggregates.session_status())


@query(f"SELECT user_id, CASE WHEN failed = 0 THEN 'success' WHEN parsed > 0 THEN 'partial' ELSE 'failed' END AS status FROM ({SESSIONS})")
def session_status(t):
    return as_sessions(t).select("user_id", "status")


@query(f"WITH s AS ({SESSIONS}) SELECT CASE WHEN count(*) = 0 THEN 'no_active_sources' WHEN count(*) FILTER (failed > 0) > 0 THEN 'refresh_not_fully_successful' END AS reason FROM s")
def publish_gate(t):
    return aggregates.publish_gate(as_sessions(t).withColumn("skip_reason", F.lit(None).cast("string")), [])


@query("""SELECT user_id AS source, count(*) AS listed, count(*) FILTER (event_type IN ('purchase', 'view', 'signup', 'click')) AS fetched, count(*) FILTER (event_type IN ('purchase', 'view')) AS parsed,
  count(*) FILTER (event_type IN ('error', 'signup')) AS failed, count(*) FILTER (event_type = 'purchase') AS inserted, count(*) FILTER (event_type = 'view') AS duplicate, count(*) FILTER (event_type = 'click') AS lookback_filtered,
  arg_min(props, event_id) FILTER (event_type = 'error') AS first_error FROM events GROUP BY user_id""")
def crawl_summary(t):
    names = {"purchase": "inserted", "view": "duplicate", "signup": "invalid_record", "click": "lookback_filtered", "error": "failed"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("pos"), table[F.col("event_type")].alias("outcome"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return aggregates.crawl_summary(rows)


@query("""WITH b AS (SELECT o_custkey AS k, o_totalprice AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT coalesce(c_custkey, k) AS k, coalesce(v, c_acctbal) AS v, CASE WHEN k IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS status FROM customer FULL JOIN b ON c_custkey = k""")
def upsert_latest(t):
    target = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("o"))
    batch = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o"))
    return tables.upsert(target, batch, ["k"], ["at", "o"]).select("k", "v", "status")


@query("SELECT DISTINCT c_nationkey AS n_nationkey, CAST(NULL AS VARCHAR) AS n_name FROM customer UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def insert_if_absent(t):
    dim = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name")).distinct()
    return tables.insert_if_absent(dim, t.nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT 'raw_documents' AS table_name, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'source_records', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def drop_children(t):
    raw = t.orders.withColumnRenamed("o_orderkey", "raw_document_id")
    return tables.drop_children(raw, t.lineitem.withColumnRenamed("l_orderkey", "raw_document_id"), F.col("o_orderstatus") == "P")[2]


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal NOT BETWEEN 0 AND 9000 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS violations
  FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def validate(t):
    rules = {"balance": tables.in_range("c_acctbal", 0, 9000), "segment": tables.one_of("c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"])}
    return tables.validate(t.customer, rules)[1].select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query(f"SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '{NOW}'")
def expire(t):
    return tables.expire(t.events, "ts", now(), "7 DAYS").select("event_id")


@query("""WITH q AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events)
  SELECT CAST(least(100, count(*)) AS BIGINT) AS dequeued, count(*) FILTER (n <= 100 AND event_type <> 'error') AS processed, count(*) FILTER (n <= 100 AND event_type = 'error' AND user_id % 3 + 1 < 3) AS requeued,
  count(*) FILTER (n <= 100 AND event_type = 'error' AND user_id % 3 + 1 >= 3) AS dead_lettered FROM q""")
def retry_summary(t):
    rows = t.events.select(F.col("event_id").alias("position"), (F.col("user_id") % 3).cast("int").alias("attempt_count"), (F.col("event_type") != "error").alias("ok"))
    return tables.retry_summary(tables.retry_split(rows, 100, 3))


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'total', (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)")
def reset_counts(t):
    return aggregates.reset_counts({"orders": t.orders, "lineitem": t.lineitem})


# ---- windows


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_occurrence(t):
    return windows.first_occurrence(t.documents.select("source", "doc_id"), ["source"], "doc_id")


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey")
def best_match(t):
    return windows.best_match(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_orderkey", "l_extendedprice", "l_linenumber")


@query("""WITH c AS (SELECT user_id, event_id, event_type = 'error' AS e, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS n_failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT user_id, event_id, CAST(n AS INTEGER) AS n, total, CAST(n_failed AS BIGINT) AS n_failed FROM c WHERE n = 1 OR n = total OR n % 25 = 0 OR e""")
def progress_checkpoints(t):
    return windows.progress_checkpoints(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error").drop("event_type")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type <> 'view' GROUP BY user_id")
def latest_event(t):
    return windows.latest_event(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_id", F.col("event_type") == "view")


@query("""WITH h AS (SELECT *, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS hit FROM lineitem)
  SELECT l_orderkey, count(*) AS tried, max(hit) AS success_pos, count(*) FILTER (l_returnflag <> 'R') AS n_failures FROM h WHERE hit IS NULL OR l_linenumber <= hit GROUP BY l_orderkey""")
def first_success(t):
    out = windows.first_success(t.lineitem, "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")
    return out.select("l_orderkey", "tried", "success_pos", F.size("failures").cast("long").alias("n_failures"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def cap_per_group(t):
    return windows.cap_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("WITH t AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC) AS l FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, l[1] AS best, round(l[1] - coalesce(l[2], 0), 2) AS margin FROM t")
def runner_up_margin(t):
    return windows.runner_up_margin(t.lineitem, "l_orderkey", "l_extendedprice").withColumn("margin", F.round("margin", 2))


@query()
def rate_limit(t):
    return windows.rate_limit(t.events, "user_id", "ts", "event_id", 5, 3600)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS in_window FROM events")
def rate_report(t):
    return windows.rate_report(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", 86400).select("event_id", "in_window")


@query("WITH r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 640) SELECT event_id, user_id FROM r WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 80")
def tail_events(t):
    return windows.tail_events(t.events.select("event_id", "user_id", "event_type"), "event_type", "purchase", "event_id").drop("event_type")


# ---- streams, in their batch form


@query(f"""SELECT count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY AND ts <= TIMESTAMP '{NOW}') AS n_3d, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{NOW}') AS n_6h,
  count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 90 MINUTE AND ts <= TIMESTAMP '{NOW}') AS n_90m FROM events""")
def rolling_counts(t):
    return streams.rolling_counts(t.events, "ts", now())


@query("SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1")
def cadence_counts(t):
    return streams.sliding_counts(t.events, "ts", "3 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
  h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM h GROUP BY user_id, k""")
def sessions(t):
    return streams.sessions(t.events, "user_id", "ts", "6 hours")


def as_job_events(t) -> DataFrame:
    """Events as a job log: the user is the job."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "running").otherwise("pending")
    return t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("job_id"), F.when(F.col("event_type") == "signup", "job_submitted").otherwise("progress").alias("event"), status.alias("status"))


JOB_EVENTS = "SELECT event_id, ts, CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status FROM events"


@query(f"SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (status = 'running') AS attempts, max(ts) AS updated FROM ({JOB_EVENTS}) GROUP BY job_id")
def job_status(t):
    return streams.job_status(as_job_events(t))


@query()
def latest_run(t):
    return streams.latest_run(as_job_events(t))


@query(f"SELECT ts < TIMESTAMP '{NOW}' - INTERVAL 3 DAY AS is_late, count(*) AS n FROM events GROUP BY 1")
def late_filter(t):
    return streams.late_filter(t.events, "ts", now()).groupBy("is_late").agg(F.count("*").alias("n"))


# ---- accuracy, metrics, geometry


@query("""WITH p AS (SELECT lang AS variant, CASE WHEN n_chars >= 250 THEN 'good' END AS p, CASE WHEN quality = 1 THEN 'good' END AS e FROM documents JOIN labels USING (doc_id))
  SELECT variant, count(*) AS total, count(*) FILTER (p IS NOT DISTINCT FROM e) AS correct, count(*) FILTER (p IS NULL AND e IS NOT NULL) AS false_negative, count(*) FILTER (p IS NOT NULL AND e IS NULL) AS false_positive,
  CAST(0 AS BIGINT) AS wrong, round(count(*) FILTER (p IS NOT DISTINCT FROM e) / count(*), 4) AS accuracy FROM p GROUP BY variant""")
def district_confusion(t):
    rows = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("variant"), F.when(F.col("n_chars") >= 250, "good").alias("predicted"), F.when(F.col("quality") == 1, "good").alias("expected"))
    return aggregates.district_confusion(rows)


@query("""SELECT count(*) FILTER (quality IS NOT NULL) AS n_quality, round(count(*) FILTER (quality = CASE WHEN n_chars >= 250 THEN 1 ELSE 0 END) / count(quality), 4) AS accuracy_quality FROM documents LEFT JOIN labels USING (doc_id)""")
def labelled_accuracy(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select((F.col("n_chars") >= 250).cast("int").alias("quality"), F.col("quality").alias("expected_quality"))
    return aggregates.labelled_accuracy(rows, ["quality"])


@query("""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, round(count(*) FILTER (event_type <> 'error') / count(*), 3) AS success_rate,
  round(count(*) FILTER (event_type = 'error') / count(*), 3) AS failure_rate, round(count(*) FILTER (event_type = 'view') / count(*), 3) AS cache_hit_rate FROM events""")
def geocode_metrics(t):
    return aggregates.geocode_metrics(t.events.select((F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("cached")))


@query("SELECT props AS failure_type, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY props ORDER BY n DESC, props LIMIT 5")
def top_failures(t):
    return aggregates.top_failures(t.events.filter("event_type = 'error'").withColumn("failure_type", F.col("props")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def fallback_hits(t):
    rows = t.events.select("event_id", F.col("user_id").alias("source"), F.col("event_type").alias("stage"), F.lit("x").alias("fallback"))
    return aggregates.fallback_hits(rows, "event_id").select("event_id", "n")


@query("""WITH d AS (SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS r, count(*) OVER () AS n, sum(value) OVER () AS s FROM events WHERE value > 0)
  SELECT round(1000.0 * max(n) / max(s), 2) AS average, round(1000.0 / max(v) FILTER (r = greatest(1, CAST(ceil(n / 100.0) AS BIGINT))), 2) AS low_1_percent FROM d""")
def tail_latency(t):
    return aggregates.tail_latency(t.events, "value")


POINTS = "SELECT 40.4 + (event_id % 700) / 1000.0 AS lat, 29.2 + (user_id % 1500) / 1000.0 AS lng FROM events"


@query(f"""WITH p AS (SELECT CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM ({POINTS})), m AS (SELECT radians(lng) * {__import__('math').cos(__import__('math').radians(40.75))!r} * 6371008.8 AS x, radians(lat) * 6371008.8 AS y FROM p),
  c AS (SELECT ({3**0.5 / 3!r} * x - y / 3) / 500.0 AS q, (2.0 / 3 * y) / 500.0 AS r FROM m), d AS (SELECT q, r, -q - r AS s, floor(q + 0.5) AS q0, floor(r + 0.5) AS r0, floor(-q - r + 0.5) AS s0 FROM c),
  e AS (SELECT *, abs(q0 - q) AS qd, abs(r0 - r) AS rd, abs(s0 - s) AS sd FROM d)
  SELECT CAST(CASE WHEN qd > rd AND qd > sd THEN -r0 - s0 ELSE q0 END AS BIGINT) AS q, CAST(CASE WHEN NOT (qd > rd AND qd > sd) AND rd > sd THEN -q0 - s0 ELSE r0 END AS BIGINT) AS r, count(*) AS n FROM e GROUP BY 1, 2""")
def hexbin(t):
    pts = t.events.select((40.4 + (F.col("event_id") % 700) / 1000.0).alias("lat"), (29.2 + (F.col("user_id") % 1500) / 1000.0).alias("lng"))
    return geo.hexbin(pts, "lat", "lng", 500.0, 40.75)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def weak_label_cap(t):
    return windows.cap_per_group(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 10)


DISTRICTS = ["that", "und", "les", "que"]


@query("""WITH d AS (SELECT doc_id, source, ' ' || regexp_replace(""" + FOLD_SQL.format("split_part(text, chr(10), 1)") + """, '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents),
  n AS (SELECT doc_id, source, list_filter([""" + ", ".join(f"'{d}'" for d in DISTRICTS) + """], lambda x: contains(t, ' ' || x || ' ')) AS named FROM d)
  SELECT source, doc_id, named[1] AS expected FROM n WHERE len(named) = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10""")
def weak_labels(t):
    docs = t.documents.select("source", "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return jobs.weak_labels(docs, DISTRICTS, "title", "source", "doc_id").select("source", "doc_id", "expected")


@query()
def ingest_documents(t):
    raw = tables.spread(t.documents).filter("text IS NOT NULL").select(
        F.col("doc_id").alias("raw_document_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("timestamp").alias("published_at"), F.array("source").alias("source_list"), F.lit("g1").alias("dataset_generation"),
    )
    return jobs.ingest(raw, t.spark.createDataFrame(KEYWORDS, "category string, keyword string"), ["function", "romance", "german", "phrase"])


from tidewell.plans import predicates, stored  # noqa: E402,F401  register their queries
