"""Worked cases of the operators that no registered query covers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, keys, scores, text
from tidewell.operators import dictionary, geo
from tidewell.plans import jobs
from tidewell.sources import pages, tables
from tidewell.streaming import events


def column(spark, c, rows, schema="s string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(c).collect()]


def now():
    return F.lit("2024-01-10 12:00:00").cast("timestamp")


# ---- sources


def test_reads(spark, tmp_path):
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert tables.read_pages(spark, str(tmp_path / "pages")).count() == 1
    (tmp_path / "flat.json").write_text(json.dumps([{"title": "a", "district": "x"}, {"title": "b", "district": None}]))
    (tmp_path / "deep.json").write_text(json.dumps({"version": 2, "reviewed_on": "2024-01-01", "samples": [{"title": "a", "district": "x"}]}))
    assert {r.title for r in tables.read_labelled(spark, str(tmp_path / "flat.json")).collect()} == {"a", "b"}
    deep = tables.read_labelled(spark, str(tmp_path / "deep.json")).first()
    assert (deep.version, deep.title, deep.district) == (2, "a", "x")
    assert tables.scan_records(spark, str(tmp_path / "pages"), ["url"]).columns == ["url"]
    sources = spark.createDataFrame([(1, "d", "n", "b", True), (2, "e", "m", "c", False)], "source_id int, domain string, display_name string, base_url string, active boolean")
    assert [r.source_id for r in tables.active_sources(sources).collect()] == [1]


def test_upserts_of_raw_documents_and_records(spark):
    raw = "source_id int, canonical_url string, dataset_generation string, scraped_at int, raw_document_id int, created_at int, v string"
    old = spark.createDataFrame([(1, "u", "g", 1, 1, 5, "a"), (1, "u", "h", 1, 2, 5, "b")], raw)
    new = spark.createDataFrame([(1, "u", "g", 2, 3, 9, "c"), (1, "u", "g", 3, 4, 9, "d"), (2, "u", "g", 1, 5, 9, "e")], raw)
    got = {(r.source_id, r.dataset_generation): (r.v, r.created_at, r.status) for r in tables.upsert_raw(old, new).collect()}
    assert got == {(1, "g"): ("d", 5, "updated"), (1, "h"): ("b", 5, "kept"), (2, "g"): ("e", 9, "inserted")}
    record = "raw_document_id int, updated_at int, created_at int"
    got = tables.upsert_records(spark.createDataFrame([(1, 1, 1)], record), spark.createDataFrame([(1, 2, 7), (2, 2, 7)], record))
    assert {tuple(r)[:3] for r in got.collect()} == {(1, 2, 1), (2, 2, 7)}


def test_logs_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab", "cde", "hash", 4)], "record_id int, title string, body string, provider string, latency_ms int")
    tables.embedding_log(rows, str(tmp_path / "log"))
    tables.embedding_log(rows, str(tmp_path / "log"))
    assert [(r.title_chars, r.body_chars) for r in spark.read.json(str(tmp_path / "log")).collect()] == [(2, 3)] * 2
    tables.report_json(rows, str(tmp_path / "report"))
    tables.report_json(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_requests(spark):
    schema = "url string, title string, content string, published_at_raw string, d timestamp"
    when = dt.datetime(2024, 1, 10, 11)
    rows = spark.createDataFrame([("https://www.a.com/x", "t", "c", None, when), ("https://b.com", " ", "c", None, when), ("https://a.com/z", "t", "c", None, when - dt.timedelta(9))], schema)
    sources = spark.createDataFrame([(7, "www.a.com", "A")], "source_id int, domain string, display_name string")
    got = {r.canonical_url: r for r in pages.build_request(rows, sources, "p1").collect()}
    one = got["https://www.a.com/x"]
    assert (one.source_id, one.source_name, one.parser_version, got["https://b.com"].source_id) == (7, "A", "p1", None)
    outcome = {r.url: r.outcome for r in pages.reject_incomplete(rows, F.col("d") >= now() - F.expr("INTERVAL 3 DAYS")).collect()}
    assert outcome == {"https://www.a.com/x": "ok", "https://b.com": "invalid_record", "https://a.com/z": "lookback_filtered"}


# ---- functions


def test_text_functions(spark):
    assert column(spark, text.strip_noise("s", ["subscribe now", r"ad \d+"]), ["Read SUBSCRIBE now  the ad 12 news", None]) == ["Read the news", None]
    assert column(spark, text.suffix_candidates("s"), ["Gebzedeki", " ev "]) == [["Gebzedeki", "Gebze"], ["ev"]]
    assert column(spark, text.normalize_place("s"), ["«Gebze'de»", "İzmitteki."]) == ["Gebze", "İzmit"]
    assert column(spark, text.embedded_district("s", ["İzmit", "Gebze"]), ["Gebze Sahil", "Sahil Gebze", "izmit x"]) == ["Gebze", None, "İzmit"]
    assert column(spark, text.extract_neighborhood("s", ["mahallesi", "mah."]), [" Yeni Mahallesi ", "Yeni mah.si", "Mahmut"]) == ["Yeni Mahallesi", "Yeni mah.si", None]
    assert column(spark, text.executive_summary("a", "b", 20), [("short", "One two. Three four five six."), ("s", "no end in these words at all")], "a string, b string") == ["One two.", "no end in these word…"]


def test_keys_and_dates(spark):
    assert column(spark, keys.clean_path("s"), ["https://a.com/ b / c", None]) == ["https://a.com/b/c", None]
    rows = [("https://x.com/a", ["y.com"], "https://z.com"), (None, ["http://y.com/q"], "https://z.com"), (None, None, "https://z.com/p"), (None, [], None)]
    assert column(spark, keys.source_domain("a", "b", "c"), rows, "a string, b array<string>, c string") == ["x.com", "y.com", "z.com", None]
    scraped = dt.datetime(2024, 1, 2)
    rows = [("2024-01-01T00:00:00Z", scraped), ("nonsense", scraped), (None, None)]
    got = column(spark, dates.published_or_fallback("a", "b", now()).cast("string"), rows, "a string, b timestamp")
    assert got[0].startswith("2024-01-01") and got[1] == str(scraped)[:19] and got[2] == "2024-01-10 12:00:00"


def test_hit_confidence(spark):
    conf = scores.hit_confidence("blob", "addr", "hint", "district", "kind", F.lit(None).cast("string"), "imp", ["region"], ["sokak"], ["street"], ["city"])
    rows = [
        ("yeni sokak izmit region", "Yeni Sokak", "Izmit", "Izmit", "street", "1.0"),  # .42 + .33 + .22 + .15 + .14 + .08, cut to 1
        ("other place", "Yeni Sokak", "Izmit", "Gebze", "city", None),  # -.14 - .08 - .30, cut to 0
        ("yeni yol", "Yeni Cadde", None, None, "x", "0.5"),  # .33 / 2 - .08 + .04
    ]
    assert column(spark, conf, rows, "blob string, addr string, hint string, district string, kind string, imp string") == [1.0, 0.0, 0.125]


# ---- dictionary and taggers


def test_district_recovery_and_taggers(spark):
    docs = spark.createDataFrame([(1, "İzmit'te"), (2, "Gebze yolu uzun"), (3, "Gebzeli"), (4, "gebze 41")], "id int, t string")
    got = {r.id: r.district for r in dictionary.recover_district(docs, ["İzmit", "Gebze"], "t", ["te", "de"], ["yolu"]).collect()}
    assert got == {1: "İzmit", 2: "Gebze", 3: None, 4: "Gebze"}
    rough = dictionary.heuristic_spans(spark.createDataFrame([(1, "Atatürk Caddesi ve Sahil Sokak")], "id int, t string"), "id", "t", ["caddesi", "sokak"], ["ve"])
    assert {r.span for r in rough.collect()} == {"ataturk caddesi", "sahil sokak"}
    known = dictionary.tag_known_places(spark.createDataFrame([(1, "Gebze'de İzmit ve gebze")], "id int, t string"), ["Gebze", "İzmit"], "id", "t")
    assert sorted(r.place for r in known.collect()) == ["Gebze", "gebze", "İzmit"]

    def tagger():
        return lambda t: [(w, "LOC", 0.9, t.index(w), t.index(w) + len(w)) for w in t.split() if w.istitle()]

    found = dictionary.tag_entities(spark.createDataFrame([(1, "at Gebze now"), (2, None)], "id int, t string"), tagger, "id", "t").collect()
    assert [(r.id, r.entity, r.start, r.end) for r in found] == [(1, "Gebze", 3, 8)]


# ---- events


def test_event_tails_and_active_jobs(spark):
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "heartbeat"), (3, "b", "x"), (4, "a", "y")], "event_id int, job_id string, event string")
    ids = lambda df: [r.event_id for r in df.orderBy("event_id").collect()]
    assert ids(events.stream_events(log)) == [1, 3, 4] and ids(events.stream_events(log, "a")) == [1, 4] and ids(events.stream_events(log, "a", 1)) == [4]
    at = lambda s: dt.datetime(2024, 1, 10, 12) - dt.timedelta(seconds=s)
    rows = [("r", "running", at(100), None, None), ("old", "running", at(500), None, None), ("p", "pending", None, None, at(10)), ("done", "completed", at(1), None, None)]
    table = spark.createDataFrame(rows, "job string, status string, heartbeat_at timestamp, started_at timestamp, created_at timestamp")
    assert {r.job for r in events.active_jobs(table, now()).collect()} == {"r", "p"}
    assert {r.job for r in events.active_jobs(table, now(), idle=600).collect()} == {"r", "p", "old"}


# ---- jobs


KEYWORDS, ORDER = [("fire", "yangin"), ("traffic", "kaza")], ["fire", "traffic"]
RAW = "raw_document_id long, title string, content string, published_at timestamp, source_list array<string>, dataset_generation string"


def test_materialize_with_places_and_vectors(spark):
    gazetteer = spark.createDataFrame([("Gebze", "Gebze", "district", "gebze"), ("Izmit", "Izmit", "district", "izmit"), ("Sahil Mahallesi", "Gebze", "neighborhood", "sahil mahallesi")], "canonical_name string, district string, feature_type string, alias string")
    rows = [(1, "Gebze'de yangin", "Sahil Mahallesi yandi", None, ["s"], "g"), (2, "Izmit haberi", "kaza oldu", None, ["s"], "g"), (3, "bos", "hicbir sey", None, ["s"], "g"), (4, None, None, None, None, "g")]
    raw, kw = spark.createDataFrame(rows, RAW), spark.createDataFrame(KEYWORDS, "category string, keyword string")
    exemplars = spark.createDataFrame([("fire", [1.0, 0.0]), ("sport", [0.0, 1.0])], "category string, vector array<double>")
    key = spark.range(1).select(keys.geo_query_key(F.lit("Gebze"), F.lit("Gebze"))).first()[0]
    points = spark.createDataFrame([(key, 1, 40.5, 29.5, 0.2), (key, 2, 40.8, 29.4, 0.9)], "key string, pos int, lat double, lng double, importance double")
    middles = spark.createDataFrame([("Izmit", 40.76, 29.92)], "district string, lat double, lng double")

    def sporty():
        return lambda t: [0.0, 1.0] if "bos" in t else 1 / 0 if "haberi" in t else [1.0, 0.0]

    out = {r.raw_document_id: r for r in jobs.materialize(raw, kw, ORDER, gazetteer, points, middles, exemplars, sporty, now()).collect()}
    assert (out[1].category, out[1].district) == ("fire", "Gebze") and out[1].geocode_status in ("resolved", "failed")
    assert (out[2].category, out[2].method, out[2].district, out[2].geocode_status, out[2].geocode_provider, out[2].lat) == ("traffic", "keyword_fallback_semantic_error", "Izmit", "approximate", "district_fallback", 40.76)
    assert (out[3].category, out[3].geocode_status, out[3].location_text, out[3].lat) == ("sport", "not_needed", None, None)
    assert out[4].category == "unknown" and out[4].body is None and len(out) == 4
    assert {str(r.published_at) for r in out.values()} == {"2024-01-10 12:00:00"}
    plain = jobs.materialize(raw, kw, ORDER)
    assert "district" not in plain.columns and {r.raw_document_id: r.category for r in plain.collect()} == {1: "fire", 2: "traffic", 3: "unknown", 4: "unknown"}


def test_ingest_merges_and_is_idempotent(spark):
    long = "red green blue black white amber olive ivory"
    rows = [(1, "first title", long, None, ["s1"], "g"), (2, "first title", long, None, ["s2"], "g"), (3, "other head", long + " extra", None, ["s3"], "g"), (5, "zzz qqq", "jjj kkk qqq zzz", None, ["s1"], "g")]
    kw = spark.createDataFrame([("colour", "red")], "category string, keyword string")
    stored, new = spark.createDataFrame(rows[:1], RAW), spark.createDataFrame(rows[1:], RAW)
    merged, status = jobs.ingest_records(stored, new, kw, ["colour"], ["colour"])
    got = {r.leader: (r.n, r.record_id, r.source_list, r.category) for r in merged.collect()}
    assert got[5] == (1, 5, ["s1"], "unknown") and got[1][0] == 3 and sorted(got[1][2]) == ["s1", "s2", "s3"] and got[1][3] == "colour"
    assert {r.status: r.n for r in status.collect()} == {"merged_hash": 1, "merged_lexical": 1, "inserted": 1}
    again, _ = jobs.ingest_records(spark.createDataFrame(rows, RAW), new, kw, ["colour"], ["colour"])
    assert {r.leader: (r.n, r.record_id, r.source_list, r.category) for r in again.collect()} == got


def test_reclassify_recompute_and_bootstrap(spark):
    kw = spark.createDataFrame(KEYWORDS, "category string, keyword string")
    rec = spark.createDataFrame([(1, "yangin", "x", "traffic"), (2, "a", "b", "fire")], "record_id int, title string, body string, category string")
    out, moves = jobs.reclassify(rec, kw, ORDER)
    assert {r.record_id: (r.old_category, r.category) for r in out.collect()} == {1: ("traffic", "fire"), 2: ("fire", "unknown")}
    assert {(r.old_category, r.new_category, r.n) for r in moves.collect()} == {("traffic", "fire", 1), ("fire", "unknown", 1)}
    records = spark.createDataFrame([(1, 10, "s", None, None, None), (2, 11, "s", None, None, None), (3, 12, "s", 1.0, 1.0, "resolved")], "record_id int, raw_document_id int, source_id string, lat double, lng double, geocode_status string")
    raw = spark.createDataFrame([(10, "s", "t")], "raw_document_id int, source_id string, title string")
    sources = spark.createDataFrame([("s", "d")], "source_id string, domain string")
    done, counts = jobs.recompute(records, raw, sources, "missing-point", {}, lambda df: df.withColumn("geocode_status", F.lit("resolved")))
    assert [r.record_id for r in done.collect()] == [1]
    assert {r.status: r.n for r in counts.collect()} == {"resolved": 1, "missing_parent": 1}
    empty = jobs.bootstrap({"a": rec, "b": rec.limit(0)})
    assert {k: v.count() for k, v in empty.items()} == {"a": 0, "b": 0}


def test_detail_and_geocode_job(spark):
    rows = [(1, None, "g", "a"), (2, 1, "g", "b"), (3, 1, "h", "c"), (4, None, "g", "d")]
    rec = spark.createDataFrame(rows, "record_id int, duplicate_of_record_id int, dataset_generation string, title string").withColumn("published_at", F.lit(None).cast("timestamp"))
    one = jobs.record_detail(rec, 1, ["record_id", "title"]).collect()
    assert [(r.record_id, [x.record_id for x in r.related]) for r in one] == [(1, [2])]
    assert jobs.record_detail(rec, 2, ["record_id"]).count() == 0 and jobs.record_detail(rec, 9, ["record_id"]).count() == 0
    cands = spark.createDataFrame([(1, 1, "Sahil", None, "Gebze"), (2, 1, "Uzak", None, None)], "id int, pos int, text string, neighborhood string, district string")
    keyed = {r.id: r.key for r in geo.geocode_inputs(cands, "id").collect()}
    places = spark.createDataFrame([(keyed[1], 1, 40.8, 29.4, 0.9), (keyed[1], 2, 41.0, 29.0, 0.1)], "key string, pos int, lat double, lng double, importance double")
    cache = spark.createDataFrame([(keyed[2], dt.datetime(2030, 1, 1), "resolved", 10.0, 10.0, 0.9, None)], "normalized_query string, expires_at timestamp, status string, lat double, lng double, confidence double, district string")
    got = {r.id: (r.status, r.failure_type, r.provider, r.lat) for r in jobs.geocode(cands, places, cache, "id", now(), (40.0, 41.5, 29.0, 31.0), F.col("importance")).collect()}
    assert got[1][0] == "resolved" and got[1][2:] == ("places", 40.8) and got[2][:3] == ("failed", "out_of_bounds", "cache")


def test_evaluation_report(spark):
    labels = spark.createDataFrame([(1, "x"), (2, None)], "id int, expected string")
    live = spark.createDataFrame([(["a"], ["a"]), (["b", "a"], ["a"])], "predicted array<string>, expected array<string>")
    logical = spark.createDataFrame([("s", "a", "s", "a"), ("s", "a", "t", "a")], "strategy string, address string, expected_strategy string, expected_address string")
    fields = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", None)], "district string, expected_district string")
    out = {(r.subject, r.measure): r.value for r in jobs.evaluation_report({"v": labels.select("id", F.lit("x").alias("predicted"))}, labels, "id", live, fields, None, logical).collect()}
    assert out["v", "accuracy"] == 0.5 and out["v", "false_positive"] == 1.0 and out["live", "exact"] == 0.5 and out["live", "contains"] == 1.0
    assert out["logical", "accuracy"] == 0.5 and out["fields", "n_district"] == 2.0 and out["fields", "accuracy_district"] == 0.5
    with pytest.raises(KeyError):
        out["duplicates", "accuracy"]


def test_words_of_a_gazetteer(spark):
    rows = [("Gebze", "Gebze", "district", "Gebze", True), ("Körfez", "Körfez", "district", "Körfez", True), ("Sahilkent", "Gebze", "neighborhood", "Sahilkent", True), ("Kartepe", None, "hill", "kartepe", False)]
    gazetteer = spark.createDataFrame(rows, "canonical_name string, district string, feature_type string, alias string, allow_fuzzy boolean")
    docs = spark.createDataFrame([(1, "Gebze'de körfez, Sahilkentde! Sahillkent (Kartep) GEBZE ab"), (2, "Körfezli yok"), (3, None)], "id int, t string")
    got = {(r.id, r.canonical_name): (r.pos, r.word, r.tier, r.score) for r in dictionary.link_words(docs, gazetteer, "id", "t", endings=["li"]).collect()}
    assert got == {(1, "Gebze"): (0, "Gebze'de", "exact", 1.0), (1, "Körfez"): (1, "körfez", "normalized", 0.95), (1, "Sahilkent"): (2, "Sahilkentde", "exact", 1.0), (2, "Körfez"): (0, "Körfezli", "morphology", 0.9)}
    words = spark.createDataFrame([("Sahillkent",), ("Kartepee",)], "word string")
    assert [(r.word, r.canonical_name, r.tier, round(r.score, 4)) for r in dictionary.match_words(words, gazetteer).collect()] == [("Sahillkent", "Sahilkent", "fuzzy", round(18 / 19, 4))]


def test_small_tables_only(spark):
    from tidewell.operators import classify

    with pytest.raises(ValueError):
        classify.small_table(spark.range(classify.SMALL_TABLE + 1))
    assert len(classify.small_table(spark.range(3))) == 3
