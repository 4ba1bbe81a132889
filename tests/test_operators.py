"""Operators that SQL does not express, against plain loops and worked cases."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregates, classify, dedup, dictionary, embed, filters, geo, sets, windows
from tidewell.plans import jobs
from tidewell.sources import pages, tables
from tidewell.sources.bucket_table import BucketTable
from tidewell.streaming import events


def test_filters_reject_unknown_values():
    with pytest.raises(ValueError):
        filters.by_values("c", ["nope"], ["a"])
    assert filters.split_values(["a, b", "A", ""]) == ["a", "b"]


def test_lexical_rule_with_ratio(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words[:12], k=3)), " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    got = {(r.a, r.b) for r in dedup.lexical_duplicates(docs, "id", "title", "body").collect()}
    want = set()
    for (i, t1, b1), (j, t2, b2) in itertools.combinations(rows, 2):
        x, y = set(b1.split()), set(b2.split())
        tx, ty = set(t1.split()), set(t2.split())
        body = round(len(x & y) / min(len(x), len(y)), 4)
        shared = len(tx & ty)
        title = round(max(difflib.SequenceMatcher(None, t1, t2).ratio(), shared / min(len(tx), len(ty))), 4)
        both = round(0.35 * title + 0.65 * body, 4)
        if body >= 0.9 or (body >= 0.72 and title >= 0.45 and shared >= 1) or (both >= 0.64 and shared >= 2):
            want.add((i, j))
    assert got == want and want


def test_semantic_default_threshold_and_blocks(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in base[i % 30]]) for i in range(90)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    one = {(r.a, r.b) for r in dedup.semantic_duplicates(df, "id", "v").collect()}
    many = {(r.a, r.b) for r in dedup.semantic_duplicates(df, "id", "v", block=10).collect()}
    hashed = {(r.a, r.b) for r in dedup.semantic_duplicates(df, "id", "v", planes=2).collect()}
    assert one == many and one and hashed <= one and len(hashed) >= 0.9 * len(one)


def test_leaders_equal_the_sequential_loop(spark):
    rng = random.Random(5)
    pairs = sorted({(a, b) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(60))})
    scored = [(a, b, rng.random()) for a, b in pairs]
    lead: dict[int, int] = {}
    for i in range(40):
        near = [(s, -a) for a, b, s in scored if b == i and lead[a] == a]
        lead[i] = -max(near)[1] if near else i
    got = dedup.leaders(spark.createDataFrame(scored, "a long, b long, score double"), spark.range(40), "id")
    assert {r.id: r.leader for r in got.collect()} == lead


def test_leaders_of_a_long_chain(spark):
    chain = spark.range(1, 150).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.lit(0.7).alias("score"))
    ids, tracker = spark.range(150), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.id: r.leader for r in dedup.leaders(chain, ids, "id").collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i - i % 2 for i in range(150)} and len(tracker.getJobIdsForGroup("chain")) < 10
    with pytest.raises(ValueError):
        dedup.leaders(spark.createDataFrame([(1, 1, 0.7)], "a long, b long, score double"), spark.range(3), "id")


def test_leaders_of_small_and_large_components(spark):
    rng = random.Random(9)
    pairs = {(a, a + 1) for a in range(30)} | {tuple(sorted(rng.sample(range(40, 200), 2))) for _ in range(110)}
    scored = [(a, b, rng.randint(0, 3) / 3) for a, b in sorted(pairs)]
    lead: dict[int, int] = {}
    for i in range(210):
        near = [(s, -a) for a, b, s in scored if b == i and lead[a] == a]
        lead[i] = -max(near)[1] if near else i
    df = spark.createDataFrame(scored, "a long, b long, score double")
    for bound in (200_000, 20, 0):
        assert {r.id: r.leader for r in dedup.leaders(df, spark.range(210), "id", bound).collect()} == lead


def test_components_of_chains_hubs_and_loops(spark):
    from tidewell.operators import components

    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(0, 2000)] + [(5000, 5000 + i) for i in range(700)] + [(9000, 9000)] + [tuple(rng.sample(range(10_000, 10_300), 2)) for _ in range(150)]
    rng.shuffle(edges)
    rounds, plain = [], components.star_round
    components.star_round = lambda e: (rounds.append(1), plain(e))[1]
    try:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        components.star_round = plain
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root} and len(rounds) < 15


def test_overlap_groups_of_a_long_chain(spark):
    pts = spark.range(2000).select("id", F.lit(0.0).alias("lat"), (F.col("id") * 0.0008).alias("lng"))
    assert geo.overlap_groups(pts, "id", "lat", "lng", 100.0).agg(F.max("group_id")).first()[0] == 0


def test_pivots_skip_pairs_and_lose_none(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    v = np.vstack([np.repeat(centres, 30, axis=0) + 0.1 * rng.normal(size=(1200, 8)), np.repeat(centres[:1], 100, axis=0), np.zeros((3, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    m = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(m @ m.T >= 0.95)) if i < j}
    for block in (2000, 50):
        assert {(r.a, r.b) for r in dedup.semantic_duplicates(df, "id", "v", 0.95, block=block).collect()} == want
    seen = dedup.pruning(df, "id", "v", 0.95, 30).first()
    assert seen.all_pairs == 1300 * 1299 // 2 and len(want) <= seen.compared < seen.all_pairs / 3
    found = {(r.a, r.b) for r in dedup.semantic_duplicates(df, "id", "v", 0.95, planes=6).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_order_statistic_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "LAST_VALUES", 10)
    monkeypatch.setattr(aggregates, "BINS", 7)
    rng = random.Random(2)
    for values in ([rng.random() for _ in range(500)], [1.0] * 300 + [2.0] * 5, [10.0**k for k in range(-20, 20)] * 3, [float(rng.randint(0, 3)) for _ in range(200)], [5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for rank in {1, 2, len(values) // 2 + 1, len(values)} - {0}:
            if rank <= len(values):
                assert aggregates.order_statistic(df, "v", rank) == sorted(values, reverse=True)[rank - 1]
        assert aggregates.order_statistic(df, "v", len(values) + 1) is None


def test_merge_gathers_no_bodies(spark):
    from tidewell.operators import merge

    rows = [("k", i, f"r{i}", c, f, [s], b, "", g, p, x, None, None) for i, (c, f, s, b, g, p, x) in enumerate([
        ("a", 0.5, "S", "x", "pending", None, None), ("a", 0.9, "s", "yy", "approximate", "x road", 1.0), ("b", 0.7, "T", "zz", "approximate", "y", 1.0), ("unknown", 0.99, " ", "z", "failed", "z", 2.0), ("a", 0.9, "t", "", None, None, None),
    ])] + [("one", 0, "q", None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, rank int, id string, category string, confidence double, source_list array<string>, body string, summary string, geocode_status string, location_text string, lat double, lng double, district string")
    out = merge.merge_groups(df, "key", "rank", "id", ["b", "a"])
    got = {r.key: r for r in out.collect()}
    k = got["k"]
    assert (k.n, k.id, k.category, k.confidence, k.source_list, k.body, k.geocode_status, k.location_text) == (5, "r0", "a", 0.9, ["S", "T"], "yy", "approximate", "x road")
    assert (got["one"].category, got["one"].confidence, got["one"].source_list, got["one"].body) == ("unknown", 0.0, [], "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(body" not in plan and "collect_list(struct(body" not in plan


def test_rate_limit_batch_equals_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 3)}", float(rng.randint(0, 400)), i) for i in range(300)]
    want, recent = {}, {}
    for c, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        recent[c] = [x for x in recent.get(c, []) if x > t - 60]
        want[i] = len(recent[c]) < 5
        if want[i]:
            recent[c].append(t)
    df = spark.createDataFrame(rows, "client string, t double, request_id long")
    batch = windows.rate_limit(df.withColumn("ts", F.timestamp_seconds("t")), "client", "ts", "request_id")
    assert {r.request_id: r.allowed for r in batch.collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.rate_limit_stream(events.read_event_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.request_id: r.allowed for r in spark.table("limited").collect()} == want


def test_latest_run_equals_the_state_machine(spark):
    rng = random.Random(7)
    for trial in range(6):
        rows = [(i, f"2024-01-01 00:00:{i:02d}", rng.choice(["a", "b", "c", None]), rng.choice(["progress"] * 5 + ["job_submitted"]), rng.choice(["pending", "pending", "running", "failed"])) for i in range(rng.choice([1, 8, 40]))]
        df = spark.createDataFrame(rows, "event_id long, ts string, job_id string, event string, status string").withColumn("ts", F.to_timestamp("ts"))
        run = None
        for i, ts, job, event, status in rows:
            run = events.step(run, ts, job, event, status)
        got = [(r.job_id, r.status, str(r.started), str(r.updated), r.event_count) for r in events.latest_run(df).collect()]
        assert got == ([run] if run else []), trial


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00",) for h in range(6) for m in (0, 10, 50)]
    df = spark.createDataFrame(rows, "ts string").select(F.to_timestamp("ts").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.sliding_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "3 hours", late="1 day")
    q = stream.writeStream.format("memory").queryName("cadence").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cadence").collect())) == sorted(map(tuple, events.sliding_counts(df, "ts", "3 hours").collect()))


def test_ingest_stream_refreshes_keys(spark, tmp_path):
    schema = "k string, v int, at int, created_at int"
    spark.createDataFrame([("a", 1, 1, 10), ("b", 2, 1, 10)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "table")
    go = lambda: events.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "ck"), ["k"], ["at"], "created_at").awaitTermination(120)
    go()
    spark.createDataFrame([("a", 5, 2, 99)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(map(tuple, BucketTable(spark, root, ["k"]).read().select("k", "v", "created_at").collect())) == [("a", 5, 10), ("b", 2, 10)]


def test_overlap_groups(spark):
    rng = random.Random(8)
    pts = [(i, rng.uniform(0, 0.01), rng.uniform(0, 0.01)) for i in range(120)]
    got = {r.id: r.group_id for r in geo.overlap_groups(spark.createDataFrame(pts, "id long, lat double, lng double"), "id", "lat", "lng", 80.0).collect()}
    import math

    xy = {i: (math.radians(b) * geo.EARTH, math.radians(a) * geo.EARTH) for i, a, b in pts}
    group = {i: i for i in xy}
    for _ in xy:
        for a, b in itertools.combinations(xy, 2):
            if math.dist(xy[a], xy[b]) < 80.0:
                group[a] = group[b] = min(group[a], group[b])
    assert got == group and len(set(group.values())) > 1


def test_resolver_rules(spark):
    order = ["fire", "theft"]
    cases = {
        (None, 0.0, "fire", 0.4): ("fire", "semantic"), ("fire", 0.5, "fire", 0.6): ("fire", "resolver_agree"), ("fire", 0.5, "unknown", 0.6): ("unknown", "resolver_semantic_unknown"),
        ("fire", 0.7, "unknown", 0.6): ("fire", "resolver_keyword"), ("unknown", 0.7, "fire", 0.1): ("fire", "resolver_semantic"), ("theft", 0.5, "fire", 0.7): ("fire", "resolver_semantic"),
        ("theft", 0.8, "fire", 0.6): ("theft", "resolver_keyword"), ("theft", 0.6, "fire", 0.6): ("fire", "resolver_priority"), ("theft", 0.6, "fire", 0.69): ("fire", "resolver_semantic"),
    }
    df = spark.createDataFrame(list(cases), "kw_category string, kw_confidence double, sem_category string, sem_confidence double")
    got = {(r.kw_category, r.kw_confidence, r.sem_category, r.sem_confidence): (r.category, r.method) for r in classify.resolve_category(df, order).collect()}
    assert got == cases


def test_keywords_with_endings(spark):
    docs = spark.createDataFrame([(1, "yangında büyük yangin"), (2, "yang ve yangınlar"), (3, "kapı")], "id long, t string")
    kw = spark.createDataFrame([("fire", "yangın"), ("door", "kap")], "category string, keyword string")
    got = {(r.id, r.category) for r in dictionary.match_keywords(docs, kw, "id", {"t": 1.0}, ["da", "lar", "i"]).collect()}
    assert got == {(1, "fire"), (2, "fire")}


def test_fuzzy_alias(spark):
    words = spark.createDataFrame([("basiskelle",), ("basiskele",), ("derince",), ("derin",)], "word string")
    aliases = spark.createDataFrame([("basiskele",), ("derince",)], "alias string")
    assert {(r.word, r.alias) for r in dictionary.fuzzy_alias_join(words, aliases).collect()} == {("basiskelle", "basiskele")}


def test_page_job(spark):
    html = '<html><head><title>T</title></head><body><article><h1>Head</h1><p>First <b>one</b>.<p>Second&amp;</article><a href="/a#x">l</a><a href="/a">m</a><a href="mailto:x">n</a></body></html>'
    df = spark.createDataFrame([(1, "https://s.com/x", html), (2, "https://s.com/y", None)], "page_id long, url string, html string")
    art = {r.page_id: (r.title, r.content) for r in pages.extract_articles(df).collect()}
    assert art == {1: ("Head", "First one.\nSecond&"), 2: (None, None)}
    assert [(r.url, r.pos) for r in pages.extract_links(df).collect()] == [("https://s.com/a", 1)]
    assert [r[0] for r in df.orderBy("page_id").select(pages.is_blocked("html")).collect()] == [False, True]
    rows = spark.createDataFrame([(1, 0, "A long enough paragraph here", "T"), (1, 1, "short", "T"), (1, 2, "Share this article with friends", "T"), (1, 3, "Another long enough paragraph", "T")], "page_id long, pos int, text string, title string")
    assert pages.select_paragraphs(rows, ["share this"]).first().content == "A long enough paragraph here"


def test_all_paragraphs_of_a_page(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    from tidewell.plans import registry

    long = "A long enough paragraph of the page"
    html = [
        f"<title>Fish &amp; chips in the old harbour</title><p>Fish &amp; chips in the OLD harbour</p><p>{long} by Smith &amp; Sons</p><p>short &amp;</p><p><b>{long}</b> at a?b=1&amp;c=2</p><p>x The and attion to thanedble, y</p><p>{long} behind the stop</p>",
        f"<title>T</title><p>{long}</p><p>&quot;AT&amp;T&quot; said &lt;nothing&gt; at all</p>",
        "<p>The and attion to thanedble at once</p><p>" + long + "</p>",
        None,
    ]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    digest = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    got = {r.page_id: r.content_sha for r in registry.queries()["select_all_paragraphs"](spark, str(tmp_path)).collect()}
    assert got == {0: digest(f"{long} by Smith & Sons", f"{long} at a?b=1&c=2"), 1: digest(long, '"AT&T" said <nothing> at all')}

    folder = "/root/testdata/sf0.001"
    signs = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))

    def plain(raw):
        raw = re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ", raw))
        for name, sign in signs:
            raw = raw.replace(name, sign)
        return " ".join(raw.split())

    def folded(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        return " ".join(re.sub("['’]", "", s).lower().replace("-", " ").split())

    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        title, lines = plain("".join(re.findall(r"(?is)<title>(.*?)</title>", r.html or "")[:1])), []
        for line in map(plain, re.findall(r"(?s)<p>(.*?)</p>", r.html or "")):
            if registry.STOP_PHRASES[0] in folded(line):
                break
            if len(line) >= 20 and folded(line) != folded(title):
                lines.append(line)
        if lines:
            want[r.page_id] = digest(*lines)
    got = {r.page_id: r.content_sha for r in registry.queries()["select_all_paragraphs"](spark, folder).collect()}
    assert got == want and len(want) > 10


def test_dictionary_tiers_and_weak_labels(spark, tmp_path):
    from tidewell.functions.text import CASE_SUFFIXES
    from tidewell.plans import registry

    rng = random.Random(12)
    base = ["alfa", "bravo", "delta", "gamma"]
    endings = [e for e in CASE_SUFFIXES if e.isascii()]
    word = lambda: rng.choice(base) + (rng.choice(endings) if rng.random() < 0.4 else "")
    items = [(k, " ".join(rng.choices(base, k=3)) + " tail") for k in range(12)]
    texts = [rng.choice(["alfa", "und", "que und", "x THAT-y", "les"]) + "\n" + " ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, t, f"s{i % 2}", len(t)) for i, t in enumerate(texts)] + [(98, None, "s0", 0), (99, "", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def strip(s):
        for e in CASE_SUFFIXES:
            if s.endswith(e) and len(s) > len(e) + 2:
                return s[: -len(e)]
        return s

    want = set()
    for i, text, *_ in rows:
        w = (text or "").lower().replace("-", " ").split()
        for n, p, (k, item) in itertools.product((1, 2, 3), range(len(w)), items):
            span, alias = " ".join(w[p : p + n]), " ".join(item.split()[:3])
            if p + n <= len(w) and alias in (span, strip(span)):
                want.add((i, p + 1, span, k, *((1.0, "exact") if span == alias else (0.9, "suffix"))))
    got = registry.queries()["link_dictionary_tiers"](spark, str(tmp_path)).select("doc_id", "pos", "span", "canonical_name", "score", "tier").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.tier for r in got} == {"exact", "suffix"}

    want, seen = [], {}
    for i, text, source, _ in rows:
        title = (text or "").split("\n")[0].lower().replace("-", " ").split()
        named = [d for d in registry.DISTRICTS if d in title]
        if len(named) == 1 and seen.setdefault(source, 0) < 10:
            seen[source] += 1
            want.append((source, i, named[0]))
    assert sorted(map(tuple, registry.queries()["weak_labels"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 10


def test_candidates_and_precedence(spark):
    rows = [(1, "Merkez", "A", False), (1, "Merkez", "B", True), (2, "Yeni", "A", False), (2, "Yeni", "B", False)]
    got = sets.suppress_ambiguous(spark.createDataFrame(rows, "doc long, name string, district string, explicit boolean"))
    assert {(r.doc, r.district) for r in got.collect()} == {(1, "B"), (2, "A"), (2, "B")}
    cands = spark.createDataFrame([(1, "A", None), (1, "B", None), (2, "A", None), (2, "B", "n")], "doc long, district string, neighborhood string")
    rules = spark.createDataFrame([("A", "B")], "preferred string, shadowed string")
    assert {(r.doc, r.district) for r in sets.apply_precedence(cands, rules).collect()} == {(1, "A"), (2, "A"), (2, "B")}


def test_publish_gate_reasons(spark):
    schema = "status string, skip_reason string"
    cases = {
        (): "no_active_sources", (("success", None), (None, "robots")): "refresh_skipped_sources_present", ((None, "locked"),): "no_refresh_eligible_sources",
        (("success", None), (None, None)): "refresh_source_count_mismatch", (("success", None), ("partial", None)): "refresh_not_fully_successful", (("success", None), (None, "locked")): None,
    }
    for rows, reason in cases.items():
        assert aggregates.publish_gate(spark.createDataFrame(list(rows), schema), ["locked"]).first().reason == reason


def test_publish_and_refresh(spark, tmp_path):
    root = str(tmp_path / "gen")
    ok = spark.createDataFrame([("success", None)], "status string, skip_reason string")
    assert jobs.refresh(spark.range(3), ok, root, "g1", []) is None
    assert tables.read_published(spark, root).count() == 3
    bad = spark.createDataFrame([("failed", None)], "status string, skip_reason string")
    assert jobs.refresh(spark.range(9), bad, root, "g2", []) == "refresh_not_fully_successful"
    assert tables.read_published(spark, root).count() == 3


def test_geocode_status(spark):
    rows = [(40.5, 29.5, 0.9, False), (40.5, 29.5, 0.5, False), (50.0, 29.5, 0.9, False), (None, None, None, False)]
    got = geo.geocode_status(spark.createDataFrame(rows, "lat double, lng double, confidence double, is_district boolean"), (40.35, 41.15, 29.10, 30.90))
    assert [(r.status, r.failure_type) for r in got.collect()] == [("resolved", None), ("approximate", None), ("failed", "out_of_bounds"), ("failed", "no_result")]


def test_hash_embedder_and_failures(spark):
    import hashlib

    import numpy as np

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "")], "id long, s string")
    got = {r.id: r.v for r in rows.select("id", embed.embed("s").alias("v")).collect()}
    first = hashlib.sha256(b"text:a").digest()
    want = np.array(list(first + hashlib.sha256(first).digest())) / 127.5 - 1
    assert got[2] is None and len(got[1]) == len(got[4]) == 1024
    assert np.allclose(np.array(got[1][:64]) * want[0] / got[1][0], want, atol=1e-5) and abs(np.linalg.norm(got[1]) - 1) < 1e-5

    def picky():
        return lambda t: 1 / 0 if t == "bad" else [3.0, 4.0]

    got = {r.id: r.v for r in rows.select("id", embed.embed("s", picky).alias("v")).collect()}
    assert got[3] is None and np.allclose(got[1], [0.6, 0.8])

    def broken():
        raise RuntimeError("no model")

    assert len(rows.select(embed.embed("s", broken, fall_back=True).alias("v")).first().v) == 1024
    with pytest.raises(Exception, match="no model"):
        rows.select(embed.embed("s", broken).alias("v")).collect()


def test_classifier_chain(spark):
    order = ["fire", "theft"]
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, None), (5, [1.0, 1.0])], "id long, v array<double>")
    keyword = spark.createDataFrame([(1, "fire", 0.5), (3, "theft", 0.6)], "id long, category string, confidence double")
    exemplars = spark.createDataFrame([("fire", [1.0, 0.0]), ("fire", [1.0, 0.1]), ("theft", [0.0, 1.0])], "category string, vector array<double>")
    semantic = classify.semantic_classify(rows, exemplars, "id", "v")
    got = {r.id: (r.category, r.method) for r in classify.classify_chain(rows, keyword, semantic, "id", order).collect()}
    assert got == {1: ("fire", "resolver_agree"), 2: ("theft", "semantic"), 3: ("theft", "keyword_fallback_semantic_error"), 4: ("unknown", "semantic_error_unknown"), 5: ("unknown", "semantic")}
    got = {r.id: (r.category, r.confidence, r.method) for r in classify.classify_chain(rows, keyword, None, "id", order).collect()}
    assert got[1] == ("fire", 0.5, "keyword") and got[2] == ("unknown", 0.0, "keyword_only") and len(got) == 5


def test_logical_accuracy(spark):
    cases = [("a", "x", "a", "x"), ("a", "x", "a", "y"), (None, None, None, None), (None, "x", "a", "x")]
    assert tuple(aggregates.logical_accuracy(spark.createDataFrame(cases, "strategy string, address string, expected_strategy string, expected_address string")).first()) == (4, 2, 0.5)
    assert tuple(aggregates.logical_accuracy(spark.createDataFrame([], "strategy string, address string, expected_strategy string, expected_address string")).first()) == (0, 0, 0.0)


def test_ingest_reaches_every_tier(spark):
    long = "red green blue black white amber olive ivory"
    rows = [
        (1, "first title", long, ["s1"]), (2, "first title", long, ["s2"]), (3, "other head", long + " extra", ["s3"]), (4, "first title", " ".join(w[::-1] for w in long.split()), ["s1"]),
        (5, "zzz qqq", "jjj kkk qqq zzz xxx www", ["s1"]), (6, "same outlet", long + " words", ["s1"]),
    ]
    raw = spark.createDataFrame([(i, t, c, None, s, "g") for i, t, c, s in rows], "raw_document_id long, title string, content string, published_at timestamp, source_list array<string>, dataset_generation string")
    keywords = spark.createDataFrame([("colour", "red")], "category string, keyword string")

    def letters():
        return lambda t: [t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"]

    run = lambda **kw: {r.record_id: (r.leader, r.tier) for r in jobs.ingest(raw, keywords, ["colour"], **kw).collect()}
    cheap = {1: (1, "new"), 2: (1, "hash"), 3: (1, "lexical"), 4: (4, "new"), 5: (5, "new"), 6: (6, "new")}
    assert run() == cheap
    assert run(make_embedder=letters) == cheap | {4: (1, "semantic"), 6: (1, "semantic")}


def shuffles_of(df, scan: str = "Range (0, 200") -> int:
    """Shuffles in the plan of df through which the rows of a scan pass."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    most = 0
    for i in (i for i, x in enumerate(lines) if scan in x):
        at, n = depth[i], 0
        for j in range(i, -1, -1):
            if depth[j] < at:
                at, n = depth[j], n + (lines[j].lstrip(" :+-").startswith("Exchange "))
        most = max(most, n)
    return most


def test_linking_leaves_the_documents_where_they_are(spark):
    docs = spark.range(200).withColumn("t", F.concat(F.lit("Sahil Yolu'nda, sahilde ve oʼbrien oʼya "), "id"))
    rows = [("A", "x", "sahil yolu"), ("B", "x", "Sahil"), ("C", None, "sahil yolunda"), ("D", None, "oʼbrien"), ("D", None, "o"), ("E", "x", "yok")]
    linked = dictionary.link_dictionary(docs, spark.createDataFrame(rows, "canonical_name string, district string, alias string"), "id", "t")
    assert shuffles_of(linked) == 0
    got = sorted((r.pos, r.span, r.canonical_name, r.tier) for r in linked.filter("id = 7").collect())
    assert got == [(1, "sahil", "B", "exact"), (1, "sahil yolunda", "A", "suffix"), (1, "sahil yolunda", "C", "exact"), (3, "sahilde", "B", "suffix"), (5, "oʼbrien", "D", "exact"), (6, "oʼya", "D", "suffix")]
    assert linked.count() == 1200


def test_venues_leave_the_documents_where_they_are(spark):
    docs = spark.range(200).select((F.col("id") * 2).alias("id"), F.concat(F.lit("Sahil Yolu ve Park "), "id").alias("t"))
    venues = spark.createDataFrame([("a", "park", 2), ("b", "sahil yolu", 1), ("c", "parkta", 0)], "venue string, alias string, priority int")
    got = dictionary.match_named_venue(docs, venues, "id", "t")
    assert shuffles_of(got) == 1  # of one row a document
    assert {r.venue for r in got.collect()} == {"b"}


def moved_columns(df) -> str:
    """What the shuffles and broadcasts of df's plan take in."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    parts = out.getvalue().split("\n\n")
    return "\n".join(p for p in parts if p.lstrip().split("\n")[0].endswith("Exchange"))


def test_keywords_shuffle_one_row_a_document_and_keyword(spark):
    docs = spark.range(200).select((F.col("id") * 2).alias("id"), F.lit("Sahilde park park, ve kıyı yolu").alias("t"), F.lit("Park").alias("u"))
    kw = spark.createDataFrame([("a", "sahil"), ("a", "park"), ("b", "kıyı yolu"), ("b", "yol")], "category string, keyword string")
    got = dictionary.match_keywords(docs, kw, "id", {"t": 1.0, "u": 3.0}, ["de"])
    assert shuffles_of(got) == 1 and not any(x in moved_columns(got) for x in ("run#", "r0"))
    assert {(r.category, r.keyword, r.score) for r in got.collect()} == {("a", "sahil", 1.0), ("a", "park", 4.0), ("b", "kiyi yolu", 1.0)} and got.count() == 600


def test_reclassified_records_shuffle_no_tokens(spark):
    records = spark.range(200).select(F.col("id").alias("record_id"), F.lit("Park").alias("title"), F.lit("sahil yolu").alias("body"), F.lit("old").alias("category"))
    counts = jobs.reclassify(records, spark.createDataFrame([("a", "sahil"), ("b", "park")], "category string, keyword string"), ["a", "b"])[1]
    assert not any(x in moved_columns(counts) for x in ("token", "run#", "r0", "body"))
    assert [(r.old_category, r.new_category, r.n) for r in counts.collect()] == [("old", "b", 200)]


def test_context_rule_moves_no_texts(spark):
    docs = spark.createDataFrame([(1, "the cat was"), (2, "the dog"), (3, "und"), (4, None)], "id long, t string")
    weak = spark.createDataFrame([("e", "the", ["was", "they", None])], "category string, keyword string, hints array<string>")
    matches = spark.createDataFrame([(1, "e", "the", 1.0), (2, "e", "the", 1.0), (3, "g", "und", 1.0), (4, "g", "und", 1.0), (4, "e", "the", 1.0), (9, "g", "und", 1.0)], "id long, category string, keyword string, score double")
    got = dictionary.context_rule(matches, weak, docs, "id", "t")
    assert "id" in moved_columns(got) and "_text" not in moved_columns(got)
    assert sorted((r.id, r.keyword) for r in got.collect()) == [(1, "the"), (3, "und"), (4, "und")]


def test_vectors_are_not_copied_for_every_pair_of_blocks(spark):
    rng = random.Random(5)
    rows = [(f"r{i:02}", [rng.choice((-1.0, 1.0)) for _ in range(6)]) for i in range(90)]
    found = dedup.semantic_duplicates(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 0.6, block=10)
    assert "v#" not in moved_columns(found)
    want = {(a, b) for (a, v), (b, w) in itertools.combinations(rows, 2) if sum(x * y for x, y in zip(v, w)) / 6 >= 0.6}
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)


def test_lexical_candidates_are_not_shuffled_and_blocks_lose_none(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words[:9], k=3)), " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(120)]
    docs = spark.createDataFrame([*rows, *((200 + i, t, b) for i, t, b in rows[:20])], "id long, title string, body string")
    one = dedup.lexical_duplicates(docs, "id", "title", "body", with_ratio=False)
    assert "_t#" not in moved_columns(one)  # token sets of candidates
    monkeypatch.setattr(dedup, "BLOCK_SETS", 9)
    many = dedup.lexical_duplicates(docs, "id", "title", "body", with_ratio=False)
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, one.collect())) and len(got) > 40 and {(i, 200 + i) for i in range(20)} <= {(a, b) for a, b, *_ in got}
    sets = [(i, set(t.split()), set(b.split())) for i, t, b in rows]
    want = set()
    for (a, t, b), (c, u, d) in itertools.combinations(sets, 2):
        body, title, both = len(b & d) / min(len(b), len(d)), len(t & u) / min(len(t), len(u)), len(t & u)
        if body >= 0.9 or (body >= 0.72 and title >= 0.45 and both) or (0.35 * round(title, 4) + 0.65 * round(body, 4) >= 0.64 and both > 1):
            want.add((a, c))
    assert {(a, b) for a, b, *_ in got if b < 200} == want


def test_ratio_is_not_taken_where_it_can_not_decide(spark):
    rows = [("sahil yolu", "sahil yolunda", 0.6), ("sahil", "park yeri", 0.6), ("sahil", "park yeri", 0.0), (None, "", 0.9)]
    got = spark.createDataFrame(rows, "a string, b string, least double").select(dictionary.sequence_ratio(F.col("a"), F.col("b"), F.col("least")).alias("r")).collect()
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert [r.r for r in got] == [ratio("sahil yolu", "sahil yolunda"), 0.0, ratio("sahil", "park yeri"), 1.0]
