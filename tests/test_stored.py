"""Stored tables: manifests, bucketed upserts, bounded logs, exactly-once output, the text index."""

import os

import pytest

from tidewell.sources import tables
from tidewell.sources.bucket_table import BucketTable
from tidewell.sources.manifest import Conflict, Store
from tidewell.streaming import events

ROW = "k long, v string, at int, created_at int"


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_manifest_refuses_a_second_writer(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    assert one.latest() == (0, {})
    one.commit(0, {"folders": []})
    with pytest.raises(Conflict):
        two.commit(0, {"folders": ["x"]})
    assert two.latest() == (1, {"folders": []})


def test_small_batch_rewrites_one_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    table = BucketTable(spark, root, ["k"], 64)
    assert table.read() is None
    rows = [(i, "a", 1, 1) for i in range(2000)]
    assert table.upsert(spark.createDataFrame(rows, ROW), ["at"], "created_at", 0) == 64
    before = files(root)
    from tidewell.sources.bucket_table import bucket

    same = [r.k for r in spark.range(2000).toDF("k").filter(bucket(["k"], 64) == 5).limit(10).collect()]
    batch = spark.createDataFrame([(k, "b", 2, 9) for k in same], ROW)
    assert BucketTable(spark, root, ["k"]).upsert(batch, ["at"], "created_at", 1) == 1
    new = files(root) - before
    assert {f.split("_bucket=")[1].split("/")[0] for f in new} == {"5"}
    assert BucketTable(spark, root, ["k"]).upsert(batch.limit(3), ["at"], "created_at", 1) == 0  # a replay
    got = {r.k: (r.v, r.created_at) for r in BucketTable(spark, root, ["k"]).read().collect()}
    assert got == {i: ("b" if i in same else "a", 1) for i in range(2000)}


def test_table_drops_what_no_manifest_names(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(6):
        BucketTable(spark, root, ["k"], 4).upsert(spark.createDataFrame([(i, str(n), n, n) for i in range(40)], ROW), ["at"], "created_at", n)
    assert len([f for f in os.listdir(root) if f.startswith("rows-")]) == 2
    assert {(r.v, r.created_at) for r in BucketTable(spark, root, ["k"]).read().collect()} == {("5", 0)}
    assert BucketTable(spark, root, ["k"]).upsert(spark.createDataFrame([], ROW), ["at"], "created_at", 6) == 0


def test_log_stays_bounded(spark, tmp_path):
    schema = "timestamp int, event_id long"
    for n in range(60):
        got = tables.append_events(spark.createDataFrame([(n, 10 * n + i) for i in range(3)], schema).coalesce(1), str(tmp_path), 25)
    ids = [r.event_id for r in got.collect()]
    assert sorted(ids) == sorted(sorted((10 * n + i for n in range(60) for i in range(3)))[-25:])
    assert len([f for f in os.listdir(tmp_path) if f.startswith("segment-")]) <= 2 * tables.MANY_SEGMENTS
    stored = sum(spark.read.parquet(str(tmp_path / f)).count() for f in os.listdir(tmp_path) if f.startswith("segment-"))
    assert stored <= 4 * 25


def test_publish_keeps_two_generations(spark, tmp_path):
    root = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, root)
    first = tables.publish(spark.range(1), root, "g0")
    for n in range(1, 5):
        tables.publish(spark.range(n + 1), root, f"g{n}")
        assert tables.read_published(spark, root).count() == n + 1
    assert len(files(root)) > 0 and not os.path.exists(first) or not files(first)


def test_dedupe_writes_each_key_once(spark, tmp_path):
    out, known = str(tmp_path / "out"), spark.createDataFrame([(9,)], "k long")
    rows = lambda *keys: spark.createDataFrame([(k, f"{k}-{i}") for i, k in enumerate(keys)], "k long, v string")
    read = lambda: sorted((r.batch, r.k, r.v) for r in spark.read.parquet(out).collect())
    events.dedupe_batch(rows(1, 1, 2, 9, None), 0, known, out, "k")
    want = [(0, 1, "1-0"), (0, 2, "2-2")]
    assert read() == want
    events.dedupe_batch(rows(1, 1, 2, 9, None), 0, known, out, "k")  # replayed
    assert read() == want
    events.dedupe_batch(rows(2, 3), 1, known, out, "k")
    events.dedupe_batch(rows(2, 3), 1, known, out, "k")
    assert read() == [*want, (1, 3, "3-1")]
    events.dedupe_batch(rows(1, 9), 2, known, out, "k")
    assert read() == [*want, (1, 3, "3-1")]


def test_dedupe_stream(spark, tmp_path):
    spark.createDataFrame([(9,)], "k long").write.parquet(str(tmp_path / "known"))
    for keys in ((1, 2), (2, 3, 9)):
        spark.createDataFrame([(k, "x") for k in keys], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
        events.dedupe_stream(stream, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "ck"), "k").awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


# ---- text index


def loop_search(docs, query):
    import re

    from tidewell.operators.filters import search_terms

    terms, phrases, excluded = search_terms(query)
    out = {}
    for i, title, body in docs:
        t = [[w for w in re.split(r"[^\w]+", (x or "").lower()) if w] for x in (title, body)]
        runs = lambda p: any(f" {' '.join(re.findall(r'\w+', p))} " in f" {' '.join(x)} " for x in t)
        score = sum(weight * (w in x) for weight, x in zip((10, 1), t) for w in terms)
        if (score if terms else bool(phrases)) and all(map(runs, phrases)) and not any(w in x for x in t for w in excluded):
            out[i] = score
    return out


QUERIES = ["fire", "fire road", "fire fire", '"main street"', 'fire "main street"', "fire -road", '"a b a" -fire', "nothing", "-fire", "Fire, ROAD!", '"street main" road']


def test_index_equals_the_loop(spark, tmp_path):
    import random

    from tidewell.sources.text_index import TextIndex

    rng, words, schema = random.Random(1), ["fire", "Road", "main", "street", "a", "b", "main, street", "ü", ""], "id long, title string, body string"
    text = lambda n: rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, n)))])
    docs = {}
    for n in range(9):  # with FAN 4: merges into levels 1 and 2, later batches override earlier rows
        batch = {rng.randrange(60): (text(3), text(12)) for _ in range(25)}
        docs |= batch
        TextIndex(spark, str(tmp_path), "id", {"title": 10, "body": 1}, 8).add(spark.createDataFrame([(i, *x) for i, x in batch.items()], schema))
    index = TextIndex(spark, str(tmp_path), "id")
    assert [s["level"] for s in index.state["segments"]] == [1, 1, 0]
    gone = sorted(docs)[::5]
    index.remove(spark.createDataFrame([(i,) for i in gone], "id long"))
    docs = {i: x for i, x in docs.items() if i not in gone}
    for q in QUERIES:
        assert {r.id: r.score for r in TextIndex(spark, str(tmp_path), "id").search(q).collect()} == loop_search([(i, *x) for i, x in docs.items()], q), q


def test_search_reads_the_buckets_of_its_tokens(spark, tmp_path):
    from tidewell.sources.text_index import TextIndex

    index = TextIndex(spark, str(tmp_path), "id", {"body": 1}, 16)
    index.add(spark.range(300).selectExpr("id", "concat_ws(' ', 'w' || id % 50, 'x' || id % 7) AS body"))
    plan = index.search("w3 w4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(token, [w3,w4])" in plan
    assert index.search("w3").count() == 6
