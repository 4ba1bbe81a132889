"""The pipeline on the smallest tables: every stage keeps the columns, and its decisions hold in the result."""

import corpus_pipeline
from tidewell.llm import decontam, mixing, simhash


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    counts = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "simhash":
            groups = simhash.near_duplicates(docs)
            assert groups.select("group").distinct().count() == groups.count()
        if name == "decontamination":
            assert decontam.report(docs, items).filter("contaminated").count() == 0
        if name == "pii":
            assert docs.filter("text RLIKE '[a-z]@[a-z]+[.][a-z]'").count() == 0
            before = docs
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[1] < counts[0] and counts[2] < counts[1]
    rows = docs.collect()
    target = {r.source: (r.target, r.source_size) for r in rows}
    for source, (want, size) in target.items():
        taken = sum(r.taken for r in rows if r.source == source)
        assert abs(taken - want) <= max(r["size"] for r in rows if r.source == source)
        assert want <= mixing.CAP * size
    assert docs.count() == before.count()


def test_stages_with_awkward_rows(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(2**60 + 1, None, None, None, None), (2**60 + 2, "", "en", "s", 0), (None, "a text without an id", "en", "s", 1)] + [(2**60 + 3, "twice the same row", "en", "s", 1)] * 2, docs.schema)
    odd = odd.unionByName(spark.range(1).selectExpr(f"{2**60 + 4}L AS doc_id", "repeat('all work and no play ', 100000) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars"))
    names = ["score", "hits", "items", "base", "added", "fp", "n", "id", "group"]
    docs = docs.unionByName(odd).selectExpr("*", *(f"concat('own ', doc_id) AS `{c}`" for c in names))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert docs.filter("concat('own ', doc_id) <> hits OR score <> items").count() == 0
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert ids.count(2**60 + 3) == 1 and ids.count(2**60 + 4) == 1 and len(set(ids) & {2**60 + 1, 2**60 + 2}) == 1
