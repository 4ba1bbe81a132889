"""Reading record tables, and sinks: upserts, retention, rejected rows, seeds, logs and reports.

There is no table format here: an upsert returns the new table, and publish() writes it beside the old one and then
commits a manifest, so no job reads a path that it overwrites. bucket_table.py has the table that is upserted in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources.manifest import Store

#: Segments of a log after which they are written as one.
MANY_SEGMENTS = 20

def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than that; larger inputs stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Label sets in JSON: a flat array of rows, or {version, reviewed_on, samples: [...]}."""
    df = spark.read.json(path, multiLine=True)
    return df.select("version", "reviewed_on", F.inline("samples")) if "samples" in df.columns else df


def scan_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("active").select("source_id", "domain", "display_name", "base_url")


def last_wins(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the last; a max-by aggregate, which combines before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return rows.select(*keys, "_r.*").select(*batch.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], created: str | None = None) -> DataFrame:
    """target with batch rows written over equal keys; `created` keeps its first value. status tells what happened."""
    fresh = last_wins(batch, keys, order)
    old = target.select(*keys, *([F.col(created).alias("_created")] if created else []), F.lit(True).alias("_old"))
    joined = fresh.join(old, keys, "left")
    if created:
        joined = joined.withColumn(created, F.coalesce("_created", created)).drop("_created")
    written = joined.withColumn("status", F.when(F.col("_old"), "updated").otherwise("inserted")).drop("_old")
    kept = target.join(fresh.select(*keys), keys, "left_anti").withColumn("status", F.lit("kept"))
    return kept.unionByName(written)


def upsert_raw(target: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(target, batch, ["source_id", "canonical_url", "dataset_generation"], ["scraped_at", "raw_document_id"], "created_at")


def upsert_records(target: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(target, batch, ["raw_document_id"], ["updated_at"], "created_at")


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest n rows, as append logs keep them."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def append_events(df: DataFrame, path: str, most: int = 2000, order: tuple = ("timestamp", "event_id")) -> DataFrame:
    """Append to a log of numbered segments, and return its newest `most` rows.

    Segments that hold none of these go from the disk, and many small segments become one, so the folder stays small.
    """
    store = Store(df.sparkSession, path)
    number, state = store.latest()
    segments = [*state.get("segments", []), [f"segment-{uuid.uuid4().hex[:12]}", 0]]
    home = f"{store.root}/{segments[-1][0]}"
    df.write.parquet(home)
    segments[-1][1] = df.sparkSession.read.parquet(home).count()
    if len(segments) > MANY_SEGMENTS or sum(n for _, n in segments[1:]) >= most:
        name = f"segment-{uuid.uuid4().hex[:12]}"
        newest(read_log(df.sparkSession, store.root, segments), list(order), most).write.parquet(f"{store.root}/{name}")
        segments = [[name, df.sparkSession.read.parquet(f"{store.root}/{name}").count()]]
    store.commit(number, {"segments": segments, "folders": [f for f, _ in segments]})
    return newest(read_log(df.sparkSession, store.root, segments), list(order), most)


def read_log(spark: SparkSession, root: str, segments: list) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{f}" for f, _ in segments])


def dead_letter(df: DataFrame, error: str = "error", most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the newest rejected ones with error and attempt count."""
    return df.filter(F.col(error).isNull()), newest(df.filter(F.col(error).isNotNull()), ["failed_at", "attempt_count"], most)


def retry_split(queue: DataFrame, batch_size: int, max_retries: int) -> DataFrame:
    """queue(position, attempt_count, ok) with outcome: processed, requeued (attempt + 1), dead or waiting."""
    rank = F.row_number().over(Window.orderBy("position"))
    head = queue.orderBy("position").limit(batch_size).withColumn("_n", rank).drop("_n").withColumn("_in", F.lit(True)).select("position", "_in")
    rows = queue.join(head, "position", "left")
    again = F.col("attempt_count") + 1 < max_retries
    outcome = F.when(F.col("_in").isNull(), "waiting").when(F.col("ok"), "processed").when(again, "requeued").otherwise("dead")
    return rows.withColumn("outcome", outcome).withColumn("attempt_count", F.when(F.col("outcome").isin("requeued", "dead"), F.col("attempt_count") + 1).otherwise(F.col("attempt_count"))).drop("_in")


def retry_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("outcome").isin(*o)).alias(n) for n, o in {"dequeued": ("processed", "requeued", "dead"), "processed": ("processed",), "requeued": ("requeued",), "dead_lettered": ("dead",)}.items()])


def expire(df: DataFrame, column: str, now: Column, ttl: str | None = None) -> DataFrame:
    """Rows that have not expired; with ttl the column is a start, and null never expires."""
    end = F.col(column) if ttl is None else F.col(column) + F.expr(f"INTERVAL {ttl}")
    return df.filter(F.col(column).isNull() | (end > now))


def insert_if_absent(dim: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """dim with the seed rows whose key it lacks; rows that exist are untouched."""
    return dim.unionByName(seed.join(dim.select(key), key, "left_anti"), allowMissingColumns=True)


def missing_keys(dim: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.join(dim.select(key), key, "left_anti")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their violations."""
    rows = df.withColumn("violations", violations(rules))
    return rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)


def required(column: str) -> Column:
    return F.col(column).isNotNull()


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(values)


def in_range(column: str, low: float, high: float) -> Column:
    return F.col(column).isNull() | F.col(column).between(low, high)


def matches(column: str, pattern: str) -> Column:
    return F.col(column).isNull() | F.col(column).rlike(pattern)


def size_between(column: str, low: int, high: int) -> Column:
    return F.col(column).isNull() | F.size(column).between(low, high)


def embedding_log(df: DataFrame, path: str) -> None:
    """JSON lines with text lengths, provider and latency."""
    df.select("record_id", F.length("title").alias("title_chars"), F.length("body").alias("body_chars"), "provider", "latency_ms").write.mode("append").json(path)


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, root: str, generation: str, keep: int = 2) -> str:
    """Write a generation beside the others and make it the current one; the last `keep` stay readable.

    Returns the path of the rows."""
    store = Store(df.sparkSession, root)
    number, _ = store.latest()
    name = f"generation={generation}/{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{store.root}/{name}")
    store.commit(number, {"active_generation": generation, "folders": [name]}, keep)
    return f"{store.root}/{name}"


def read_published(spark: SparkSession, root: str) -> DataFrame:
    number, state = Store(spark, root).latest()
    if not number:
        raise FileNotFoundError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{state['folders'][0]}")


def drop_children(raw: DataFrame, records: DataFrame, stale: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw documents that stay, records that stay, and how many of both went."""
    gone = raw.filter(F.coalesce(stale, F.lit(False))).select("raw_document_id")
    dropped = records.join(gone, "raw_document_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("source_records").alias("table_name"), "n")
    counts = gone.agg(F.count("*").alias("n")).select(F.lit("raw_documents").alias("table_name"), "n").unionByName(dropped)
    return raw.filter(~F.coalesce(stale, F.lit(False))), records.join(gone, "raw_document_id", "left_anti"), counts


def recompute_inputs(records: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """records with raw document and source; has_raw and has_source tell what is missing."""
    r = raw.select("raw_document_id", "source_id", F.struct(*[c for c in raw.columns if c not in ("raw_document_id", "source_id")]).alias("raw"), F.lit(True).alias("_r"))
    s = sources.select("source_id", F.struct(*[c for c in sources.columns if c != "source_id"]).alias("source"), F.lit(True).alias("_s"))
    rows = records.join(r, "raw_document_id", "left").join(s, "source_id", "left")
    return rows.withColumns({"has_raw": F.col("_r").isNotNull(), "has_source": F.col("_s").isNotNull()}).drop("_r", "_s")


def with_related(records: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical records with the rows merged into them (same generation), newest first."""
    dup = records.filter("duplicate_of_record_id IS NOT NULL").groupBy("duplicate_of_record_id", "dataset_generation")
    many = dup.agg(F.sort_array(F.collect_list(F.struct("published_at", *[c for c in columns if c != "published_at"])), asc=False).alias("related"))
    many = many.withColumnsRenamed({"duplicate_of_record_id": "_of", "dataset_generation": "_generation"})
    on = (F.col("record_id") == F.col("_of")) & F.col("dataset_generation").eqNullSafe(F.col("_generation"))
    return records.filter("duplicate_of_record_id IS NULL").join(many, on, "left").drop("_of", "_generation")
