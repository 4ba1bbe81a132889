"""Event streams: tails, job states, windows, rate limits. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

TERMINAL = ("completed", "failed", "cancelled")
TAKES_OVER = ("running", *TERMINAL)


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_events(events: DataFrame, job: str | None = None, from_id=None, id_col: str = "event_id", kind: str = "event") -> DataFrame:
    """Events behind a cursor, of one job if given, without heartbeats. Batch or streaming."""
    rows = events.filter(F.col(kind) != "heartbeat")
    rows = rows if job is None else rows.filter(F.col("job_id") == job)
    return rows if from_id is None else rows.filter(F.col(id_col) > from_id)


def job_status(events: DataFrame) -> DataFrame:
    """(job_id, status, attempts, updated): the status of the last event; retries are counted starts."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status") == "running").alias("attempts"), F.max("ts").alias("updated")
    )


def active_jobs(jobs: DataFrame, now: Column, idle: int = 120, heartbeat: int = 30) -> DataFrame:
    """Pending or running jobs that are not stale: last activity within max(idle, 4 * heartbeat, 120) seconds."""
    last = F.coalesce("heartbeat_at", "started_at", "created_at")
    limit = max(idle, 4 * heartbeat, 120)
    return jobs.filter(F.col("status").isin("pending", "running") & (last >= now - F.expr(f"INTERVAL {limit} SECONDS"))).withColumn("last_activity", last)


def latest_run(events: DataFrame, most: int = 500) -> DataFrame:
    """(job_id, status, started, updated, event_count) of the run that the event log shows last; empty without events.

    The run changes hands at a job_submitted event, or when another job has a state of TAKES_OVER; other events of
    other jobs are ignored. So the holder is the job of the last such event, and its run starts at its last submission,
    or at its first such event after the last one of any other job: a few extreme values, no ordered pass.
    event_count counts all events of the run; `most` bounds those that latest_run_events() keeps.
    """
    rows = events.filter("job_id IS NOT NULL")
    taking = (F.col("event") == "job_submitted") | F.col("status").isin(*TAKES_OVER)
    first = rows.agg(F.min_by("job_id", "event_id").alias("job"), F.min("event_id").alias("id"), F.max_by(F.when(taking, F.col("job_id")), F.when(taking, F.col("event_id"))).alias("holder")).first()
    holder = first.holder or first.job
    mine = rows.filter(F.col("job_id") == F.lit(holder).cast(events.schema["job_id"].dataType))
    other = rows.filter(taking).agg(F.max(F.when(F.col("job_id") != holder, F.col("event_id")))).first()[0] if holder is not None else None
    after = F.lit(True) if other is None else F.col("event_id") > other
    marks = mine.agg(F.max(F.when((F.col("event") == "job_submitted") & after, F.col("event_id"))).alias("sent"), F.min(F.when(taking & after, F.col("event_id"))).alias("took")).first()
    start = marks.sent or (first.id if other is None and first.job == holder else marks.took)
    run = mine.filter(F.col("event_id") >= F.lit(start).cast("long"))
    return run.groupBy("job_id").agg(F.max_by("status", "event_id").alias("status"), F.min_by("ts", "event_id").alias("started"), F.max_by("ts", "event_id").alias("updated"), F.count("*").alias("event_count"))


def latest_run_events(events: DataFrame, most: int = 500) -> DataFrame:
    """The newest `most` events of the run that the log shows last."""
    run = latest_run(events).select("job_id", F.col("started").alias("_from"))
    return events.join(run, "job_id").filter(F.col("ts") >= F.col("_from")).drop("_from").orderBy(F.desc("event_id")).limit(most)


def step(run: tuple | None, ts, job, event, status) -> tuple | None:
    """One event of the state machine; run is (job, status, started, updated, number of events)."""
    if job is None:
        return run
    if run is None or event == "job_submitted" or (run[0] != job and status in TAKES_OVER):
        return (job, status, ts, ts, 1)
    return (job, status, run[2], ts, run[4] + 1) if run[0] == job else run


def rolling_counts(records: DataFrame, ts: str, now: Column) -> DataFrame:
    """Counts of the last 3 days, 6 hours and 90 minutes."""
    since = lambda span: F.count_if((F.col(ts) >= now - F.expr(f"INTERVAL {span}")) & (F.col(ts) <= now))
    return records.agg(since("3 DAYS").alias("n_3d"), since("6 HOURS").alias("n_6h"), since("90 MINUTES").alias("n_90m"))


def sliding_counts(records: DataFrame, ts: str, duration: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(window_start, n) per tumbling or sliding window; with late, a watermark bounds the state of a stream."""
    rows = records.withWatermark(ts, late) if late else records
    win = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return rows.groupBy(win.alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *(by or []), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "120 seconds", late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with gaps under `gap`."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def late_filter(df: DataFrame, ts: str, now: Column, days: int = 3) -> DataFrame:
    """df with is_late, so that late rows can be dropped and counted."""
    return df.withColumn("is_late", F.coalesce(F.col(ts) < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))


def ingest_stream(raw: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], created: str, buckets: int = 64):
    """Idempotent upserts from a stream into a BucketTable: each batch rewrites the buckets of its keys only.

    A repeated key refreshes its row; a batch that is replayed changes nothing.
    """
    from tidewell.sources.bucket_table import BucketTable

    def write(batch: DataFrame, number: int) -> None:
        BucketTable(batch.sparkSession, path, keys, buckets).upsert(batch, order, created, number)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_batch(batch: DataFrame, number: int, known: DataFrame, out_path: str, key: str, buckets: int = 64) -> None:
    """Write the rows of a batch whose key neither the known table nor an earlier batch has, one a key, to the batch's
    own folder. The keys written, with the number of their batch, are kept in a BucketTable beside it.

    A replayed batch replaces its folder with the same rows: keys that it wrote itself do not count as seen."""
    from tidewell.sources.bucket_table import BucketTable, bucket

    spark = batch.sparkSession
    # one row a key, the same one in a replay
    rest = [c for c in batch.columns if c != key]
    rows = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else batch.dropna(subset=[key]).distinct()
    fresh = rows.join(known.select(key), key, "left_anti")
    seen = BucketTable(spark, f"{out_path}/_seen", [key], buckets)
    touched = sorted(r[0] for r in fresh.select(bucket([key], seen.buckets)).distinct().collect())
    before = seen.read(touched)
    if before is not None:
        fresh = fresh.join(before.filter(F.col("first_batch") < number).select(key), key, "left_anti")
    home = f"{out_path}/batch={number}"
    fresh.select(*batch.columns).write.mode("overwrite").parquet(home)
    written = spark.read.schema(batch.schema).parquet(home).select(key, F.lit(number).cast("long").alias("first_batch"))
    seen.upsert(written, ["first_batch"], "first_batch")


def dedupe_stream(raw: DataFrame, known_path: str, out_path: str, checkpoint: str, key: str):
    """New rows whose key neither the stored table nor the stream has had, each exactly once, in folders by batch;
    rows without a key are left out. out_path is read as one table with the column batch."""

    def write(batch: DataFrame, number: int) -> None:
        dedupe_batch(batch, number, batch.sparkSession.read.parquet(known_path), out_path, key)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RateLimiter(StatefulProcessor):
    """Sliding window per client on a stream; the state is the accepted times inside the window."""

    def __init__(self, most: int = 5, seconds: int = 60):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", StructType([StructField("t", DoubleType())]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        recent = [x[0] for x in self.recent.get()]
        pdf = pd.concat(list(rows)).sort_values(["t", "request_id"], kind="stable")
        allowed = []
        for t in pdf["t"].tolist():
            recent = [x for x in recent if x > t - self.seconds]
            allowed.append(len(recent) < self.most)
            if allowed[-1]:
                recent.append(t)
        if recent:
            self.recent.put([(x,) for x in recent])
        else:
            self.recent.clear()
        yield pd.DataFrame({"client": key[0], "request_id": pdf["request_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """(client, request_id, allowed) of a stream requests(client, t seconds, request_id); needs the RocksDB state store."""
    schema = StructType([StructField("client", StringType()), StructField("request_id", LongType()), StructField("allowed", requests.sparkSession.range(0).selectExpr("true AS a").schema["a"].dataType)])
    return requests.groupBy("client").transformWithStateInPandas(RateLimiter(most, seconds), schema, "Append", "None")
