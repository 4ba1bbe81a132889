"""Window operators, top-k and paging. Every order ends with an id, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import geocode_rank


def canonical_rank(df: DataFrame, key: str = "dedupe_hash", id_col: str = "record_id") -> DataFrame:
    """canonical_rank 1 is the record that its hash group merges into."""
    order = [
        geocode_rank("geocode_status").desc(),
        (F.coalesce(F.col("category"), F.lit("unknown")) != "unknown").desc(),
        F.size(F.coalesce("source_list", F.array())).desc(),
        F.length(F.coalesce("body", F.lit(""))).desc(),
        F.col("published_at").desc_nulls_last(),
        F.col(id_col),
    ]
    return df.withColumn("canonical_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def first_occurrence(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """One row per key, that with the least pos: a min-by aggregate, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    rows = df.groupBy(*key).agg(F.min_by(F.struct(*rest), pos).alias("_r"))
    return rows.select(*key, "_r.*").select(*df.columns)


def best_match(pairs: DataFrame, id_col: str, score: str, arrival: str) -> DataFrame:
    """The best scoring candidate of each row; of equal scores the earliest."""
    rest = [c for c in pairs.columns if c != id_col]
    rows = pairs.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(arrival))).alias("_r"))
    return rows.select(id_col, "_r.*")


def progress_checkpoints(outcomes: DataFrame, source: str, pos: str, failed: Column, every: int = 25) -> DataFrame:
    """Errors, the first, the last and every so many rows of a source, with running counts."""
    w = Window.partitionBy(source).orderBy(pos)
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(source)
    rows = outcomes.withColumns(
        {"n": F.row_number().over(w), "total": F.count("*").over(whole), "n_failed": F.sum(failed.cast("long")).over(upto), "_failed": failed}
    )
    return rows.filter((F.col("n") == 1) | (F.col("n") == F.col("total")) | (F.col("n") % every == 0) | F.col("_failed")).drop("_failed")


def latest_event(events: DataFrame, group: list[str], ts: str, id_col: str, heartbeat: Column | None = None) -> DataFrame:
    """The last event of each group; with heartbeat, the last that is none."""
    rows = events if heartbeat is None else events.filter(~heartbeat)
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(ts, id_col)).alias("_r")).select(*group, "_r.*")


def first_success(attempts: DataFrame, doc: str, pos: str, ok: Column) -> DataFrame:
    """(doc, tried, success_pos, failures): attempts up to the first success and what failed before it."""
    w = Window.partitionBy(doc)
    rows = attempts.withColumn("_hit", F.min(F.when(ok, F.col(pos))).over(w)).filter(F.col("_hit").isNull() | (F.col(pos) <= F.col("_hit")))
    failures = F.array_sort(F.collect_list(F.when(~ok, F.col(pos))))
    return rows.groupBy(doc).agg(F.count("*").alias("tried"), F.max("_hit").alias("success_pos"), failures.alias("failures"))


def rate_limit(requests: DataFrame, client: str, ts: str, id_col: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """allowed and retry_after per request of a sliding window in which rejected requests do not count.

    Whether a request is accepted depends on earlier decisions, so each client is a fold over its sorted rows; the
    state is the last accepted times, and rows stream in batches, so a busy client needs no more memory.
    """
    out = requests.select(client, F.col(ts).cast("timestamp").cast("double").alias("t"), id_col)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent = None, []
        for pdf in parts:
            allowed, wait = [], []
            for c, t in zip(pdf[client].tolist(), pdf["t"].tolist()):
                if c != who:
                    who, recent = c, []
                recent = [x for x in recent if x > t - seconds]
                if len(recent) < most:
                    recent.append(t)
                    allowed.append(True)
                    wait.append(0.0)
                else:
                    allowed.append(False)
                    wait.append(max(1.0, recent[0] + seconds - t))
            yield pdf.assign(allowed=allowed, retry_after=wait)

    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    ddl = f"`{client}` {kind[client]}, t double, `{id_col}` {kind[id_col]}, allowed boolean, retry_after double"
    return out.repartition(client).sortWithinPartitions(client, "t", id_col).mapInPandas(fold, ddl)


def rate_report(requests: DataFrame, client: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests of the same client in the window before each one, accepted or not."""
    w = Window.partitionBy(client).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, -1)
    return requests.withColumn("in_window", F.count("*").over(w))


def cap_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group (Spark limits each group inside a partition before it shuffles)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def runner_up_margin(scores: DataFrame, doc: str, score: str) -> DataFrame:
    """(doc, best, margin): distance of the best score to the second; a single score is its own margin."""
    best = F.max(score).over(Window.partitionBy(doc))
    rows = scores.select(doc, F.col(score).alias("_s"), best.alias("_best"))
    per = rows.groupBy(doc).agg(F.max("_best").alias("best"), F.count_if(F.col("_s") == F.col("_best")).alias("_ties"), F.max(F.when(F.col("_s") < F.col("_best"), F.col("_s"))).alias("_next"))
    second = F.when(F.col("_ties") > 1, F.col("best")).otherwise(F.coalesce("_next", F.lit(0.0)))
    return per.select(doc, "best", (F.col("best") - second).alias("margin"))


def candidate_order(cands: DataFrame, doc: str, keys: list) -> DataFrame:
    return cands.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(*keys)))


def page(df: DataFrame, ts: str, id_col: str, offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """Newest first; limit is clamped to 1..most."""
    limit = min(max(limit, 1), most)
    return df.orderBy(F.col(ts).desc_nulls_last(), id_col).offset(max(offset, 0)).limit(limit)


def newest_feed(df: DataFrame, ts: str, id_col: str, now: Column, n: int = 8) -> DataFrame:
    """Newest n rows with a recent flag (90 minutes) and the age as minutes, hours or days."""
    age = (now.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")) / 60
    rows = page(df, ts, id_col, 0, n).withColumn("minutes", F.floor(age))
    unit = F.when(F.col("minutes") < 60, "min").when(F.col("minutes") < 1440, "hour").otherwise("day")
    amount = F.when(F.col("minutes") < 60, F.col("minutes")).when(F.col("minutes") < 1440, F.floor(F.col("minutes") / 60)).otherwise(F.floor(F.col("minutes") / 1440))
    return rows.withColumns({"is_recent": F.col("minutes") <= 90, "age_unit": unit, "age": amount}).drop("minutes")


def tail_events(events: DataFrame, job: str, job_id, id_col: str, limit: int = 80) -> DataFrame:
    """The newest events of one job, looked for among the newest max(8 * limit, 200) of all jobs, oldest first."""
    recent = events.orderBy(F.col(id_col).desc()).limit(max(8 * limit, 200))
    return recent.filter(F.col(job) == job_id).orderBy(F.col(id_col).desc()).limit(limit).orderBy(id_col)


def top_k(df: DataFrame, order: list, n: int) -> DataFrame:
    """n 0 means all."""
    rows = df.orderBy(*order)
    return rows.limit(n) if n else rows


def top_category(scores: DataFrame, doc: str, score: str = "score", priority: str = "priority") -> DataFrame:
    return scores.groupBy(doc).agg(F.max_by("category", F.struct(F.col(score), -F.col(priority))).alias("category"))
