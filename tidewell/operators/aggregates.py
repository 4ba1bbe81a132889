"""Statistics, facets, crawl summaries and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats_meta(df: DataFrame, source: str, ts: str, cutoff: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct(source).alias("n_sources"), F.count_if(F.col(ts) >= cutoff).alias("n_recent"))


def bucket_counts(df: DataFrame, field: str) -> DataFrame:
    """(key, n) without null and empty keys; order by n desc, key when showing it."""
    return df.filter(F.col(field).isNotNull() & (F.col(field) != "")).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))


def geocoded_total(df: DataFrame, valid: Column) -> DataFrame:
    return df.agg(F.count_if(valid).alias("geocoded"))


def stats(df: DataFrame, fields: list[str], source: str, ts: str, cutoff: Column) -> DataFrame:
    """All facets in one pass: (facet, key, n); totals have facet meta. Grouping sets expand rows, but partial
    aggregation brings them down to one per key before the shuffle."""
    view = df.select(*fields, F.col(source).alias("_source"), F.col(ts).alias("_ts"), (F.col(ts) >= cutoff).alias("_recent"))
    facet = F.coalesce(*[F.when(F.expr(f"grouping({f})") == 0, F.lit(f)) for f in fields], F.lit("meta")).alias("facet")
    key = F.coalesce(*[F.when(F.expr(f"grouping({f})") == 0, F.col(f)) for f in fields]).alias("key")
    grouped = view.groupingSets([[F.col(f)] for f in fields] + [[]], *[F.col(f) for f in fields])
    rows = grouped.agg(facet, key, F.count("*").alias("n"), F.count_if(F.col("_recent")).alias("n_recent"))
    return rows.filter("facet = 'meta' OR (key IS NOT NULL AND key <> '')").select("facet", "key", "n", "n_recent")


def dashboard(df: DataFrame, category: str, district: str, wants_category: Column, wants_district: Column, others: Column) -> DataFrame:
    """Self-excluding facets: the category facet ignores the category filter, the district facet the district one.

    One scan: three flags per row, then grouping sets with conditional counts.
    """
    flags = df.filter(others).select(F.col(category).alias("category"), F.col(district).alias("district"), F.coalesce(wants_category, F.lit(False)).alias("c"), F.coalesce(wants_district, F.lit(False)).alias("d"))
    grouped = flags.groupingSets([[F.col("category")], [F.col("district")], []], F.col("category"), F.col("district"))
    rows = grouped.agg(
        F.expr("grouping(category)").alias("gc"), F.expr("grouping(district)").alias("gd"),
        F.count_if("d").alias("n_d"), F.count_if("c").alias("n_c"), F.count_if(F.col("c") & F.col("d")).alias("n_both"),
    )
    by_c, by_d = F.col("gc") == 0, F.col("gd") == 0
    out = rows.select(
        F.when(by_c, "category").when(by_d, "district").otherwise("total").alias("facet"),
        F.when(by_c, F.col("category")).when(by_d, F.col("district")).alias("key"),
        F.when(by_c, F.col("n_d")).when(by_d, F.col("n_c")).otherwise(F.col("n_both")).alias("n"),
    )
    return out.filter("facet = 'total' OR (key IS NOT NULL AND key <> '' AND n > 0)")


def dashboard_facets(df: DataFrame, names: dict[str, str], cutoff: Column, wants_category: Column, wants_district: Column, others: Column, valid: Column) -> DataFrame:
    """All counting facets of the dashboard in one scan, (facet, key, n); names gives category, district, source and ts.

    stats_* and map_total hold under all filters; category_facets ignores the category filter, district_facets the
    district filter.
    """
    c, d = F.coalesce(wants_category, F.lit(False)), F.coalesce(wants_district, F.lit(False))
    rows = df.filter(others).select(
        F.col(names["category"]).alias("category"), F.col(names["district"]).alias("district"), F.when(c & d, F.col(names["source"])).alias("source"), c.alias("c"), d.alias("d"),
        (c & d).alias("all"), (c & d & F.coalesce(valid, F.lit(False))).alias("point"), (c & d & F.coalesce(F.col(names["ts"]) >= cutoff, F.lit(False))).alias("recent"),
    )
    grouped = rows.groupingSets([[F.col("category")], [F.col("district")], []], F.col("category"), F.col("district")).agg(
        F.expr("grouping(category)").alias("gc"), F.expr("grouping(district)").alias("gd"), F.count_if("all").alias("n_all"), F.count_if("d").alias("n_d"), F.count_if("c").alias("n_c"),
        F.count_if("point").alias("n_point"), F.count_if("recent").alias("n_recent"), F.count_distinct("source").alias("n_sources"),
    )
    one = lambda facet, n, key=None: F.struct(F.lit(facet).alias("facet"), (F.lit(None).cast("string") if key is None else F.col(key).cast("string")).alias("key"), F.col(n).alias("n"))
    by_category = F.array(one("stats_categories", "n_all", "category"), one("category_facets", "n_d", "category"))
    by_district = F.array(one("stats_districts", "n_all", "district"), one("district_facets", "n_c", "district"))
    totals = F.array(one("stats_total", "n_all"), one("stats_sources", "n_sources"), one("stats_recent", "n_recent"), one("stats_geocoded", "n_point"), one("map_total", "n_point"))
    out = grouped.select("gc", "gd", F.inline(F.when(F.col("gc") == 0, by_category).when(F.col("gd") == 0, by_district).otherwise(totals)))
    return out.filter("(gc = 1 AND gd = 1) OR (key IS NOT NULL AND key <> '' AND n > 0)").select("facet", "key", "n")


def crawl_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per source of outcomes(source, pos, outcome, error), with the first error."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("source").agg(
        F.count("*").alias("listed"), n("inserted", "duplicate", "invalid_record", "lookback_filtered").alias("fetched"), n("inserted", "duplicate").alias("parsed"),
        n("failed", "invalid_record").alias("failed"), n("inserted").alias("inserted"), n("duplicate").alias("duplicate"), n("lookback_filtered").alias("lookback_filtered"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("first_error"),
    )


def session_status(parsed="parsed", failed="failed", errors="errors") -> Column:
    return F.when((F.col(failed) == 0) & (F.col(errors) == 0), "success").when(F.col(parsed) > 0, "partial").otherwise("failed")


def run_status(sessions: DataFrame) -> DataFrame:
    """One row: the run's status from its sessions(status, skip_reason)."""
    good, all_ = F.count_if(F.col("status") == "success"), F.count_if(F.col("skip_reason").isNull())
    status = F.when((all_ > 0) & (good == all_), "success").when(F.count_if(F.col("status").isin("success", "partial")) > 0, "completed_with_errors").otherwise("failed")
    return sessions.agg(status.alias("status"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.sort_array(F.collect_set("skip_reason")).alias("skip_reasons"))


def publish_gate(sessions: DataFrame, allowed_skips: list[str]) -> DataFrame:
    """One row with the first reason that keeps a refresh from being published; null lets it through.

    sessions has one row per active source: status, null where it was not processed, and skip_reason.
    """
    skipped = F.count_if(F.col("skip_reason").isNotNull())
    bad_skips = F.count_if(F.col("skip_reason").isNotNull() & ~F.col("skip_reason").isin(allowed_skips))
    processed = F.count_if(F.col("status").isNotNull() & F.col("skip_reason").isNull())
    failed = F.count_if(F.col("status").isNotNull() & F.col("skip_reason").isNull() & (F.col("status") != "success"))
    reason = (
        F.when(F.count("*") == 0, "no_active_sources")
        .when(bad_skips > 0, "refresh_skipped_sources_present")
        .when(F.count("*") - skipped <= 0, "no_refresh_eligible_sources")
        .when(processed != F.count("*") - skipped, "refresh_source_count_mismatch")
        .when(failed > 0, "refresh_not_fully_successful")
    )
    return sessions.agg(reason.alias("reason"))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), digits), F.lit(0.0))


def district_confusion(pred: DataFrame) -> DataFrame:
    """Per variant of pred(variant, predicted, expected): right, missed, invented, wrong and accuracy; null is none."""
    p, e = F.col("predicted"), F.col("expected")
    right = F.count_if(p.eqNullSafe(e))
    return pred.groupBy("variant").agg(
        F.count("*").alias("total"), right.alias("correct"), F.count_if(p.isNull() & e.isNotNull()).alias("false_negative"), F.count_if(p.isNotNull() & e.isNull()).alias("false_positive"),
        F.count_if(p.isNotNull() & e.isNotNull() & (p != e)).alias("wrong"), rate(right, F.count("*")).alias("accuracy"),
    )


def live_accuracy(pred: DataFrame) -> DataFrame:
    """Accuracies of pred(predicted, expected), both arrays: all equal, first equal, first contained."""
    p, e = F.col("predicted"), F.col("expected")
    first = F.get(e, F.lit(0))
    return pred.agg(
        F.count("*").alias("total"), rate(F.count_if(p == e), F.count("*")).alias("exact"), rate(F.count_if(F.get(p, F.lit(0)).eqNullSafe(first)), F.count("*")).alias("primary_"),
        rate(F.count_if(F.array_contains(p, first)), F.count("*")).alias("contains_"),
    )


def labelled_accuracy(pred: DataFrame, fields: list[str]) -> DataFrame:
    """Per field the share of labelled rows (expected_x known) where x equals it."""
    out = []
    for f in fields:
        known = F.col(f"expected_{f}").isNotNull()
        out += [F.count_if(known).alias(f"n_{f}"), rate(F.count_if(known & F.col(f).eqNullSafe(F.col(f"expected_{f}"))), F.count_if(known)).alias(f"accuracy_{f}")]
    return pred.agg(*out)


def duplicate_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs(is_duplicate, expected) as accuracy, false positives and false negatives."""
    d, e = F.col("is_duplicate"), F.col("expected")
    return pairs.agg(rate(F.count_if(d == e), F.count("*")).alias("accuracy"), F.count_if(d & ~e).alias("false_positive"), F.count_if(~d & e).alias("false_negative"))


def logical_accuracy(cases: DataFrame) -> DataFrame:
    """cases(strategy, address, expected_strategy, expected_address): total, and those where both equal the
    expectation; null equals null."""
    right = F.col("strategy").eqNullSafe(F.col("expected_strategy")) & F.col("address").eqNullSafe(F.col("expected_address"))
    return cases.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), rate(F.count_if(right), F.count("*")).alias("accuracy"))


def category_transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("old_category", "new_category").agg(F.count("*").alias("n"))


def change_report(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, changed, total) of pairs with old_x and new_x for every field x; null equals null."""
    counts = [F.count_if(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))).alias(f) for f in fields]
    row = pairs.agg(F.count("*").alias("total"), *counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("changed"), F.col("total").alias("total")) for f in fields])))


def status_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.col(field).alias("status")).agg(F.count("*").alias("n"))


def geocode_metrics(attempts: DataFrame) -> DataFrame:
    """Totals and rates of attempts(ok, cached, failure_type)."""
    n = F.count("*")
    return attempts.agg(n.alias("total"), F.count_if("ok").alias("succeeded"), rate(F.count_if("ok"), n, 3).alias("success_rate"), rate(F.count_if(~F.col("ok")), n, 3).alias("failure_rate"), rate(F.count_if("cached"), n, 3).alias("cache_hit_rate"))


def geocodes_by_district(attempts: DataFrame) -> DataFrame:
    """(district, total, succeeded, success_rate) of attempts(ok, district)."""
    n = F.count("*")
    return attempts.filter("district IS NOT NULL AND district <> ''").groupBy("district").agg(n.alias("total"), F.count_if("ok").alias("succeeded"), rate(F.count_if("ok"), n, 3).alias("success_rate"))


def failed_addresses(attempts: DataFrame, order: str, most: int = 100) -> DataFrame:
    """The newest failed attempts(ok, address, failure_type), at most so many."""
    rows = attempts.filter(~F.col("ok")).select(order, "address", "failure_type")
    return rows.orderBy(F.desc(order), "address").limit(most)


def top_failures(attempts: DataFrame, n: int = 5) -> DataFrame:
    return attempts.filter("failure_type IS NOT NULL").groupBy("failure_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure_type").limit(n)


def fallback_hits(events: DataFrame, ts: str | None = None) -> DataFrame:
    """Counts per source, stage and fallback; with ts, running counts."""
    keys = ["source", "stage", "fallback"]
    if ts is None:
        return events.groupBy(*keys).agg(F.count("*").alias("n"))
    return events.withColumn("n", F.count("*").over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): mean of each dimension. Dimensions are columns of one aggregate, so rows are not exploded."""
    dim = vectors.select(F.max(F.size(vector))).first()[0] or 0
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dim)]
    return vectors.groupBy(label).agg(F.array(*means).alias("centroid"))


def feed_counts(df: DataFrame, category: str, labels: dict[str, str], ts: str, now: Column, source: str) -> DataFrame:
    """Counts per display category with how many are live (6 hours) and the number of sources."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    live = F.col(ts) >= now - F.expr("INTERVAL 6 HOURS")
    return df.groupBy(F.coalesce(names[F.col(category)], F.lit("other")).alias("category")).agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.count_distinct(source).alias("n_sources"))


def filter_summary(buckets: DataFrame, selected: list[str]) -> DataFrame:
    """Totals of selected keys and of all keys of bucket counts."""
    n = F.coalesce(F.sum(F.when(F.col("key").isin(selected), F.col("n"))), F.lit(0)).cast("long")
    return buckets.agg(n.alias("selected"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("all_keys"))


#: Bins of one pass of order_statistic(), and values that it sorts at last.
BINS, LAST_VALUES = 1000, 20_000


def order_statistic(rows: DataFrame, value: str, rank: int) -> float | None:
    """The rank-th largest value (from 1), exactly. Each pass counts the bins of the range that is left and keeps the
    bin with the rank, until it holds few values, or one value only; no task sorts more than LAST_VALUES."""
    v = F.col(value).cast("double")
    rows = rows.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 1 <= rank <= n:
        return None
    while n > LAST_VALUES and low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        inside = rows.filter(F.col("v").between(low, high))
        for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(F.desc("bin")).collect():
            if rank <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            rank -= r.n
    if low == high:
        return low
    return rows.filter(F.col("v").between(low, high)).orderBy(F.desc("v")).limit(rank).agg(F.min("v")).first()[0]


def tail_latency(durations: DataFrame, value: str) -> DataFrame:
    """Mean rate and the rate at the worst hundredth of durations (milliseconds), 2 decimals."""
    rows = durations.filter(F.col(value) > 0)
    n, span = rows.agg(F.count("*"), F.sum(F.col(value))).first()
    schema = "average double, low_1_percent double"
    if not n:
        return durations.sparkSession.createDataFrame([(0.0, 0.0)], schema)
    worst = order_statistic(rows, value, max(1, -(-n // 100)))
    return durations.sparkSession.createDataFrame([(1000.0 * n / float(span), 1000.0 / worst)], schema).select(*[F.round(c, 2).alias(c) for c in ("average", "low_1_percent")])


def reset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every table and their total."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(out.agg(F.sum("n").cast("long").alias("n")).select(F.lit("total").alias("table_name"), "n"))
