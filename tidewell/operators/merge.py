"""Folding duplicates into their canonical record, field by field, in rank order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import category_priority, geocode_rank, place_specificity

FIELDS = ("category", "confidence", "source_list", "body", "summary", "geocode_status", "location_text", "lat", "lng", "district")


def best_category(rows: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """(key, category, confidence) after the rows of a key are merged in order of rank: a known category replaces
    unknown; else another one of higher confidence, or of equal confidence and better priority.

    A row that repeats the row before it can change nothing, so only the changes along the rank are gathered: one for a
    group of copies, whatever its size."""
    w = Window.partitionBy(key).orderBy("rank")
    same = F.lag("category").over(w).eqNullSafe(F.col("category")) & F.lag("confidence").over(w).eqNullSafe(F.col("confidence"))
    steps = rows.select(key, "rank", "category", "confidence", category_priority("category", categories).alias("priority")).withColumn("same", same).filter("NOT same")
    groups = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "category", "confidence", "priority"))).alias("g"))

    def better(acc, x):
        surer = (x["confidence"] > acc["confidence"] + 1e-9) | ((F.abs(x["confidence"] - acc["confidence"]) <= 1e-9) & (x["priority"] < acc["priority"]))
        return (x["category"] != "unknown") & ((acc["category"] == "unknown") | ((x["category"] != acc["category"]) & surer))

    best = F.aggregate("g", F.get("g", F.lit(0)), lambda acc, x: F.when(better(acc, x), x).otherwise(acc))
    return groups.select(key, best.alias("b")).select(key, "b.category", "b.confidence")


def merge_groups(df: DataFrame, key: str, rank: str, id_col: str, categories: list[str]) -> DataFrame:
    """One row per key: the record of least rank with the others merged in, in order of rank.

    Category as best_category(). Longer body and summary win, the earlier of equal ones. The place moves as a block:
    better state, then a point, then a more specific text. Sources are united in order, without regard to case. Bodies
    and places are maxima that combine before the shuffle; nothing but sources and category changes is gathered.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    place = F.struct("geocode_status", "location_text", "lat", "lng", "district")
    standing = F.struct(geocode_rank("geocode_status").alias("a"), F.col("lat").isNotNull().cast("int").alias("b"), place_specificity("location_text").alias("c"), -F.col(rank))
    longest = lambda c: F.max_by(text(c), F.struct(F.length(text(c)), -F.col(rank))).alias(c)
    merged = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(id_col, rank).alias(id_col), longest("body"), longest("summary"), F.max_by(place, standing).alias("place"))
    known = df.select(key, F.col(rank).alias("rank"), F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"))
    named = df.select(key, F.col(rank).alias("_rank"), F.posexplode("source_list").alias("_at", "_name")).withColumn("_name", F.trim("_name")).filter("_name <> ''")
    first = named.groupBy(key, F.lower("_name").alias("_lower")).agg(F.min(F.struct("_rank", "_at", "_name")).alias("_first"))
    sources = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_first")), lambda f: f["_name"]).alias("source_list"))
    out = merged.join(best_category(known, key, categories), key).join(sources, key, "left")
    sources = F.coalesce("source_list", F.array().cast("array<string>")).alias("source_list")
    return out.select(key, F.col("n").cast("int").alias("n"), id_col, "category", "confidence", sources, "body", "summary", "place.*")


def merge_report(df: DataFrame, key: str) -> DataFrame:
    """Counters of a merge: groups, rows that merge away, singletons."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).cast("long").alias("merged_rows"), F.count_if(F.col("n") == 1).alias("singletons"))
