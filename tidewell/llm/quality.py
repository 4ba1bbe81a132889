"""Operator 8: document quality rules, compiled from a threshold table into one projection of built-in functions.

Cases: null text is empty: it has no words, fails the base rule and is not kept; repeated rows are judged each; texts of
one word or one line have no repeats; no rows give no rows; other columns are ignored. Counts are per whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht und von zu "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al con del el es las lo los no para por se su y"
).split()

#: name, numerator, denominator, least and greatest allowed ratio in thousandths (None: open).
THRESHOLDS = [
    ("words", "n_words", "1", 50_000, 100_000_000),
    ("mean_word_chars", "word_chars", "n_words", 2_000, 12_000),
    ("symbols_per_word", "n_symbols", "n_words", None, 100),
    ("stop_words_per_word", "n_stop_words", "n_words", 20, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    ("repeated_words", "n_repeat_words", "n_words", None, 300),
]
REPEAT_LIMIT = 50  # percent of the words, in the base rule
LEAST_WORDS = 50

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def verdict_sql(thresholds=THRESHOLDS) -> str:
    """The table as one boolean SQL expression in integers, the same in Spark and DuckDB."""
    rules = []
    for _, top, bottom, low, high in thresholds:
        if low is not None:
            rules.append(f"1000 * {top} >= {low} * {bottom}")
        if high is not None:
            rules.append(f"1000 * {top} <= {high} * {bottom}")
    return " AND ".join(f"({r})" for r in rules)


def measures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with every count that rules use. Each step is its own projection, so no value is made twice."""
    has_word = "[^\\x20\\x09-\\x0D]"
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumns(
        {
            "words": F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)),
        }
    )
    spot = F.sequence(F.lit(0), F.size("words") - 3)
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    hashed = words.withColumn("windows", F.when(F.size("words") >= 3, F.transform(spot, window)).otherwise(F.array().cast("array<bigint>")))
    # windows in order of hash, where some hash comes twice
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(pairs)))
    same = lambda k, x: F.get("ordered", k)["h"].eqNullSafe(x["h"])
    twice = F.filter("ordered", lambda x, k: same(k - 1, x) | same(k + 1, x))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # each window adds the words that the one before does not cover
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(starts, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    return ordered.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def report(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    base = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words")
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.expr(verdict_sql(thresholds))).alias("kept")
    )


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Rows of docs that pass. The verdict is written first: a filter on it would be pushed below the projections, and
    each of its counts would be worked out again for every place that uses it."""
    named = docs.withColumn("doc", F.struct(*docs.columns)).select(F.col("doc").alias("doc_id"), "text")
    keep = F.expr(f"n_words >= {LEAST_WORDS} AND 100 * n_repeat_words <= {REPEAT_LIMIT} * n_words") & F.expr(verdict_sql(thresholds))
    judged = materialize(measures(named).select("doc_id", keep.alias("keep")), "judged")
    return judged.filter("keep").select("doc_id.*")


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, p, words[p : p + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM d) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN h USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict_sql()} AS kept FROM b
"""
