"""The corpus pipeline: filter toxic documents, drop near copies, cut benchmark passages, redact, mix.

Every stage works on all rows of its predecessor; all but the last return the columns of documents. The last one
returns the mix: how many times each document is taken.

Cases, in every stage: null and empty texts are documents without words (clean, one near-copy group, no benchmark, no
personal data, size 0); very long texts are taken whole; repeated rows are judged alike, and of a near-copy group,
ties and repeated rows included, one row stays; columns of any name pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, mixing, pii, simhash, toxicity
from tidewell.llm.common import work_path

#: Not expressible in SQL: a trained kernel machine, boosted trees and a random walk take part.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.5 or more go. Labels teach the model; the folds held out stay out.

    Null and empty texts score as texts without a passage; without labels of both classes nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component one document stays, that with the least doc_id.

    Rows with a null doc_id stay only where their group has no other; of equal ids and texts one row stays."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages of the benchmark are cut out; documents that are mostly benchmark go.

    Null texts stay null; without items nothing changes; n_chars follows the text."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: spans are replaced by their kind in brackets.

    Null texts stay null; overlapping spans are replaced as one; n_chars follows the text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: copies of each document in the mix.

    Null sources are one source; a source without words has target 0; repeated rows are documents of their own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
