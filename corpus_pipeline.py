"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfworks.llm import decontaminate, mixing, near_dups, quality, suffix_dedup
from shelfworks.llm.shared import fresh, small, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, learnt from trusted positives and these documents."""
    clash = [c for c in docs.columns if c.lower() == "score"]
    names = dict(zip(clash, fresh(docs.columns, *clash)))
    kept = quality.score(docs.withColumnsRenamed(names), quality.trained(spark, docs, sf_dir), quality.THRESHOLD).drop("score")
    return kept.withColumnsRenamed({new: old for old, new in names.items()}).select(*docs.columns)


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles."""
    return near_dups.one_each(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller id; ``n_chars`` follows the text."""
    short = suffix_dedup.shortened(docs)
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return short.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = written(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "tie").distinct(), "leaks")
    key, tie, of = fresh(docs.columns, "_id", "_tie", "_of")
    ids = found.select(F.col("doc_id").alias(key), F.col("tie").alias(tie))
    keyed = docs.withColumn(of, F.xxhash64("text"))
    return keyed.join(small(ids), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(of) == F.col(tie)), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left."""
    return mixing.takes(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_dups),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]
#: Several stages (learning, signatures) are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
