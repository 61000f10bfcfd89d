"""Training-corpus pipeline over ``documents``: five stages, each one operator of ``tenure.llm``.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``.  ``run``
writes each stage's result as Parquet below the session's shared folder and
reads it again as the next stage's documents.  All stages but the last return
the columns of ``documents``; the last returns the packing plan.

What the stages decide: ``quality_rules`` removes documents that the base rule
or a certified cutoff rejects; ``line_dedup`` takes repeated lines out of texts
(and corrects ``n_chars``) but removes no document; ``near_dedup`` keeps one
document of each group of near copies (five-word shingles, similarity 0.8);
``decontaminate`` removes documents that hold a window of a benchmark item;
``packing`` places every remaining document's pieces.  Nulls, empty texts,
repeated rows, empty tables and extra columns have the results that the
operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import decontaminate, lines, minhash, packing, quality
from tenure.llm.common import bounded_batches, table
from tenure.session import stage_shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = lines.drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.keep_one(docs, words=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", remove_benchmark),
    ("packing", pack),
]

# Certified cutoffs, edit joins, components and the bucket programme have no SQL form: the stages are
# tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_shared(stage(spark, docs, sf_dir), name)
    return docs
