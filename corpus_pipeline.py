"""Corpus pipeline: quality selection, near-duplicate removal, sanitisation, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and reread as the next one's ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.common import run_folder, stage, table
from pactum.llm.ngram_join import one_per_group
from pactum.llm.ordinal import GRADES, corpus_ratings, select_documents
from pactum.llm.packing import pack, word_counts
from pactum.llm.pii import sanitise

NEAR_WIDTH, NEAR_NUM, NEAR_DEN = 5, 80, 100     # five-word shingles, similarity 0.8 or more


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with P(grade = good) below one half go."""
    return select_documents(docs, corpus_ratings(table(spark, sf_dir, "labels")), GRADES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the least id stays."""
    return one_per_group(docs, NEAR_WIDTH, NEAR_NUM, NEAR_DEN)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and disclosing terms are replaced; n_chars follows."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token-budget batches in optimal length buckets."""
    return pack(word_counts(docs))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates),
          ("personal data", personal_data), ("packing", packing)]

#: SQL cannot express the fitted classifier; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), folder, name.replace(" ", "_"))
    return docs
