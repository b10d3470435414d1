"""Personal-data scan over a document table.

One narrow stage of four ``rlike`` tests over the whole text of every
document; the per-language / per-source counts are one ``explode`` + partial
aggregation.  Java's ``\\b`` is Unicode-aware like the original engine's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# PII patterns in detection order.
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
)


def pii_types(text: Column) -> Column:
    """ARRAY<STRING> of the PII kinds found in ``text`` (detection order)."""
    t = F.coalesce(text, F.lit(""))
    return F.array_except(
        F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in PII_PATTERNS]),
        F.array(F.lit(None).cast("string")))


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, *[c for c in ("lang", "source") if c in docs.columns],
                       pii_types(F.col(text_col)).alias("pii_types"))


def pii_counts(scan: DataFrame, by=("lang", "source")) -> DataFrame:
    """Documents per (group, PII kind)."""
    return (scan.select(*by, F.explode("pii_types").alias("pii_type"))
            .groupBy(*by, "pii_type").agg(F.count(F.lit(1)).alias("n_docs")))
