"""Ingest over a table of files / documents.

Each step is a projection or a key join:
* ``list_files`` (A2): ``binaryFile`` listing with an extension filter; only
  path/length are read when content is not selected.
* ``junk_filter`` (A3): reasons as a column; rejects and accepts are two
  filters of the same projection.
* ``source_hash`` / ``contract_id`` (I1/I2): ``sha1`` / ``regexp_replace``.
* ``dedupe`` (I3): one winner per id (min position) by aggregation, not by
  collecting groups.
* ``ingest`` (A7/A8): ``left_anti`` against the existing ids then append;
  ``force`` replaces the re-ingested ids (old left-anti new, union new).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted extensions and junk thresholds.
SUPPORTED_EXTENSIONS = (".pdf", ".docx", ".doc")
MIN_FILE_BYTES = 500
MIN_TEXT_CHARS = 50
OCR_TEXT_CHARS = 400


def list_files(spark: SparkSession, folder: str, extensions=SUPPORTED_EXTENSIONS) -> DataFrame:
    """A2: non-recursive listing of ``folder`` filtered by extension, with
    the relative label (file name) and size."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
          .select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return (df.select("path", name.alias("file_name"), ext.alias("extension"), "length", "modificationTime")
            .where(ext.isin(*extensions)))


def junk_reason(file_name: Column, size: Column, text: Column) -> Column:
    """A3: first reason a file is junk, NULL when it is a contract candidate."""
    n = F.coalesce(file_name, F.lit(""))
    ext = F.lower(F.regexp_extract(n, r"(\.[^.]+)$", 1))
    stripped = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return (F.when(n.startswith("~$") | n.startswith(".~$"), "lock_file")
            .when(size < MIN_FILE_BYTES, "too_small")
            .when(~ext.isin(*SUPPORTED_EXTENSIONS), "unsupported_extension")
            .when(stripped < MIN_TEXT_CHARS, "no_text"))


def needs_ocr(text: Column, has_images: Column, requested: Column | None = None) -> Column:
    """Fewer than 400 stripped characters and (OCR requested, images
    present, or no text at all)."""
    requested = F.lit(False) if requested is None else requested
    stripped = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return (stripped < OCR_TEXT_CHARS) & (requested | F.coalesce(has_images, F.lit(False)) | (stripped == 0))


def source_hash(file_name: Column, text: Column) -> Column:
    """I1 (text-only form): sha1 of the lower-cased file name, the text's size in
    bytes and the whole text, so files that only begin alike stay apart."""
    body = F.coalesce(text, F.lit(""))
    return F.sha1(F.concat(F.lower(file_name), F.octet_length(body).cast("string"), F.lit("-"), body))


def contract_id(file_name: Column, hash_col: Column) -> Column:
    """``slug40-hash10``; slug of the file stem (a-z0-9 runs joined by '-')."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    slug = F.when(slug == "", F.lit("contract")).otherwise(slug)
    return F.concat(F.substring(slug, 1, 40), F.lit("-"), F.substring(hash_col, 1, 10))


def prefixed_properties(props: Column, prefix: str = "pdf_") -> Column:
    """Document properties -> ``pdf_<lower key>``, empty values dropped."""
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), F.lower(k)))


def dedupe(df: DataFrame, id_col: str = "contract_id", pos_col: str = "_pos") -> DataFrame:
    """One row per id, the earliest position wins (aggregation + key join)."""
    first = df.groupBy(id_col).agg(F.min(pos_col).alias("_win"))
    return df.join(first, [id_col]).where(F.col(pos_col) == F.col("_win")).drop("_win")


def ingest_outcomes(batch: DataFrame, existing_ids: DataFrame | None = None, id_col: str = "contract_id",
                    pos_col: str = "_pos") -> DataFrame:
    """A3/A7/I3 outcome per input file: failed (junk, with reason), skipped
    (id already stored or an earlier copy in the batch), processed."""
    first = batch.where(F.col("junk_reason").isNull()).groupBy(id_col).agg(F.min(pos_col).alias("_win"))
    out = batch.join(first, [id_col], "left")
    if existing_ids is not None:
        out = out.join(existing_ids.select(id_col).distinct().withColumn("_stored", F.lit(True)), [id_col], "left")
        stored = F.coalesce(F.col("_stored"), F.lit(False))
    else:
        stored = F.lit(False)
    status = (F.when(F.col("junk_reason").isNotNull(), "failed")
              .when(stored | (F.col(pos_col) != F.col("_win")), "skipped")
              .otherwise("processed"))
    return out.withColumn("status", status).drop("_win", "_stored")


def tally(outcomes: DataFrame) -> DataFrame:
    """Counts per status (and OCR-needed among processed)."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"),
                                          F.count_if(F.coalesce(F.col("needs_ocr"), F.lit(False)))
                                          .alias("n_ocr"))


def ingest(existing: DataFrame, batch: DataFrame, id_col: str = "contract_id", force: bool = False) -> DataFrame:
    """The new collection snapshot.  Idempotent: ingesting the same
    batch twice gives the same snapshot."""
    batch = dedupe(batch, id_col)
    if force:
        return existing.join(batch.select(id_col), [id_col], "left_anti").unionByName(batch)
    return existing.unionByName(batch.join(existing.select(id_col), [id_col], "left_anti"))


def document_batch(docs: DataFrame) -> DataFrame:
    """Files of an ingest batch derived from the documents table: one file per
    document, named after its source and language, size = UTF-8 bytes."""
    name = F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit(".pdf"))
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    h = source_hash(name, F.col("text"))
    return docs.select(
        F.col("doc_id").alias("_pos"), name.alias("file_name"), size.alias("size"), "text",
        h.alias("source_hash"), contract_id(name, h).alias("contract_id"),
        junk_reason(name, size, F.col("text")).alias("junk_reason"),
        needs_ocr(F.col("text"), F.lit(False)).alias("needs_ocr"))
