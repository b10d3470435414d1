"""Operator 10: packing into optimal length buckets.

* A text of n tokens becomes ``ceil(n / max_len)`` sequences (whole texts, nothing
  is cut off); an empty or NULL text becomes none but keeps its row, with a NULL
  bucket, so every document is in the result.
* The histogram of sequence lengths over all documents (at most ``max_len`` rows)
  goes to the driver; dynamic programming chooses ``n_buckets`` upper bounds that
  minimise the padding when each sequence is padded to its bucket's bound.
* A batch of a bucket with bound b takes ``token_budget // b`` sequences.  Sequences
  of a bucket are numbered 0, 1, ... over all tasks: they are dealt by hash into
  slots of about ``SLOT_ROWS`` rows, numbered inside the slot, and a running total
  of slot sizes (one row for each bucket and slot) gives the offsets.  So a bucket
  that holds most rows is still many tasks, and only its last batch can be short.

Repeated rows are packed like any other; a ``row`` hash keeps them apart only by
their slot order.  Ties in length fall into the same bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_text, run_folder, stage, text_blocks, word_spans

MAX_LEN = 2048
N_BUCKETS = 12
TOKEN_BUDGET = 16_384
SLOT_ROWS = 20_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): words ``[^\\x20\\x09-\\x0D]+`` plus one end, 0 for empty texts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "_t"):
            off, data = flat_text(b.column(1))
            n = np.bincount(word_spans(off, data)[2], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n + (np.diff(off) > 0), pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(docs[id_col], docs[text_col].alias("_t")).mapInArrow(run, f"{id_col} {id_type}, n_tokens long")


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least total padding.

    ``lengths`` ascending and distinct.  cost(i, j) of one bucket over lengths i..j is
    the bound times the sequences in it; the tokens themselves are the same for any
    choice.  Row by row: best[k][j] = min over i of best[k-1][i-1] + cost(i, j)."""
    n = len(lengths)
    if n == 0:
        return []
    lengths, counts = lengths.astype(np.float64), counts.astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(counts)])
    best = lengths * total[1:]                       # one bucket over lengths 0..j
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(n_buckets, n)):
        now, frm = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (total[j + 1] - total[1:j + 1])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], frm[j] = cost[i], i + 1
            else:
                frm[j] = -1                          # fewer buckets do as well
        best = now
        back.append(frm)
    bounds, j, k = [], n - 1, len(back) - 1
    while j >= 0:
        while k > 0 and back[k][j] < 0:
            k -= 1
        bounds.append(int(lengths[j]))
        j = (int(back[k][j]) if k else 0) - 1
        k -= 1
    return bounds[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS,
         token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row for each sequence: id, n_tokens (of the document), piece, piece_len,
    bucket_len, batch (number within its bucket), place (within the batch), padding.

    ``lengths``: (id, n_tokens)."""
    if token_budget < max_len:
        raise ValueError("a batch must hold a sequence of max_len tokens")
    spark = lengths.sparkSession
    folder = run_folder(spark)
    n = F.col("n_tokens")
    docs = stage(lengths.select(F.col(id_col), n.cast("long").alias("n_tokens")), folder, "lengths")
    pieces = (docs.filter(n > 0)
              .withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(n / max_len).cast("int") - 1)))
              .withColumn("piece_len", F.least(F.lit(max_len), n - F.col("piece") * max_len).cast("int")))
    hist = pieces.groupBy("piece_len").agg(F.count(F.lit(1)).alias("c")).orderBy("piece_len").toPandas()
    bounds = bucket_bounds(hist["piece_len"].to_numpy(), hist["c"].to_numpy(), n_buckets)
    rows = int(hist["c"].sum())
    bound = F.lit(None).cast("int")
    for b in reversed(bounds):
        bound = F.when(F.col("piece_len") <= b, b).otherwise(bound)
    slots = max(1, -(-rows // SLOT_ROWS))
    dealt = (pieces.withColumn("bucket_len", bound)
             .withColumn("slot", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(slots)).cast("int")))
    sizes = dealt.groupBy("bucket_len", "slot").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("bucket_len").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "slot", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket_len", "slot").orderBy(F.xxhash64(F.col(id_col), "piece"), id_col, "piece")
    at = F.col("before") + F.row_number().over(inside) - 1
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket_len"))
    packed = (dealt.join(offsets, ["bucket_len", "slot"]).withColumn("at", at)
              .select(id_col, "n_tokens", "piece", "piece_len", "bucket_len",
                      F.floor(F.col("at") / per_batch).cast("long").alias("batch"),
                      (F.col("at") % per_batch).cast("int").alias("place"),
                      (F.col("bucket_len") - F.col("piece_len")).alias("padding")))
    empty = docs.filter(n.isNull() | (n <= 0)).select(
        id_col, "n_tokens", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("piece", "int"), ("piece_len", "int"), ("bucket_len", "int"), ("batch", "long"),
            ("place", "int"), ("padding", "int"))))
    return packed.union(empty)
