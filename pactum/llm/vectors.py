"""Vector tables as packed blocks, and the merge of partial top-k lists.

A block is one row ``(dim, block key..., ids, mat, n)`` whose ids and components
are binary (int64, float64), so a task scores a whole block with one product.

Vectors that are NULL or hold a NULL, NaN or infinite component take no part.
Rows that repeat an id count once: of differing vectors under one id the first in
component order.  Only vectors of the same length meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 512


def valid_vectors(df: DataFrame, id_col: str, vec_col: str,
                  component: Callable[[Column], Column] = lambda x: x.cast("double")) -> DataFrame:
    """(id, vec array<double>, dim) of the vectors that take part."""
    v = df[vec_col]
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.filter(v.isNotNull() & df[id_col].isNotNull() & fine)
            .select(df[id_col].cast("long").alias("id"),
                    F.transform(v, component).cast("array<double>").alias("vec"),
                    F.size(v).alias("dim")))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """(rows x dim) of a list column whose lists all have ``dim`` items."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), dim)


def first_per_id(ids: np.ndarray, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each id, in id order; of several the first in component order."""
    keys = [mat[:, j] for j in range(mat.shape[1] - 1, -1, -1)]
    order = np.lexsort((*keys, ids))
    ids, mat = ids[order], mat[order]
    keep = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    return ids[keep], mat[keep]


def pack(df: DataFrame, keys: list[str]) -> DataFrame:
    """One packed row for each value of ``keys`` (``dim`` among them)."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        at = dict(zip(keys, (k.as_py() for k in key)))
        ids = np.asarray(t.column("id").combine_chunks(), dtype=np.int64)
        ids, mat = first_per_id(ids, matrix(t.column("vec"), at["dim"]))
        return pa.table({**{k: pa.array([v], t.schema.field(k).type) for k, v in at.items()},
                         "ids": pa.array([ids.tobytes()], pa.binary()),
                         "mat": pa.array([np.ascontiguousarray(mat).tobytes()], pa.binary())})

    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ids binary, mat binary"
    return df.select(*keys, "id", "vec").groupBy(*keys).applyInArrow(run, schema)


def blocks_of(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def block_of(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int],
                  tuple[np.ndarray, np.ndarray, np.ndarray]]


def score_blocks(pairs: DataFrame, kernel: Kernel, k: int, score_type: str) -> DataFrame:
    """Run ``kernel(ids, mat, query ids, query mat, k)`` on every pair of blocks; the
    lists of an Arrow batch are merged before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.int64() if score_type == "long" else pa.float64()
        for b in batches:
            found = []
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                dim = col["dim"][r].as_py()
                ids, qids = (np.frombuffer(col[c][r].as_buffer(), np.int64) for c in ("ids", "q_ids"))
                mat, qmat = (np.frombuffer(col[c][r].as_buffer(), np.float64).reshape(-1, dim)
                             if dim else np.zeros((n, 0)) for c, n in (("mat", len(ids)), ("q_mat", len(qids))))
                found.append(kernel(ids, mat, qids, qmat, k))
            if not found:
                continue
            q, v, s = (np.concatenate(x) for x in zip(*found))
            q, v, s = best_per_query(q, v, s, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(v), pa.array(s.astype(np.int64) if score_type == "long" else s, out_type)],
                names=["query_id", "vec_id", "score"])

    return pairs.select("dim", "ids", "mat", "q_ids", "q_mat").mapInArrow(
        run, f"query_id long, vec_id long, score {score_type}")


def best_per_query(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int):
    """The k best rows of each query (score down, then id up), each id once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    if len(q):
        keep = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])]
        q, v, s = q[keep], v[keep], s[keep]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        q, v, s = q[rank < k], v[rank < k], s[rank < k]
    return q, v, s


def merge_lists(parts: DataFrame, k: int) -> DataFrame:
    """Final lists: query_id, rank, vec_id, score."""
    one = parts.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
