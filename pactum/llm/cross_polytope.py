"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` hash functions turns a unit vector by three rounds of random
signs and a fast Hadamard transform and takes the nearest signed axis as bucket.
Vectors are grouped by (table, bucket) and packed; a bucket with more than 4,096
vectors is split into parts of about that size, and none of its vectors is left
out.  A query looks into its ``probes`` nearest axes in every table; all vectors
there are scored exactly on the original components and the best k are kept.

When lengths differ, vectors are indexed in bands of lengths within ``BAND`` of one
another.  A vector gets one more component that brings it to the largest length of
its band (0 for queries), which makes the largest inner product the smallest angle,
and no vector of another band can make that component large.  A query probes every
band; a band of at most ``WHOLE_BAND`` vectors is one bucket that all queries score.
Queries that find fewer than k vectors are searched again, exactly, over all blocks.
Seeds are fixed, so runs agree.

Null, zero, non-finite and repeated rows take part as :mod:`pactum.llm.vectors`
says; zero vectors take no part.  A query's own row is no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_folder, shuffle_partitions, stage
from .vectors import (BLOCK_ROWS, QUERY_ROWS, best_per_query, blocks_of, matrix, merge_lists, pack,
                      score_blocks, valid_vectors)

TABLES = 8
PROBES = 16
SEED = 20240
BAND = 1.2                     # largest ratio of two lengths in a band
WHOLE_BAND = 1024              # a band of so few vectors has no buckets
ROUNDING = 1e-9                # products this close to the k-th are summed again, in component order


def hadamard(a: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, d = a.shape
    h = 1
    while h < d:
        a = a.reshape(n, d // (2 * h), 2, h)
        a = np.stack([a[:, :, 0] + a[:, :, 1], a[:, :, 0] - a[:, :, 1]], axis=2)
        h *= 2
    return a.reshape(n, d) / np.sqrt(d)


def rotate(a: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of table ``table``: three times random signs, then Hadamard."""
    signs = np.random.default_rng([SEED, table, a.shape[1]]).choice([-1.0, 1.0], (3, a.shape[1]))
    for s in signs:
        a = hadamard(a * s)
    return a


def widen(mat: np.ndarray, longest: np.ndarray | None, room: bool) -> np.ndarray:
    """Unit vectors, padded to a power of two that leaves ``room`` for the extra component
    that brings each to its ``longest``."""
    n, dim = mat.shape
    size = np.sqrt((mat * mat).sum(1))
    width = 1 << max(1, int(np.ceil(np.log2(dim + room))))
    out = np.zeros((n, width))
    if longest is None:
        out[:, :dim] = mat / size[:, None]
    else:
        out[:, :dim] = mat / longest[:, None]
        out[:, dim] = np.sqrt(np.maximum(0.0, 1.0 - (size / longest) ** 2))
    return out


def axes(mat: np.ndarray, table: int, n: int) -> np.ndarray:
    """The n nearest signed axes of each row: axis * 2, plus 1 on the positive side."""
    turned = rotate(mat, table)
    near = np.empty((len(mat), 2 * mat.shape[1]))
    near[:, 0::2], near[:, 1::2] = -turned, turned
    n = min(n, near.shape[1])
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def bucket_rows(items: DataFrame, tables: int, probes: int, room: bool, is_query: bool) -> DataFrame:
    """(dim, band, tab, code, id, vec): a row for each table and, for queries, each probe.
    Code -1 of table 0 is the bucket of a whole band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(2))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                whole = at if is_query else at[np.asarray(b.column(5))[at]]
                if room and len(whole):
                    yield rows(b, whole, dim, 0, np.full(len(whole), -1))
                if room and not is_query:
                    at = np.setdiff1d(at, whole)
                if not len(at):
                    continue
                longest = np.asarray(b.column(4))[at] if room and not is_query else None
                wide = widen(matrix(b.column(1).take(pa.array(at)), int(dim)), longest, room)
                for t in range(tables):
                    codes = axes(wide, t, probes)
                    for j in range(codes.shape[1]):
                        yield rows(b, at, dim, t, codes[:, j])

    def rows(b: pa.RecordBatch, at: np.ndarray, dim: int, tab: int, code: np.ndarray) -> pa.RecordBatch:
        n, at = len(at), pa.array(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, dim, np.int32)), b.column(3).take(at), pa.array(np.full(n, tab, np.int32)),
             pa.array(code.astype(np.int32)), b.column(0).take(at), b.column(1).take(at)],
            names=["dim", "band", "tab", "code", "id", "vec"])

    return items.select("id", "vec", "dim", "band", "longest", "whole").mapInArrow(
        run, "dim int, band int, tab int, code int, id long, vec array<double>")


def exact_scores(ids: np.ndarray, mat: np.ndarray, qids: np.ndarray, qmat: np.ndarray, k: int):
    """The k largest inner products of each query among the rows of a bucket part."""
    s = mat @ qmat.T
    s[ids[:, None] == qids[None, :]] = -np.inf
    if len(ids) > k:
        kth = np.partition(s, len(ids) - k, axis=0)[len(ids) - k]
    else:
        kth = np.full(len(qids), -np.inf)
    vi, qi = np.nonzero((s >= kth - ROUNDING) & (s > -np.inf))
    exact = (mat[vi] * qmat[qi]).sum(1)       # the same order for every row: equal rows tie
    return best_per_query(qids[qi], ids[vi], exact, k)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score for every row for which ``is_query`` (a Column) holds."""
    spark = vectors.sparkSession
    folder = run_folder(spark)
    flag = vectors.withColumn("_is_query", F.coalesce(is_query, F.lit(False)))
    some = F.exists("vec", lambda x: x != 0)
    items = valid_vectors(flag, id_col, vec_col).filter(some)
    queries = valid_vectors(flag.filter("_is_query"), id_col, vec_col).filter(some)
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    lo, hi = items.agg(F.min(size), F.max(size)).first()
    room = bool(hi and hi - lo > 1e-6 * hi)                  # lengths differ
    if room:
        items = items.withColumn("size", size).withColumn("band", F.floor(F.log("size") / float(np.log(BAND)) + 0.5).cast("int"))
        bands = items.groupBy("dim", "band").agg(F.max("size").alias("longest"), (F.count(F.lit(1)) <= WHOLE_BAND).alias("whole"))
        items = items.join(F.broadcast(bands), ["dim", "band"])     # a few rows for each number of components
    no_band = {"band": F.lit(0), "longest": F.lit(0.0), "whole": F.lit(False)}

    rows = stage(bucket_rows(items if room else items.withColumns(no_band), tables, 1, room, False), folder, "buckets")
    q_rows = stage(bucket_rows(queries.withColumns(no_band), tables, probes, room, True), folder, "probes").drop("band")
    # at most tables * 2 * width rows each in a band: how many parts a bucket has
    key = ["dim", "tab", "code"]
    parts = _parts(rows, ["band", *key], "n_parts", BLOCK_ROWS)
    q_parts = _parts(q_rows, key, "n_q_parts", QUERY_ROWS)
    split = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    packed = pack(rows.join(F.broadcast(parts), ["band", *key]).withColumn("part", split(F.col("n_parts"))),
                  [*key, "band", "part"])
    copies = (pack(q_rows.join(F.broadcast(q_parts), key).withColumn("q_part", split(F.col("n_q_parts"))),
                   [*key, "q_part"])
              .join(F.broadcast(parts), key)
              .select(*key, "band", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"),
                      F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part")))
    pairs = packed.join(copies, [*key, "band", "part"])
    pairs = pairs.repartition(shuffle_partitions(spark))
    found = stage(merge_lists(score_blocks(pairs, exact_scores, k, "double"), k), folder, "found")

    # queries with a short list, against all vectors
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(queries.join(full, "id", "left_anti"), folder, "short")
    n_short = short.count()
    if not n_short:
        return found
    every = rows.filter("tab = 0")                           # each vector once
    n_parts = blocks_of(every.count(), BLOCK_ROWS)
    packed = pack(every.withColumn("part", split(F.lit(n_parts))), ["dim", "part"])
    copies = (pack(short.withColumn("q_part", split(F.lit(blocks_of(n_short, QUERY_ROWS)))), ["dim", "q_part"])
              .select("dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"),
                      F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part")))
    pairs = packed.join(copies, ["dim", "part"]).repartition(shuffle_partitions(spark))
    exact = merge_lists(score_blocks(pairs, exact_scores, k, "double"), k)
    kept = found.join(full, found["query_id"] == full["id"], "left_semi")
    return kept.union(exact)


def _parts(rows: DataFrame, key: list[str], name: str, size: int) -> DataFrame:
    return rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
