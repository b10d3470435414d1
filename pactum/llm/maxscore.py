"""Operator 6: exact top-k by inner product of integer vectors with MaxScore.

Dimensions are query terms and vectors are documents.  A block of vectors is a
shard; its smallest and largest component of each dimension bound what a term can
add to a score.  For each query the terms are ordered by that bound; those whose
bounds together cannot lift any vector of the shard to the present k-th best
score are non-essential.  The postings of the essential terms are traversed for
all vectors; the other terms are probed, largest bound first, only for vectors
whose partial score plus the bounds still to come reaches the k-th best score.
The k-th score rises from slice to slice of a shard.  Lists of shards are merged
by score, then by id.  Nothing that could tie the k-th score is skipped.

Null, non-finite and repeated rows: see :mod:`pactum.llm.vectors`.  A query's own
row is no candidate.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_folder, shuffle_partitions, stage
from .vectors import (BLOCK_ROWS, QUERY_ROWS, best_per_query, block_of, blocks_of, merge_lists, pack,
                      score_blocks, valid_vectors)

SLICE_ROWS = 512               # vectors between two rises of the k-th score
PROBE_TERMS = 8                # terms probed between two prunings
EXACT = 2.0 ** 53


def maxscore(ids: np.ndarray, mat: np.ndarray, qids: np.ndarray, qmat: np.ndarray, k: int):
    """(query ids, vector ids, scores): the k best of the shard for each query."""
    n, dim = mat.shape
    if dim and n and np.abs(mat).max() * max(np.abs(qmat).max(), 1) * dim >= EXACT:
        mat, qmat = mat.astype(np.int64), qmat.astype(np.int64)   # float64 would round
    lo, hi = (mat.min(0), mat.max(0)) if n else (mat.sum(0), mat.sum(0))
    most = np.maximum(qmat * lo, qmat * hi)        # a term's largest share of a score here
    least = np.minimum(qmat * lo, qmat * hi)
    bound = most - least
    order = np.argsort(bound, axis=1, kind="stable")             # small bounds first
    floor = least.sum(1)
    lists_q = np.zeros(0, np.int64)
    lists_v, lists_s = np.zeros(0, np.int64), np.zeros(0, mat.dtype)
    kth = np.full(len(qids), -np.inf)
    rows_q = np.arange(len(qids))
    for a in range(0, n, SLICE_ROWS):
        part, part_ids = mat[a:a + SLICE_ROWS], ids[a:a + SLICE_ROWS]
        # non-essential: terms of small bound that cannot reach the k-th score by themselves
        reach = floor[:, None] + np.cumsum(np.take_along_axis(bound, order, 1), axis=1)
        n_non = (reach < kth[:, None]).sum(1)
        essential = np.ones(qmat.shape, bool)
        np.put_along_axis(essential, order, np.arange(dim)[None, :] >= n_non[:, None], 1)
        score = part @ np.where(essential, qmat, 0).T             # traverse essential postings
        left = np.where(essential, 0, most).sum(1)
        vi, qi = np.nonzero(score + left >= kth)
        s, rest = score[vi, qi], left[qi]
        for step in range(0, int(n_non.max(initial=0)), PROBE_TERMS):
            todo = n_non[qi] - 1 - step                           # from the largest bound down
            for j in range(PROBE_TERMS):
                at = todo - j
                live = at >= 0
                term = order[qi, np.maximum(at, 0)]
                s = s + np.where(live, qmat[qi, term] * part[vi, term], 0)
                rest = rest - np.where(live, most[qi, term], 0)
            keep = s + rest >= kth[qi]
            vi, qi, s, rest = vi[keep], qi[keep], s[keep], rest[keep]
        own = part_ids[vi] == qids[qi]
        vi, qi, s = vi[~own], qi[~own], s[~own]
        lists_q, lists_v, lists_s = best_per_query(
            np.concatenate([lists_q, qi]), np.concatenate([lists_v, part_ids[vi]]),
            np.concatenate([lists_s, s]), k)
        size = np.bincount(lists_q, minlength=len(qids))
        full = size >= k
        kth[full] = lists_s[(np.cumsum(size) - 1)[full]]
    return qids[lists_q] if n else lists_q, lists_v, lists_s


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id",
                vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of every row for which ``is_query`` (a Column) holds.

    Components become ``floor(scale * x)``.  Vectors are hashed into shards of about
    4,096 and queries into blocks of 512; a query block is copied to each shard, a shard to as many
    groups of query blocks as keep the tasks busy (one, once the shards do).  Both sides are dealt by
    hash: the copies' size is not seen by the planner, who would gather them all at the driver."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    folder = run_folder(spark)
    flag = vectors.withColumn("_is_query", F.coalesce(is_query, F.lit(False)))
    whole = lambda x: F.floor(x.cast("double") * scale)
    items = valid_vectors(flag, id_col, vec_col, whole)
    queries = valid_vectors(flag.filter("_is_query"), id_col, vec_col, whole)
    shards = blocks_of(items.count(), BLOCK_ROWS)
    q_blocks = blocks_of(queries.count(), QUERY_ROWS)
    packed = stage(pack(items.withColumn("shard", block_of("id", shards)), ["dim", "shard"]),
                   folder, "shards")
    q_packed = stage(pack(queries.withColumn("part", block_of("id", q_blocks)), ["dim", "part"]),
                     folder, "queries")
    groups = min(q_blocks, blocks_of(4 * parts, shards))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard_copies = packed.withColumn("_group", every(groups))
    copies = q_packed.select("dim", (F.col("part") % groups).alias("_group"), F.col("ids").alias("q_ids"),
                             F.col("mat").alias("q_mat"), every(shards).alias("shard"))
    keys, tasks = ["dim", "shard", "_group"], max(parts, min(4 * parts, shards * groups))
    # the shards on the right: a task holds one at a time, while its query blocks pass by
    pairs = copies.repartition(tasks, *keys).join(shard_copies.repartition(tasks, *keys).hint("merge"), keys)
    return merge_lists(score_blocks(pairs, maxscore, k, "long"), k)
