"""Vector and hybrid search.

* ``cosine_topk`` (S1/S4): a query set of at most ``MAX_BROADCAST_QUERIES`` rows is
  shipped to every task; each task scores its slice of the corpus with one NumPy matrix
  product per Arrow batch and keeps only the k best per query (partial top-k).  Spark then
  merges at most ``k x batches`` rows per query with a window.  The corpus is never
  shuffled, and no pair list is materialised.  A larger query set stays in Spark: corpus
  and queries are dealt into blocks, and each cell of the grid (one block of either) keeps
  the k best of its corpus block for its queries; the window merges the cells.
* ``hybrid_search`` (S2/S3/S5): metadata keyword score + cosine distance of a
  single query vector, both JVM expressions over the whole collection, then
  ``orderBy().limit(n)`` (per-partition top-n + merge).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_BROADCAST_QUERIES = 4_096   # query vectors shipped to tasks; more are dealt into blocks

TILE_CELLS = 4_000_000          # scores that a task holds at once
TILE_ROWS, TILE_COLS = 2_048, 1_024     # queries and corpus rows of a cell scored at once
BLOCK_ROWS = 65_536             # rows of a block, on average
PAIR_ROWS = 100_000             # pairs scored exactly at once


def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _partial_topk(qids: np.ndarray, qmat: np.ndarray, k: int, id_col: str, vec_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[id_col].to_numpy()
            vecs = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col].to_numpy()])
            order = np.argsort(ids, kind="stable")
            ids, vecs = ids[order], _normalise(vecs[order])
            step = max(1, TILE_CELLS // max(1, len(ids)))
            for a in range(0, len(qids), step):           # bounded score matrix
                sims = vecs @ qmat[a:a + step].T          # (rows, queries)
                # a stable sort by score keeps ties in id order at the cut
                top = np.argsort(-sims, axis=0, kind="stable")[:k]
                rows = top.reshape(-1)
                cols = np.tile(np.arange(sims.shape[1]), top.shape[0])
                yield pd.DataFrame({"query_id": qids[a + cols], id_col: ids[rows],
                                    "cosine": sims[rows, cols]})
    return run


def _matrix(vecs: pa.Array) -> np.ndarray:
    if len(pc.unique(pc.list_value_length(vecs))) > 1:
        raise ValueError("vectors that are null or of another length")
    return _normalise(np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(vecs), -1))


class _Block:
    """A block of the corpus in the order of its ids.  Of equal vectors only the first k stay:
    they score alike, so no other can be among the k best."""

    def __init__(self, ids: pa.Array, vecs: pa.Array, k: int):
        order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start")
        mat = _matrix(vecs.take(order))
        fine = np.isfinite(mat).all(axis=1)
        if not fine.all():                                        # others only where fewer than k are fine
            some = fine.copy()
            some[np.flatnonzero(~fine)[:max(0, k - int(fine.sum()))]] = True
            order, mat = order.filter(pa.array(some)), mat[some]
        rows = np.ascontiguousarray(mat).view(np.dtype((np.void, mat.shape[1] * 8))).ravel()
        _, of = np.unique(rows, return_inverse=True)
        by = np.argsort(of, kind="stable")                        # the members of a class, in id order
        nth = np.arange(len(by)) - np.searchsorted(of[by], of[by])
        keep = np.sort(by[nth < k])
        self.ids, self.mat, self.k = ids.take(order).take(pa.array(keep)), mat[keep], k
        self.small = self.mat.astype(np.float32)
        # rounding to single precision and summing there moves a score of unit vectors by less
        self.slack = (mat.shape[1] + 4) * 2.0 ** -23

    def best(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, block row, score) of the k best of the block for each row of ``q``, exact:
        single precision rules out what is below the k-th best known by more than its error,
        the rest is scored in double precision."""
        qs, k = q.astype(np.float32), min(self.k, len(self.ids))
        at, score = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        least = score[:, -1].copy()
        bad = np.flatnonzero(~np.isfinite(q).all(axis=1))         # no score: the first k rows
        at[bad], score[bad], qs[bad], least[bad] = np.arange(k), np.nan, 0, np.inf
        a, step = 0, max(k, 512)
        while a < len(self.ids):
            sims = qs @ self.small[a:a + step].T
            bar = least - self.slack
            if a == 0:
                bar = np.maximum(bar, np.partition(sims, -k, axis=1)[:, -k] - 2 * self.slack)
            bar = bar.astype(np.float32)
            some = np.flatnonzero(sims.max(axis=1) >= bar)
            row, col = np.nonzero(sims[some] >= bar[some, None])
            new = np.concatenate([np.empty(0)] + [
                (q[some[row[i:i + PAIR_ROWS]]] * self.mat[a + col[i:i + PAIR_ROWS]]).sum(axis=1)
                for i in range(0, len(row), PAIR_ROWS)])
            old_row, old_col = np.nonzero(at[some] >= 0)
            row = np.concatenate([old_row, row])
            col = np.concatenate([at[some[old_row], old_col], a + col])
            new = np.concatenate([score[some[old_row], old_col], new])
            order = np.lexsort((col, -new, row))                  # ties: the smaller id
            row, col, new = row[order], col[order], new[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            top = nth < k
            at[some[row[top]], nth[top]], score[some[row[top]], nth[top]] = col[top], new[top]
            least[some] = score[some, -1]
            a += step
            step = TILE_COLS
        who, nth = np.nonzero(at >= 0)
        return who, at[who, nth], score[who, nth]


def _cell_topk(k: int, id_col: str):
    """Over rows (_cell, _side, _id, _vec) sorted by cell and side: the corpus block of a cell
    comes first and is held, its queries pass by in batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = np.asarray(batch.column("_cell")) * 2 + np.asarray(batch.column("_side"))
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                part, (at, side) = batch.slice(a, b - a), divmod(int(key[a]), 2)
                if at != cell:
                    cell, held, block = at, [], None
                if side == 0:
                    held.append(part)
                    continue
                if held:
                    corpus = pa.Table.from_batches(held).combine_chunks()
                    block, held = _Block(corpus["_id"].combine_chunks(), corpus["_vec"].combine_chunks(), k), []
                if block is None:                                 # no corpus row in this cell
                    continue
                for i in range(0, part.num_rows, TILE_ROWS):
                    some = part.slice(i, TILE_ROWS)
                    who, row, score = block.best(_matrix(some.column("_vec")))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("_query").take(pa.array(who)), block.ids.take(pa.array(row)), pa.array(score)],
                        names=["query_id", id_col, "cosine"])
    return run


def _grid_topk(corpus: DataFrame, queries: DataFrame, n_q: int, k: int, id_col: str, vec_col: str,
               query_id_col: str, query_vec_col: str) -> DataFrame:
    """(query_id, id_col, cosine): the k best of each cell for every query."""
    spark, n_c = corpus.sparkSession, corpus.count()
    # enough cells for several per core, few enough that a row isn't sent often
    even = int(np.ceil(np.sqrt(3 * spark.sparkContext.defaultParallelism)))
    n_a, n_b = (max(even, -(-n // BLOCK_ROWS)) for n in (n_c, n_q))
    c, q = corpus.select(id_col, vec_col), queries.select(query_id_col, query_vec_col)
    id_type, query_type = c.schema[id_col].dataType, q.schema[query_id_col].dataType

    vec_type = c.schema[vec_col].dataType if c.schema[vec_col].dataType == q.schema[query_vec_col].dataType else "array<double>"

    def dealt(df: DataFrame, side: int, ids: str, vecs: str, cells: Column) -> DataFrame:
        null = F.lit(None)
        return df.select(F.explode(cells).alias("_cell"), F.lit(side).alias("_side"),
                         (F.col(ids) if side == 0 else null.cast(id_type)).alias("_id"),
                         (F.col(ids) if side == 1 else null.cast(query_type)).alias("_query"),
                         F.col(vecs).cast(vec_type).alias("_vec"))
    row = F.pmod(F.xxhash64(id_col), F.lit(n_a)).cast("int")
    col = F.pmod(F.xxhash64(query_id_col), F.lit(n_b)).cast("int")
    both = dealt(c, 0, id_col, vec_col, F.transform(F.sequence(F.lit(0), F.lit(n_b - 1)), lambda j: row * n_b + j)).unionByName(
        dealt(q, 1, query_id_col, query_vec_col, F.transform(F.sequence(F.lit(0), F.lit(n_a - 1)), lambda i: i * n_b + col)))
    found = StructType().add("query_id", query_type).add(id_col, id_type).add("cosine", "double")
    return both.repartitionById(n_a * n_b, F.col("_cell")).sortWithinPartitions("_cell", "_side") \
        .mapInArrow(_cell_topk(k, id_col), found)


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                vec_col: str = "embedding", query_id_col: str = "query_id",
                query_vec_col: str = "query_vec", max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact cosine top-k of ``corpus`` rows for every query row.

    Returns (query_id, id_col, cosine, distance = 1 - cosine, rank).  Ties on
    the score are broken by the smaller id."""
    n_q = queries.count()
    if n_q > max_queries:
        cand = _grid_topk(corpus, queries, n_q, k, id_col, vec_col, query_id_col, query_vec_col)
    else:
        local = queries.select(query_id_col, query_vec_col).toPandas()  # bounded by max_queries
        qids = local[query_id_col].to_numpy()
        qmat = np.empty((0, 1)) if local.empty else \
            _normalise(np.stack([np.asarray(v, dtype=np.float64) for v in local[query_vec_col]]))
        schema = f"query_id {queries.schema[query_id_col].dataType.simpleString()}, " \
                 f"{id_col} {corpus.schema[id_col].dataType.simpleString()}, cosine double"
        cand = corpus.select(id_col, vec_col).mapInPandas(_partial_topk(qids, qmat, k, id_col, vec_col), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc(id_col))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("distance", 1 - F.col("cosine")))


def cosine_expr(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length numeric arrays (JVM-side)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))


def metadata_score(query: str, contract_id: Column, parties: Column, contract_type: Column) -> Column:
    """+50 per query word (> 2 chars) in the id, +30 in the parties
    (unless 'unknown'), +20 in the type; capped at 100."""
    words = [w for w in query.lower().split() if len(w) > 2]
    idl = F.lower(contract_id)
    pl = F.lower(F.coalesce(parties, F.lit("Unknown")))
    tl = F.lower(F.coalesce(contract_type, F.lit("")))
    score = F.lit(0)
    for w in words:
        score = (score + F.when(idl.contains(w), 50).otherwise(0)
                 + F.when((pl != "unknown") & pl.contains(w), 30).otherwise(0)
                 + F.when(tl.contains(w), 20).otherwise(0))
    return F.least(score, F.lit(100))


def hybrid_search(collection: DataFrame, query: str, query_vec: list[float], n: int = 5,
                  id_col: str = "contract_id", vec_col: str = "embedding") -> DataFrame:
    """S3: hybrid = 0.7 * metadata score + 0.3 * (1 - distance) * 100, best n.
    A row without a vector gets distance 2.0 (J6)."""
    qv = F.array(*[F.lit(float(x)) for x in query_vec])
    dist = F.coalesce(1 - cosine_expr(F.col(vec_col).cast("array<double>"), qv), F.lit(2.0))
    ms = metadata_score(query, F.col(id_col), F.col("parties") if "parties" in collection.columns
                        else F.lit(None).cast("string"), F.col("contract_type"))
    scored = collection.select("*", dist.alias("distance"), ms.alias("metadata_score"))
    scored = scored.withColumn("semantic_score", (1 - F.col("distance")) * 100) \
        .withColumn("hybrid_score", F.col("metadata_score") * 0.7 + F.col("semantic_score") * 0.3)
    return scored.orderBy(F.desc("hybrid_score"), F.asc(id_col)).limit(n)


def render_results(results: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """One display line block per result (score line + 300-char excerpt)."""
    return results.select(
        id_col,
        F.format_string("Match: %.1f%% (Name/Party: %.0f%%, Content: %.1f%%)",
                        F.col("hybrid_score"), F.col("metadata_score").cast("double"),
                        F.col("semantic_score")).alias("score_line"),
        F.concat(F.substring(F.coalesce(F.col("text"), F.lit("")), 1, 300), F.lit("...")).alias("excerpt"))


def dimension_check(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Distinct vector dimensions of a collection with row counts; a
    collection is consistent when exactly one dimension is present."""
    return vectors.groupBy(F.size(vec_col).alias("dim")).agg(F.count(F.lit(1)).alias("n_vectors"))


def dimension_rejects(vectors: DataFrame, expected_dim: int, id_col: str = "vec_id",
                      vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector length differs from the collection's dimension."""
    return vectors.where(F.size(vec_col) != expected_dim).select(
        id_col, F.size(vec_col).alias("dim"), F.lit(expected_dim).alias("expected_dim"))
