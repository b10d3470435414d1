"""Operator 11: hard negatives by BOND, a vertical scan with shrinking candidate bitmaps.

A shard holds a few thousand rows column by column, with the smallest and largest value
of each column.  For one anchor the columns are read in the order of the anchor's
components, largest magnitude first.  After every few columns each candidate's score lies
between its partial score plus the least and plus the largest share that the unread
columns can add; candidates whose interval cannot matter leave the bitmap, and the next
columns are read for the rest only.

1. **Positives.**  Candidates are the other rows of the anchor's label.  One leaves when its
   interval ends below the ``n_pos``-th best score found so far.
2. **Negatives.**  Each positive score p opens the window ``low * p <= 100 * s <= high * p``.
   Candidates are the rows of other labels.  One leaves when its interval meets no window
   above that window's ``n_neg``-th best score so far.

What is left when all columns are read has its exact score.  Lists of shards are merged by
score, then by id.  Every bound only drops rows that cannot be in a result, ties included.

Rows with a NULL id, label or vector, or a NULL, NaN or infinite component take no part.
Rows that repeat an id count once (the first by components, then label).  An anchor without
positives, or whose windows are empty, has no rows; so has an empty table.  Only vectors of
the same length meet.  Scores must fit a double exactly (below 2**53).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import run_folder, shuffle_partitions, stage
from .vectors import QUERY_ROWS, block_of, blocks_of, pack, valid_vectors

N_POS, N_NEG = 5, 3
LOW, HIGH = 50, 95             # percent of the positive's score
COLUMNS = 16                   # columns read between two prunings
SHARD_ROWS = 8192
EXACT_SHORT = 2.0 ** 24


class Shard:
    """Rows of a shard by column, with each column's range."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray):
        self.ids, self.label = ids, mat[:, -1]
        cols = mat[:, :-1].T
        self.lo, self.hi = (cols.min(1), cols.max(1)) if len(ids) else (np.zeros(len(cols)),) * 2
        self.size = max(-self.lo.min(initial=0), self.hi.max(initial=0))
        self.cols = np.ascontiguousarray(cols)
        self.short = self.cols.astype(np.float32)

    def scan(self, q: np.ndarray, bitmap: np.ndarray, floor: float, keeps) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that ``keeps(least, largest)`` never drops.

        Columns whose rest could still lift a partial score of nothing to ``floor`` are read
        before the first pruning: it would drop next to no row earlier."""
        order = np.argsort(-np.abs(q), kind="stable")
        share = q * self.lo, q * self.hi
        # what the columns behind each position of the order can add
        least, most = (np.r_[np.cumsum(f(*share)[order][::-1])[::-1], 0] for f in (np.minimum, np.maximum))
        exact = np.abs(q).max(initial=0) * self.size * len(q) < EXACT_SHORT      # sums fit a float of 24 bits
        cols, weight = (self.short, q.astype(np.float32)) if exact else (self.cols, q)
        at = np.flatnonzero(bitmap)
        i = min(len(order), max(COLUMNS, int(np.searchsorted(-most, -floor, side="right")))) if floor > -np.inf else len(order)
        read = order[:i]
        if 4 * len(at) < len(bitmap):
            part = (weight[read] @ cols[np.ix_(read, at)]).astype(np.float64)
        else:                                             # most rows: whole columns, then the bitmap
            part = (weight[read] @ cols[read])[at].astype(np.float64)
        while True:
            keep = keeps(part + least[i], part + most[i])
            at, part = at[keep], part[keep]
            if i == len(order) or not len(at):
                return at, part
            read = order[i:i + COLUMNS]
            part = part + weight[read] @ cols[np.ix_(read, at)]
            i = min(i + COLUMNS, len(order))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score down, then id up."""
    return np.lexsort((ids, -scores))[:k]


def positives(shard: Shard, qid: int, q: np.ndarray, label: float, k: int, kth: float):
    """(ids, scores) of the k best rows of the anchor's label that reach ``kth``, ties kept."""
    bitmap = (shard.label == label) & (shard.ids != qid)
    bar = [kth]

    def keeps(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) >= k:                    # k candidates are sure to reach this
            bar[0] = max(bar[0], np.partition(least, len(least) - k)[len(least) - k])
        return most >= bar[0]

    at, s = shard.scan(q, bitmap, kth, keeps)
    first = best(shard.ids[at], s, k)
    return shard.ids[at[first]], s[first]


def negatives(shard: Shard, q: np.ndarray, label: float, windows: np.ndarray, k: int, low: int, high: int,
              kth: np.ndarray):
    """(window, ids, scores): the k best rows of other labels in each window; ``windows`` are
    the positives' scores and ``kth`` each one's k-th best score so far."""
    floor = np.maximum(low * windows, 100 * kth)
    bottom, top = floor.min(), high * windows.max()

    def keeps(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        fits = (100 * most >= bottom) & (100 * least <= top)
        some = np.flatnonzero(fits)
        if len(windows) > 1 and len(some):
            fits[some] = ((100 * most[some, None] >= floor) & (100 * least[some, None] <= high * windows)).any(1)
        return fits

    at, s = shard.scan(q, shard.label != label, bottom / 100, keeps)
    ids, out = shard.ids[at], []
    for w, p in enumerate(windows):
        fits = np.flatnonzero((100 * s >= floor[w]) & (100 * s <= high * p))
        first = fits[best(ids[fits], s[fits], k)]
        out.append((np.full(len(first), w), ids[first], s[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _paired(b: pa.RecordBatch, extra: int) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    """Each row of a batch: the shard, the anchors' ids, and their components, label and
    ``extra`` further values."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    shards: dict[int, Shard] = {}
    for r in range(b.num_rows):
        dim = col["dim"][r].as_py()
        no = col["shard"][r].as_py()
        if (dim, no) not in shards:
            ids = np.frombuffer(col["ids"][r].as_buffer(), np.int64)
            shards = {(dim, no): Shard(ids, np.frombuffer(col["mat"][r].as_buffer(), np.float64).reshape(len(ids), dim))}
        qids = np.frombuffer(col["q_ids"][r].as_buffer(), np.int64)
        yield shards[dim, no], qids, np.frombuffer(col["q_mat"][r].as_buffer(), np.float64).reshape(len(qids), dim + extra)


def _pairs(shards: DataFrame, anchors: DataFrame, n_shards: int, extra: int, tasks: int) -> DataFrame:
    """Every shard with every block of anchors: the anchors, far fewer, are copied; a shard
    goes to one task, which reads its blocks of anchors one after the other."""
    copies = anchors.select((F.col("dim") - extra).alias("dim"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"),
                            F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    return (shards.repartition(tasks, "dim", "shard").join(copies.repartition(tasks, "dim", "shard"), ["dim", "shard"])
            .select("dim", "shard", "ids", "mat", "q_ids", "q_mat"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", n_pos: int = N_POS, n_neg: int = N_NEG, low: int = LOW,
                   high: int = HIGH, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every
    row for which ``is_anchor`` holds.

    Components become ``floor(scale * x)``.  Rows are hashed into shards of about 8,192 and
    anchors into blocks of 512, so a label that many rows have is spread like any."""
    spark = vectors.sparkSession
    folder, parts = run_folder(spark), shuffle_partitions(spark)
    flag = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("vec"), vectors[label_col].cast("long").alias("lab"),
                          F.coalesce(is_anchor, F.lit(False)).alias("chosen")).filter("lab IS NOT NULL")
    whole = lambda x: F.floor(x.cast("double") * scale)

    def rows(df: DataFrame) -> DataFrame:      # the label is the last column of a row
        labelled = df.withColumn("vec", F.when(F.col("vec").isNotNull(), F.concat(
            F.transform("vec", whole).cast("array<double>"), F.array(F.col("lab").cast("double")))))
        return valid_vectors(labelled, "vec_id", "vec")

    items = rows(flag)
    n_shards = blocks_of(items.count(), SHARD_ROWS)
    shards = stage(pack(items.withColumn("shard", block_of("id", n_shards)), ["dim", "shard"]), folder, "shards")
    anchors = rows(flag.filter("chosen"))
    n_blocks = blocks_of(anchors.count(), QUERY_ROWS)
    anchors = stage(anchors.withColumn("part", block_of("id", n_blocks)), folder, "anchors")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for shard, qids, q in _paired(b, 0):
                for i, a in enumerate(qids.tolist()):
                    ids, s = kept.get(a, (np.zeros(0, np.int64), np.zeros(0)))
                    kth = s[-1] if len(s) == n_pos else -np.inf
                    ids2, s2 = positives(shard, a, q[i, :-1], q[i, -1], n_pos, kth)
                    ids, s = np.r_[ids, ids2], np.r_[s, s2]
                    first = best(ids, s, n_pos)
                    kept[a] = ids[first], s[first]
            yield _lists(kept, ["anchor_id", "positive_id", "positive_score"])

    found = _pairs(shards, pack(anchors, ["dim", "part"]), n_shards, 0, parts).mapInArrow(
        find_positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = stage(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_pos), folder, "positives")

    # anchors again, with the scores that open their windows behind the label (NaN: none)
    scores = found.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("at"))
    no = F.lit(float("nan"))
    again = (anchors.join(scores, anchors["id"] == scores["anchor_id"])
             .withColumn("vec", F.concat("vec", F.transform(F.sequence(F.lit(1), F.lit(n_pos)), lambda i: F.coalesce(
                 F.element_at("at", i).cast("double"), no))))
             .withColumn("dim", F.col("dim") + n_pos).select("dim", "part", "id", "vec"))

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}
            for shard, qids, q in _paired(b, n_pos):
                for i, a in enumerate(qids.tolist()):
                    windows = np.unique(q[i, -n_pos:])
                    windows = windows[windows >= 0]          # a negative score's window is empty
                    if not len(windows):
                        continue
                    old = [kept.get((a, p), (np.zeros(0, np.int64), np.zeros(0))) for p in windows]
                    kth = np.array([s[-1] if len(s) == n_neg else -np.inf for _, s in old])
                    w, ids2, s2 = negatives(shard, q[i, :-n_pos - 1], q[i, -n_pos - 1], windows, n_neg, low, high, kth)
                    for j, p in enumerate(windows):
                        ids, s = np.r_[old[j][0], ids2[w == j]], np.r_[old[j][1], s2[w == j]]
                        first = best(ids, s, n_neg)
                        kept[a, p] = ids[first], s[first]
            yield _lists(kept, ["anchor_id", "positive_score", "negative_id", "negative_score"])

    lists = _pairs(shards, pack(again, ["dim", "part"]), n_shards, n_pos, parts).mapInArrow(
        find_negatives, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_neg)
    return found.join(lists, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _lists(kept: dict, names: list[str]) -> pa.RecordBatch:
    """Rows of the lists in ``kept``: key columns, then ids and scores."""
    n = [len(ids) for ids, _ in kept.values()]
    keys = [k if isinstance(k, tuple) else (k,) for k in kept]
    cols = [np.repeat(np.array([k[i] for k in keys], np.int64), n) for i in range(len(names) - 2)]
    for i in range(2):
        cols.append(np.concatenate([np.zeros(0, np.int64), *(v[i].astype(np.int64) for v in kept.values())]))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
