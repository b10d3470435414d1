"""Operator 4: quality classifier by ordinal cumulative-link regression.

Graded ratings 0 < 1 < ... < G-1 share one weight vector over hashed text features;
ordered thresholds t_1 < ... < t_{G-1} cut the score s = w.x:

    P(grade < k) = 1 / (1 + exp(-(t_k - s)))

Every document gets the expected grade and the tail probability P(grade >= top);
documents with a tail probability of at least ``keep_at`` are selected.

Features are presences of 64-bit hashes: runs of letters (A-Z lower-cased) and their
beginnings, runs of digits, runs of other characters, and shares of capitals, symbols
and repeated runs in steps of an eighth.  A hash is used if at least ``MIN_SHARE`` of the
training rows (and ``MIN_ROWS``) have it and its chi-square against the grades reaches
``MIN_SCORE``; of these the ``MAX_FEATURES`` highest.  So noise has no weight, hashes
don't collide in practice and weights are a bounded array.

The fit uses a bounded sample: all rated documents, or of more than ``MAX_TRAIN``
those with the smallest hashed ids (a fixed share of the hash range, at most a few
per cent more rows).  Loss and gradient are sums over tasks; L-BFGS on the driver
holds only the weights.  Scoring covers every document and whole texts.

NULL and empty texts have no features but are scored by the thresholds alone;
they are not selected, as there is nothing to keep.  A document with several ratings
counts with the lowest; NULL ratings are ignored.  Without ratings every other
document is selected.  Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_i64, flat_text, mix64, run_folder, span_hashes, stage, text_blocks

MAX_TRAIN = 20_000
MAX_FEATURES = 8_192
MIN_SCORE = 30.0               # chi-square of a feature against the grades
STEMS = (4, 6)                 # bytes of word beginnings
MIN_ROWS = 4
MIN_SHARE = 0.0005
RIDGE = 0.1                    # weight penalty: RIDGE / 2 * |w|^2 over the whole sample
STEPS = 60
FIT_TASKS = 12
SHARE_STEPS = 8
KEEP_AT = 0.5

_CLASS = np.full(256, 3, np.uint8)                 # 0 blank, 1 letter, 2 digit, 3 other
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


def features(col: pa.Array) -> list[np.ndarray]:
    """Distinct feature hashes of each text, ascending."""
    off, data = flat_text(col)
    n = len(off) - 1
    if len(data) == 0:
        return [np.zeros(0, U64)] * n
    kind = _CLASS[data]
    cut = np.zeros(len(data), bool)
    cut[0] = True
    cut[1:] = kind[1:] != kind[:-1]
    cut[off[:-1][off[:-1] < len(data)]] = True
    s = np.flatnonzero(cut)
    e = np.r_[s[1:], len(data)]
    k = kind[s]
    s, e, k = s[k > 0], e[k > 0], k[k > 0]
    row = np.searchsorted(off, s, side="right") - 1
    h = span_hashes(data, s, e)
    h[k == 2] = U64(2)                             # any number
    same = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & (k[1:] == 1)]
    letters = np.bincount(row, weights=(e - s) * (k == 1), minlength=n)
    caps = np.add.reduceat(np.r_[(data >= 65) & (data <= 90), False].astype(np.int64), np.minimum(off[:-1], len(data)))
    caps = np.where(np.diff(off) > 0, caps, 0)
    runs = np.bincount(row, minlength=n)
    stems = [(row[k == 1], _stem(data, s[k == 1], e[k == 1], size)) for size in STEMS]
    shares = (caps / np.maximum(letters, 1), np.bincount(row, weights=k == 3, minlength=n) / np.maximum(runs, 1),
              np.bincount(row, weights=same, minlength=n) / np.maximum(runs, 1))
    more_row, more_h = [], []
    for i, share in enumerate(shares):
        for step in range(1, SHARE_STEPS + 1):
            at = np.flatnonzero(share * SHARE_STEPS >= step)
            more_row.append(at)
            more_h.append(np.full(len(at), mix64(np.array([(i + 1) * 1000 + step], U64))[0], U64))
    row = np.concatenate([row, *more_row, *(r for r, _ in stems)])
    h = np.concatenate([h, *more_h, *(x for _, x in stems)])
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=n))[:-1]
    return [np.unique(x) for x in np.split(h[order], ends)]


def _stem(data: np.ndarray, s: np.ndarray, e: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of runs, apart from those of whole runs."""
    return mix64(span_hashes(data, s, np.minimum(e, s + size)) + U64(size))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(grade, f): grade and distinct feature hashes of training rows (grade, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            f = [as_i64(x) for x in features(b.column(1))]
            off = np.concatenate([[0], np.cumsum([len(x) for x in f])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(f)))],
                names=["grade", "f"])

    return docs.select("grade", "text").mapInArrow(run, "grade int, f array<long>")


def cumulative(s: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 0..G of every score (columns)."""
    inner = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - s[:, None], -500, 500)))
    return np.column_stack([np.ones(len(s)), inner, np.zeros(len(s))])


def loss_and_gradient(idx: np.ndarray, off: np.ndarray, grade: np.ndarray, w: np.ndarray, theta: np.ndarray):
    """Sum of -log P(grade) over rows, its gradient by weight and by threshold.

    Row r has the features ``idx[off[r]:off[r + 1]]``."""
    row = np.repeat(np.arange(len(grade)), np.diff(off))
    s = np.bincount(row, weights=w[idx], minlength=len(grade))
    at_least = cumulative(s, theta)
    r = np.arange(len(grade))
    hi, lo = at_least[r, grade], at_least[r, grade + 1]
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_score = d_lo - d_hi
    g_w = np.bincount(idx, weights=by_score[row], minlength=len(w))
    g_t = np.zeros(len(theta) + 2)
    np.add.at(g_t, grade, d_hi)
    np.subtract.at(g_t, grade + 1, d_lo)
    return float(-np.log(p).sum()), g_w, g_t[1:-1]


def lbfgs(f, x: np.ndarray, steps: int, memory: int = 8, tol: float = 1e-3) -> np.ndarray:
    """Minimise ``f(x) -> (value, gradient)``."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, grad @ q
        while True:
            new = x - step * q
            v, g = f(new)
            if v <= value - 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if v >= value:
            break
        if (g - grad) @ (new - x) > 1e-12:
            pairs = [*pairs[1 - memory:], (new - x, g - grad)]
        done = value - v < tol * abs(v)
        x, value, grad = new, v, g
        if done:
            break
    return x


def fit(rated: DataFrame, folder: str, n_grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes ascending, weights, thresholds) from rows (grade, text)."""
    rows = stage(feature_rows(rated), folder, "features")
    per_grade = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(per_grade.values())
    share = np.cumsum([per_grade.get(g, 0) + 0.5 for g in range(n_grades)])[:-1] / (n + 0.5 * n_grades)
    theta = np.log(share / (1 - share))
    if n == 0:
        return np.zeros(0, U64), np.zeros(0), np.full(n_grades - 1, -20.0)
    least = max(MIN_ROWS, math.ceil(MIN_SHARE * n))
    by_grade = [F.count(F.when(F.col("grade") == g, 1)).alias(f"n{g}") for g in range(n_grades)]
    score = F.lit(0.0)
    for g in range(n_grades):
        p = per_grade.get(g, 0) / n
        if 0 < p < 1:
            score += F.pow(F.col(f"n{g}") - F.col("n") * p, F.lit(2.0)) / (F.col("n") * p)
    chosen = (rows.select("grade", F.explode("f").alias("f")).groupBy("f")
              .agg(F.count(F.lit(1)).alias("n"), *by_grade).filter(F.col("n") >= least)
              .withColumn("score", score).filter(F.col("score") >= MIN_SCORE)
              .orderBy(F.desc("score"), "f").limit(MAX_FEATURES).toPandas())
    hashes = np.sort(chosen["f"].to_numpy(np.int64).view(U64))
    sc = rows.sparkSession.sparkContext
    known = sc.broadcast(hashes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch as one row: all feature numbers, row offsets, grades."""
        for b in batches:
            at, end, hs = [], [0], known.value
            for x in b.column(1):
                h = np.asarray(x.values, dtype=np.int64).view(U64)
                k = np.minimum(np.searchsorted(hs, h), max(len(hs) - 1, 0))
                at.append(k[hs[k] == h] if len(hs) else k[:0])
                end.append(end[-1] + len(at[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in (
                    (np.concatenate(at), np.int32), (np.array(end), np.int64), (np.asarray(b.column(0)), np.int32))],
                names=["idx", "off", "grade"])

    # the sample is bounded, so a few tasks hold it; each returns one gradient
    small = stage(rows.repartition(FIT_TASKS).mapInArrow(number, "idx binary, off binary, grade binary"),
                  folder, "numbered")

    def evaluate(x: np.ndarray):
        w, gaps = x[:len(hashes)], x[len(hashes):]
        t = np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))])
        sent = sc.broadcast((w, t))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, t = sent.value
            total, g_w, g_t = 0.0, np.zeros(len(w)), np.zeros(len(t))
            for b in batches:
                for i in range(b.num_rows):
                    idx, off, grade = (np.frombuffer(b.column(c)[i].as_buffer(), ty) for c, ty in
                                       ((0, np.int32), (1, np.int64), (2, np.int32)))
                    v, a, c = loss_and_gradient(idx, off, grade, w, t)
                    total, g_w, g_t = total + v, g_w + a, g_t + c
            yield pa.RecordBatch.from_arrays(
                [pa.array([total]), pa.array([np.concatenate([g_w, g_t]).tobytes()], pa.binary())], names=["v", "g"])

        parts = small.mapInArrow(run, "v double, g binary").collect()      # a row for each of few tasks
        sent.unpersist()
        grad = sum((np.frombuffer(p.g) for p in parts), np.zeros(len(w) + len(t)))
        g_w, g_t = grad[:len(w)] + RIDGE * w, grad[len(w):]
        g_gap = np.cumsum(g_t[::-1])[::-1].copy()
        g_gap[1:] *= np.exp(gaps[1:])
        return sum(p.v for p in parts) + RIDGE / 2 * float(w @ w), np.concatenate([g_w, g_gap])

    start = np.concatenate([np.zeros(len(hashes)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    best = lbfgs(evaluate, start, STEPS)
    gaps = best[len(hashes):]
    return hashes, best[:len(hashes)], np.concatenate([gaps[:1], gaps[:1] + np.cumsum(np.exp(gaps[1:]))])


def rated_sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(grade, text) of the rated documents, about ``limit`` of them at most."""
    one = ratings.groupBy("id").agg(F.min("grade").alias("grade"))
    n = one.count()
    if n > limit:                                   # a fixed share of the hash range
        share = int(limit / n * (1 << 30))
        one = one.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.join(F.broadcast(one), "id").select("grade", "text")     # limit rows of two numbers


def fit_documents(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str, text_col: str, max_train: int):
    folder = run_folder(docs.sparkSession)
    ratings = ratings.select("id", F.col("grade").cast("int").alias("grade")).filter(
        "id IS NOT NULL AND grade IS NOT NULL")
    return fit(rated_sample(docs, ratings, id_col, text_col, max_train), folder, n_grades)


def probabilities(texts: pa.Array, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """P(grade >= k) of each text, for k = 0..G."""
    hashes, w, theta = model
    f = features(texts)
    s = np.zeros(len(f))
    if len(hashes):
        row, h = np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate(f)
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        s = np.bincount(row, weights=np.where(hashes[k] == h, w[k], 0.0), minlength=len(f))
    return cumulative(s, theta)


def kept(texts: pa.Array, at_least: np.ndarray, keep_at: float) -> np.ndarray:
    return (at_least[:, -2] >= keep_at) & (np.diff(flat_text(texts)[0]) > 0)


def classify(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
             keep_at: float = KEEP_AT, max_train: int = MAX_TRAIN) -> DataFrame:
    """id, expected_grade, tail_probability, grade, keep of every row.

    ``ratings``: (id, grade int from 0 to n_grades - 1), any number per document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, ratings, n_grades, id_col, text_col, max_train))
    names = [id_col, "expected_grade", "tail_probability", "grade", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "_t"):
            at_least = probabilities(b.column(1), sent.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(at_least[:, 1:-1].sum(1)), pa.array(at_least[:, -2]),
                 pa.array(np.argmax(at_least[:, :-1] - at_least[:, 1:], axis=1).astype(np.int32)),
                 pa.array(kept(b.column(1), at_least, keep_at))], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].alias("_t")).mapInArrow(
        run, f"{id_col} {id_type}, expected_grade double, tail_probability double, grade int, keep boolean")


def select_documents(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id",
                     text_col: str = "text", keep_at: float = KEEP_AT, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, ratings, n_grades, id_col, text_col, max_train))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text_col):
            keep = kept(b.column(at), probabilities(b.column(at), sent.value), keep_at)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def corpus_ratings(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: how many of "good quality" and "not toxic" hold.

    Low quality and toxicity each take one grade, which suits one additive score."""
    grade = F.col("quality").cast("int") + 1 - F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade"))


GRADES = 3
