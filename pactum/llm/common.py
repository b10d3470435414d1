"""Helpers shared by the operators: staged tables, Arrow text blocks, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table  # noqa: F401  (re-used by the query module)

U64 = np.uint64
BLOCK_BYTES = 1 << 20          # text bytes that one vectorised step handles
_GOLD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D     # odd, so powers have an inverse modulo 2**64
_MASK = (1 << 64) - 1


def run_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pactum-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``folder`` and read it back (cuts lineage)."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def most_frequent(counts: DataFrame, n_col: str, limit: int) -> tuple[DataFrame, int]:
    """The rows of ``counts`` with the largest ``n_col``: as many whole groups of equal
    counts as make at most ``limit`` rows, and the least count among them.

    Only the histogram of counts is ordered, so no task hands ``limit`` rows on."""
    hist = (counts.groupBy(n_col).agg(F.count(F.lit(1)).alias("_rows"))
            .orderBy(F.desc(n_col)).limit(limit).collect())
    total, least = 0, None
    for r in hist:
        total += r["_rows"]
        if total > limit:
            break
        least = r[n_col]
    if least is None:                    # no rows, or more equal ones than the limit
        return counts.limit(0), (hist[0][n_col] + 1 if hist else 0)
    return counts.filter(F.col(n_col) >= least), int(least)


# ---------------------------------------------------------------- text blocks

def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(_GOLD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOW = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POW = np.ones(1, dtype=U64)
_INV = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        one = np.ones(1, dtype=U64)
        _POW = np.concatenate([one, np.cumprod(np.full(n, _BASE, dtype=U64))])
        _INV = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=U64))])
    return _POW, _INV


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; NULL is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(len(col) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def byte_slices(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes (one row at least)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text",
                limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that each holds about ``limit`` bytes of text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        off, _ = flat_text(b.column(b.schema.get_field_index(text)))
        for i, j in byte_slices(off, limit):
            yield b.slice(i, j - i)


def word_spans(off: np.ndarray, data: np.ndarray):
    """Start, end (byte positions) and row of every maximal run of non-blank bytes.

    Blank bytes are 0x20 and 0x09-0x0D; no byte of a multi-byte UTF-8 character
    equals one of them, so byte runs are the words ``[^\\x20\\x09-\\x0D]+``."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)      # a row starts here
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, s, side="right") - 1
    return s, e, row


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span (A-Z lower-cased first)."""
    out = np.empty(len(s), dtype=U64)
    tab = _BYTE_LOW if lower else _BYTE
    i = 0
    while i < len(s):
        j = int(np.searchsorted(e, s[i] + BLOCK_BYTES, side="right"))
        j = max(j, i + 1)
        a, b = int(s[i]), int(e[j - 1])
        pw, inv = _powers(b - a + 1)
        acc = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(tab[data[a:b]] * pw[:b - a], out=acc[1:])
        ls, le = s[i:j] - a, e[i:j] - a
        out[i:j] = mix64((acc[le] - acc[ls]) * inv[ls] + (le - ls).astype(U64) * U64(_GOLD))
        i = j
    return out


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, row per word) of a text column, in text order."""
    off, data = flat_text(col)
    s, e, row = word_spans(off, data)
    return span_hashes(data, s, e), row


def word_hash(text: str) -> int:
    """The hash of one word given as a string (tests, fixed tokens)."""
    b = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0


def as_i64(a: np.ndarray) -> np.ndarray:
    return a.astype(U64, copy=False).view(np.int64)
