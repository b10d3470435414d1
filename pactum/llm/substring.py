"""Operator 12: exact repeats across documents by fixed-block anchors.

A window is ``window`` consecutive words of a document.  It is a repeat if its words also
start somewhere in a document with a smaller id; the words that repeats cover go.  With
blocks of ``(window + 1) // 2`` words every window holds one block that is aligned in its
document, so two documents that share a window share an aligned block of the first.

1. **Anchors.**  Every document's aligned blocks are the reference index, and the window of a
   block's length at every word probes it.  Tasks hash a chunk of documents, keep one entry
   for each distinct hash of the chunk and exchange the entries by hash bucket, 32 bits each.  A
   hash that two documents of a chunk have is a hit at once and needs no answer, so a passage
   that every document holds costs one entry for each chunk.  A bucket answers which hashes
   were seen twice, aligned at least once: these are hits, possibly too many, never too few.
2. **Extension.**  A hit stretches to all windows around it.  Only these go into a second
   exchange, with their position and the least id of the chunk; the others of the chunk
   are known to be repeats.  A bucket says which entries have a smaller id elsewhere.
   Neighbouring repeats join into the maximal spans.
3. **Texts** of documents with hits, and in the end of those with repeats, are found by a
   Bloom filter and joined exactly; all others are answered in one pass.

Buckets grow in number with the text, and no exchange sends more than one entry of a chunk
for a hash (but for the positions of one document), so common passages stay small.

Windows are compared by 64-bit hashes of their words.  Ids are integers.  A NULL id is neither
smaller nor greater than another: nothing of its row goes, and it hides nothing.  Repeated
rows and rows of one id don't repeat each other and get equal answers.  A NULL, empty or blank
text has no words; one with fewer words than a window keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat_text, mix64, run_folder, shuffle_partitions, span_hashes, stage, text_blocks, word_spans
from .url_cascade import Cascade, bloom_level

WINDOW = 13
CHUNK_BYTES = 1 << 21          # text of a chunk
BUCKET_BYTES = 1 << 23         # text whose anchors a bucket holds
BUCKET_WINDOWS = 1 << 19       # windows around hits that a bucket holds
MAX_FILTER_BITS = 1 << 28      # the filter of documents with hits; fuller ones only pass more rows
NOBODY = 65535                 # stands for all documents of a chunk that need no answer
KEYED = "id long, h long, text string"
PACKED = "bucket int, chunk long, who binary, ids binary, counts binary, vals binary, pos binary"


def rolling(h: np.ndarray, row: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether the text has so many."""
    mult = mix64(np.arange(1, width + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    k = max(0, len(h) - width + 1)
    out, fits = np.zeros(len(h), U64), np.zeros(len(h), bool)
    for j in range(width):
        out[:k] += h[j:j + k] * mult[j]
    fits[:k] = row[:k] == row[width - 1:width - 1 + k]
    return mix64(out), fits


class Chunk:
    """Words of a few documents: hash, document and position of each."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, self.h = (np.asarray(b.column(i), dtype=np.int64) for i in (0, 1))
        off, data = flat_text(b.column(2))
        s, e, self.row = word_spans(off, data)
        self.words = span_hashes(data, s, e, lower=False)
        first = np.searchsorted(self.row, np.arange(len(self.ids)))
        self.pos = np.arange(len(self.row)) - first[self.row]
        # a chunk is named by what it holds, so a repeated task names it alike
        both = mix64(self.ids.view(U64)) + self.h.view(U64)
        self.name = int(mix64(np.array([np.bitwise_xor.reduce(mix64(both * U64(3)), initial=U64(len(both)))]))[0].view(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_blocks(batches, limit=CHUNK_BYTES):
        for i in range(0, b.num_rows, NOBODY):               # documents of a chunk are counted in 16 bits
            yield b.slice(i, NOBODY)


def _packed(name: int, bucket: np.ndarray, who: np.ndarray, vals: np.ndarray, pos: np.ndarray | None,
            ids: np.ndarray | None, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket: its documents (who, ids, counts) and their entries."""
    order = np.lexsort((who, bucket))
    bucket, who, vals = bucket[order], who[order], vals[order]
    pos = None if pos is None else pos[order].astype(np.int32)
    ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = slice(ends[b], ends[b + 1])
        docs, counts = np.unique(who[at], return_counts=True)
        rows.append((b, name, docs.astype(np.uint16).tobytes(), None if ids is None else ids[docs].tobytes(),
                     counts.astype(np.int32).tobytes(), vals[at].tobytes(), None if pos is None else pos[at].tobytes()))
    return _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["bucket", "chunk", "who", "ids", "counts", "vals", "pos"])


def _answered(c: Chunk, who: np.ndarray, vals: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Two rows that pass through the exchange: the chunk's documents (bucket -1 - b) and
    what the chunk knows by itself."""
    b = -1 - abs(c.name) % n_buckets
    return _rows([(b, c.name, None, c.ids.tobytes(), None, c.h.tobytes(), None),
                  (b, c.name, who.astype(np.uint16).tobytes(), None, None, vals.tobytes(), None)])


def _joined(t: pa.Table, name: str, kind: str) -> tuple[np.ndarray, list[int]]:
    parts = [x.as_py() or b"" for x in t.column(name)]
    return np.frombuffer(b"".join(parts), kind), [len(p) // np.dtype(kind).itemsize for p in parts]


def _runs(sorted_vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each run of equal values, and the run of each position."""
    new = np.r_[True, sorted_vals[1:] != sorted_vals[:-1]][:len(sorted_vals)]
    return np.flatnonzero(new), np.cumsum(new) - 1


# -------------------------------------------------------------------------- anchors

def _composite(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 31 bits shifted left by one) of block hashes."""
    return ((h >> U64(40)) % U64(n_buckets)).astype(np.int64), (h & U64(0xFFFFFFFE)).astype(np.uint32)


def probe(block: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            c = Chunk(b)
            h, fits = rolling(c.words, c.row, len(c.ids), block)
            bucket, low = _composite(h[fits], n_buckets)
            who, aligned = c.row[fits], c.pos[fits] % block == 0
            key = (bucket.astype(U64) << U64(32)) | low
            order = np.argsort(key, kind="stable")
            key, who, aligned = key[order], who[order], aligned[order]
            first, of = _runs(key)
            last = np.r_[first[1:], len(key)] - 1
            several = who[first] != who[last] if len(key) else np.zeros(0, bool)
            any_aligned = np.bitwise_or.reduceat(aligned, first) if len(key) else np.zeros(0, bool)
            yield _packed(c.name, (key[first] >> U64(32)).astype(np.int64), np.where(several, NOBODY, who[first]),
                          (key[first] & U64(0xFFFFFFFF)).astype(np.uint32) | any_aligned.astype(np.uint32), None, None, n_buckets)
            here = several[of]
            yield _answered(c, who[here], key[here], n_buckets)
    return run


def hits(t: pa.Table) -> pa.Table:
    """The hits of a bucket, for each chunk: who, and which hashes."""
    if t.column("bucket")[0].as_py() < 0:
        return t.select(["chunk", "who", "ids", "vals"])
    vals, n = _joined(t, "vals", "u4")
    order = np.argsort(vals >> 1, kind="stable")
    first, of = _runs((vals >> 1)[order])
    seen = np.diff(np.r_[first, len(vals)])
    aligned = np.bitwise_or.reduceat((vals & 1)[order], first) if len(vals) else vals
    hit = np.zeros(len(vals), bool)
    hit[order] = ((seen > 1) & (aligned > 0))[of]
    bucket = U64(t.column("bucket")[0].as_py()) << U64(32)
    whos, counts = _joined(t, "who", "u2")[0], _joined(t, "counts", "i4")[0]
    who = np.repeat(whos, counts)
    hit &= who != NOBODY
    ends = np.cumsum([0, *n])
    out = []
    for r, chunk in enumerate(t.column("chunk").to_pylist()):
        at = ends[r] + np.flatnonzero(hit[ends[r]:ends[r + 1]])
        if len(at):
            out.append((chunk, who[at].tobytes(), None, (bucket | (vals[at] & np.uint32(0xFFFFFFFE)).astype(U64)).tobytes()))
    return _four(out)


def _four(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64() if n == "chunk" else pa.binary())
                     for i, n in enumerate(("chunk", "who", "ids", "vals"))})


def by_document(t: pa.Table) -> pa.Table:
    """What came back for a chunk, as one row for each of its documents: distinct values."""
    table = t.column("ids").is_valid()
    docs = t.filter(table)
    ids, h = _joined(docs.slice(0, 1), "ids", "i8")[0], _joined(docs.slice(0, 1), "vals", "i8")[0]
    rest = t.filter(pc.invert(table))
    who, vals = _joined(rest, "who", "u2")[0], _joined(rest, "vals", "u8")[0]
    order = np.lexsort((vals, who))
    who, vals = who[order], vals[order]
    keep = np.r_[True, (who[1:] != who[:-1]) | (vals[1:] != vals[:-1])][:len(who)]
    who, vals = who[keep], vals[keep]
    first, _ = _runs(who)
    ends = np.r_[first[1:], len(who)]
    return pa.table({"id": pa.array(ids[who[first]]), "h": pa.array(h[who[first]]), "n": pa.array(ends - first),
                     "vals": pa.array([vals[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())})


def _exchange(rows: DataFrame, answer) -> DataFrame:
    """(id, h, n, vals): the answers of all buckets to each document."""
    return (rows.groupBy("bucket").applyInArrow(answer, "chunk long, who binary, ids binary, vals binary")
            .groupBy("chunk").applyInArrow(by_document, "id long, h long, n long, vals binary"))


# ------------------------------------------------------------------------ extension

def extend(window: int, block: int, n_anchor: int, n_buckets: int):
    """Windows around the hits of (id, h, text, vals) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            c = Chunk(b)
            h, fits = rolling(c.words, c.row, len(c.ids), block)
            bucket, low = _composite(h, n_anchor)
            key = (bucket.astype(U64) << U64(32)) | low
            known, n = _joined(pa.table({"v": b.column(3)}), "v", "u8")
            spread = lambda k, who: mix64(k + who.astype(U64) * U64(0x9E3779B97F4A7C15))
            hit = fits & np.isin(spread(key, c.row), spread(known, np.repeat(np.arange(len(n)), n)))
            before = np.r_[0, np.cumsum(hit)]
            h, fits = rolling(c.words, c.row, len(c.ids), window)
            ahead = np.minimum(np.arange(len(h)) + window - block + 1, len(h))
            at = np.flatnonzero(fits & (before[ahead] > before[:-1]))
            h, who, pos = h[at], c.row[at], c.pos[at]
            order = np.lexsort((c.ids[who], h))
            h, who, pos = h[order], who[order], pos[order]
            first, of = _runs(h)
            later = c.ids[who] > c.ids[who[first]][of] if len(h) else np.zeros(0, bool)
            least = ~later
            yield _packed(c.name, ((h[least] >> U64(40)) % U64(n_buckets)).astype(np.int64), who[least], h[least],
                          pos[least], c.ids, n_buckets)
            yield _answered(c, who[later], pos[later].astype(np.int64), n_buckets)
    return run


def repeated(t: pa.Table) -> pa.Table:
    """The windows of a bucket that a smaller id has too, for each chunk: who and where."""
    if t.column("bucket")[0].as_py() < 0:
        return t.select(["chunk", "who", "ids", "vals"])
    vals, n = _joined(t, "vals", "u8")
    pos, whos, ids, counts = (_joined(t, c, k)[0] for c, k in (("pos", "i4"), ("who", "u2"), ("ids", "i8"), ("counts", "i4")))
    who, ids = np.repeat(whos, counts), np.repeat(ids, counts)
    order = np.lexsort((ids, vals))
    first, of = _runs(vals[order])
    again = np.zeros(len(vals), bool)
    again[order] = ids[order] > ids[order][first][of] if len(vals) else again
    ends = np.cumsum([0, *n])
    out = []
    for r, chunk in enumerate(t.column("chunk").to_pylist()):
        at = ends[r] + np.flatnonzero(again[ends[r]:ends[r + 1]])
        if len(at):
            out.append((chunk, who[at].tobytes(), None, pos[at].astype(np.int64).tobytes()))
    return _four(out)


# ---------------------------------------------------------------------------- texts

def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]


OUT = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def kept_words(window: int, starts: bool):
    """Answers of (id, h, text[, vals]) rows; ``vals`` are the starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, limit=CHUNK_BYTES):
            total, gone, spans, kept = [], [], [], []
            off, data = flat_text(b.column(2))
            data = data.tobytes()
            for i in range(b.num_rows):
                words = data[off[i]:off[i + 1]].split()      # splits at 0x20 and 0x09-0x0D
                total.append(len(words))
                found = b.column(3)[i].as_py() if starts else None
                if found:
                    at = np.frombuffer(found, np.int64)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    covered = np.cumsum(step[:-1]) > 0
                    spans.append(_spans(covered))
                    gone.append(int(covered.sum()))
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                else:
                    spans.append([])
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, _SPAN),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])
    return run


def _pair(df: DataFrame):
    return F.xxhash64(df["id"], df["h"]), F.xxhash64(df["id"], df["h"], F.lit(77))


def _parted(src: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``src`` whose (id, h) is surely not in ``found``, and all others."""
    spark, n = src.sparkSession, found.count()
    h1, h2 = _pair(found)
    rate = min(0.9, max(0.01, float(np.exp(-MAX_FILTER_BITS * np.log(2) ** 2 / max(n, 1)))))
    sent = spark.sparkContext.broadcast([bloom_level(found.select(h1.alias("h1"), h2.alias("h2")), n, rate)] if n else [])
    h1, h2 = _pair(src)
    marked = src.select("id", "h", "text", h1.alias("h1"), h2.alias("h2"))

    def rows(listed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = Cascade(sent.value)
            for b in batches:
                a, c = (np.asarray(b.column(i), dtype=np.int64) for i in (3, 4))
                hit = level.passes(a, c) if level.levels else np.zeros(len(a), bool)
                part = b.filter(pa.array(hit == listed))
                yield pa.RecordBatch.from_arrays(part.columns[:3], names=["id", "h", "text"])
        return marked.mapInArrow(run, KEYED)
    return rows(False), rows(True)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (maximal runs of removed words: start, end) and kept (the
    kept words joined by one space) of every row of ``docs``."""
    spark = docs.sparkSession
    folder, parts = run_folder(spark), shuffle_partitions(spark)
    block = (window + 1) // 2
    src = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    whole = src.filter("id IS NOT NULL AND text IS NOT NULL")

    # rows that repeat as a whole take part once
    double = stage(whole.groupBy("id", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id", "h"), folder, "double")
    once = whole
    if not double.isEmpty():
        single, doubtful = _parted(whole, double)
        once = single.union(doubtful.dropDuplicates(["id", "h"]))

    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_anchor = max(parts, -(-size // BUCKET_BYTES))
    found = stage(_exchange(once.mapInArrow(probe(block, n_anchor), PACKED), hits), folder, "hits")

    n_hits = found.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(parts, -(-n_hits * block // BUCKET_WINDOWS))
    _, listed = _parted(once, found)
    around = listed.join(found.drop("n"), ["id", "h"]).select("id", "h", "text", "vals")
    answers = stage(_exchange(around.mapInArrow(extend(window, block, n_anchor, n_buckets), PACKED), repeated), folder, "repeats")

    rest, listed = _parted(whole, answers)
    rest = rest.union(src.filter("id IS NULL OR text IS NULL"))
    changed = listed.join(answers.drop("n"), ["id", "h"], "left").select("id", "h", "text", "vals")
    out = rest.mapInArrow(kept_words(window, False), OUT).union(changed.mapInArrow(kept_words(window, True), OUT))
    return out.withColumnRenamed("id", id_col)
