"""Operator 13: spelling variants by a bit-sliced position index over the vocabulary.

1. **Words.**  Tasks cut the texts into letter runs, apply the noise of the contract and
   count; Spark adds the counts up.  The vocabulary holds the words that are long and
   frequent enough.
2. **Blocks.**  Two words within one edit agree on all letters before and behind the edit.
   A word enters, for its own length L and for L one less, one block for each half that the
   edit may lie in; the block's key is everything outside that half.  A block with more
   than ``BLOCK_WORDS`` words is split: the half left open is halved again, down to a
   single position, where few words can agree.  Each pair of near words has one block: the
   one whose open part holds the place where the words first differ.  So nothing is
   compared twice and no block grows with the vocabulary.
3. **Bit-sliced index.**  The words of a block take the bits of 64-bit lanes.  For each
   (lane, position, letter) one word of bits says which of them have that letter there.
   For all the letters of a query the recurrences run over whole lanes: ``zero`` holds the
   words that agree so far; ``same``, ``longer`` those with one error so far, read at the
   same position (a replaced letter) or one further (an inserted letter, the deleted one
   seen from the longer word).  Queries are the words of the block's length, so a pair of
   different lengths is found once and counted for both.
4. **Forms and roots.**  Near counts and the most frequent near word are aggregated by Spark.
   A form is at least twice as frequent as its word, so chains end; roots come by pointer
   doubling over joins.

A NULL or empty text has no words; a NULL id counts as empty text in the noise's key.
Repeated rows count as often as they occur.  Ties of n go to the word smallest in code-point
order.  An empty table has no words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, run_folder, shuffle_partitions, span_hashes, stage, text_blocks

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
NOISE = 97                     # one run in so many loses a letter
BLOCK_WORDS = 512              # words of a block that is not split
TEXT_BLOCK = 1 << 23           # text bytes counted at once
HELD_WORDS = 1 << 18           # distinct words a task holds before it hands them on
ROW_STEP = 1 << 16             # (query, lane) rows handled at once


# ------------------------------------------------------------------------- counting

def letter_runs(off: np.ndarray, data: np.ndarray):
    """Start, end and row of the maximal runs of A-Z, a-z and U+00C0-U+00FF (in UTF-8 the
    byte C3 and one more byte)."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    lead = data == 0xC3
    letter |= lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


_CRC = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
_CRC ^= _CRC[0]                # the plain table: without the initial and final inversion


def crc32_spans(start: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """crc32 of every span's bytes, going on from the crc ``start`` of what stands before it."""
    state = ~start
    order = np.argsort(s - e, kind="stable")             # longest first
    state, at, n = state[order], s[order], (e - s)[order]
    for j in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -j, side="left"))         # spans longer than j
        now = state[:live]
        state[:live] = _CRC[(now ^ data[at[:live] + j]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _lower(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + 32, data).astype(np.uint8)


def block_words(ids: list[str], col: pa.Array, noise: int | None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(hash, word, count) of the distinct words of some texts, letters deleted by the noise."""
    off, data = flat_text(col)
    s, e, row = letter_runs(off, data)
    data = _lower(data)
    changed: dict[bytes, int] = {}
    if noise and len(s):
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        h = crc32_spans(heads[row], data, s, e)
        hit = h % noise == 0
        for a, b, x in zip(s[hit].tolist(), e[hit].tolist(), h[hit].tolist()):
            run = data[a:b].tobytes().decode()
            at = x % len(run)
            w = (run[:at] + run[at + 1:]).encode()
            changed[w] = changed.get(w, 0) + 1
        s, e = s[~hit], e[~hit]
    h = span_hashes(data, s, e, lower=False)
    h, first, n = np.unique(h, return_index=True, return_counts=True)
    words = [data[a:b].tobytes() for a, b in zip(s[first].tolist(), e[first].tolist())]
    more = [w for w in changed if w]
    if more:
        joined = np.frombuffer(b"".join(more), np.uint8)
        ends = np.cumsum([len(w) for w in more])
        h = np.r_[h, span_hashes(joined, np.r_[0, ends[:-1]], ends, lower=False)]
        words += more
        n = np.r_[n, [changed[w] for w in more]]
    return h, words, n


def word_counts(docs: DataFrame, id_col: str, text_col: str, noise: int | None) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in text_blocks(batches, limit=TEXT_BLOCK):
            _, words, n = block_words(["" if i is None else i for i in b.column(0).to_pylist()], b.column(1), noise)
            for w, c in zip(words, n.tolist()):
                held[w] = held.get(w, 0) + c
            if len(held) > HELD_WORDS:
                yield _counted(held)
                held = {}
        yield _counted(held)

    src = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# --------------------------------------------------------------------------- blocks

def _keyed(rows: DataFrame) -> DataFrame:
    """``key`` of (word, len, lo, hi): what stands outside the open part lo..hi of a word of
    ``len`` letters; a longer word has one letter more in it."""
    return rows.withColumn("key", F.xxhash64("len", "lo", "hi", F.expr("substr(word, 1, lo)"),
                                             F.expr("right(word, len - hi)")))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return _keyed(rows.withColumn("half", F.explode(halves)).select("word", "n", "len", "half.lo", "half.hi"))


def blocks(vocabulary: DataFrame, folder: str) -> DataFrame:
    """(word, n, len, lo, hi, key) of the words of blocks that hold a possible pair."""
    m = F.char_length("word")
    rows = _halved(vocabulary.withColumn("len", F.explode(F.array(m, m - 1)))
                   .withColumn("lo", F.lit(0)).withColumn("hi", F.col("len")))
    done, step = None, 0
    while True:
        # a block needs a word of its own length and one more word
        size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                       F.max(F.char_length("word") == F.col("len")).alias("own"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        now = stage(rows.join(size.filter("size > 1 AND own"), "key"), folder, f"blocks-{step}")
        whole = (F.col("size") <= BLOCK_WORDS) | (F.col("open") <= 1)
        kept = now.filter(whole).drop("size", "own", "open")
        done = kept if done is None else done.unionByName(kept)
        large = now.filter(~whole)
        if large.isEmpty():
            return done
        rows, step = _halved(large), step + 1


# ------------------------------------------------------------------------ the index

def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, code points row by row, 0 behind the end)."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(n.max(initial=0)) + 2), np.uint32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return n, out


class BitSlices:
    """Bits of the words of each lane for (position, letter)."""

    def __init__(self, lane: np.ndarray, bit: np.ndarray, chars: np.ndarray):
        mask = np.uint64(1) << bit.astype(np.uint64)
        self.letters, code = np.unique(chars, return_inverse=True)
        code = code.reshape(chars.shape).astype(np.int64)
        self.positions = chars.shape[1]
        key = ((lane[:, None] * self.positions + np.arange(self.positions)) * len(self.letters) + code).ravel()
        order = np.argsort(key, kind="stable")
        key, mask = key[order], np.repeat(mask, self.positions)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.keys, self.bits = key[first], np.bitwise_or.reduceat(mask, first)

    def __call__(self, lane: np.ndarray, position: int, code: np.ndarray) -> np.ndarray:
        """Words of each lane with the letter at ``position`` (none past the index)."""
        if position >= self.positions:
            return np.zeros(len(lane), np.uint64)
        want = (lane * self.positions + position) * len(self.letters) + code
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.bits[at], np.uint64(0))


def near_in_lanes(index: BitSlices, lane: np.ndarray, codes: np.ndarray, length: np.ndarray,
                  of_length: np.ndarray, of_longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the words one replaced letter, and one inserted letter, away from each query.

    Row r runs query letters ``codes[r, :length[r]]`` over lane ``lane[r]``; ``of_length`` and
    ``of_longer`` mark the lane's words of the query's length and of one letter more."""
    zero = of_length | of_longer
    same, longer = np.zeros_like(zero), np.zeros_like(zero)
    for i in range(int(length.max(initial=0))):
        live = np.flatnonzero(i < length)
        where, c = lane[live], codes[live, i]
        here, ahead = index(where, i, c), index(where, i + 1, c)
        same[live] = (same[live] & here) | (zero[live] & ~here)
        longer[live] = (longer[live] | zero[live]) & ahead
        zero[live] &= here
    return same & of_length, (longer | zero) & of_longer


def near_pairs(words: list[str], key: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Row numbers (x, y) of the near pairs of some whole blocks, x < y in no order; each pair
    only in the block whose open part holds the place where the words first differ."""
    order = np.argsort(key, kind="stable")
    key, size, chars = key[order], *letters([words[i] for i in order])
    new = np.r_[True, key[1:] != key[:-1]][:len(key)]
    start = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    count = np.diff(np.r_[start, len(key)])
    lanes = -(-count // 64)
    first_lane = np.cumsum(lanes) - lanes
    place = np.arange(len(key)) - start[block]
    lane, bit = first_lane[block] + place // 64, place % 64
    index = BitSlices(lane, bit, chars)
    own = size == length[order]
    marks = []
    for of in (own, ~own):
        m = np.zeros(int(lanes.sum()), np.uint64)
        np.bitwise_or.at(m, lane[of], np.uint64(1) << bit[of].astype(np.uint64))
        marks.append(m)
    codes = np.searchsorted(index.letters, chars)
    queries = np.flatnonzero(own)
    found = []
    per = lanes[block[queries]]
    ends = np.cumsum(per)
    i = 0
    while i < len(queries):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ROW_STEP, side="right")))
        q = np.repeat(queries[i:j], per[i:j])
        at = np.arange(len(q)) - np.repeat(np.cumsum(per[i:j]) - per[i:j], per[i:j])
        ln = first_lane[block[q]] + at
        for bits in near_in_lanes(index, ln, codes[q], size[q], marks[0][ln], marks[1][ln]):
            some = np.flatnonzero(bits)
            hit = np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, b = np.nonzero(hit)
            r = some[r]
            found.append((q[r], start[block[q[r]]] + 64 * at[r] + b))
        i = j
    x, y = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    # where the words first differ decides the block; of two words of one length one finds the other twice
    differ = (chars[x] != chars[y]).argmax(1)
    low, high, n = lo[order][x], hi[order][x], size[x]
    mine = (differ >= low) & ((differ < high) | ((differ == n) & (high == n))) & (~own[y] | (x < y))
    return order[x[mine]], order[y[mine]]


def near_words(rows: DataFrame, tasks: int) -> DataFrame:
    """(word, near, near_n) for both words of every near pair, summed up for each task: the
    number of near words and the most frequent of them."""

    def run(t: pa.Table) -> pa.Table:
        words = t.column("word").to_pylist()
        n = t.column("n").to_numpy()
        x, y = near_pairs(words, *(t.column(c).to_numpy() for c in ("key", "len", "lo", "hi")))
        x, y = np.r_[x, y], np.r_[y, x]
        return pa.table({"word": pa.array([words[i] for i in x], pa.string()), "near": pa.array([words[i] for i in y], pa.string()),
                         "near_n": pa.array(n[y], pa.int64())})

    return (rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(tasks)).cast("int"))
            .select("part", "word", "n", "key", "len", "lo", "hi").groupBy("part")
            .applyInArrow(run, "word string, near string, near_n long"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root): the end of each word's chain of forms (word, form), by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), folder, "roots-0")
    step = 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        after = stage(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots-{step}")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None,
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``min_length`` code points and
    ``min_count`` occurrences.  With ``noise``, a run loses a letter where the contract's
    crc32 of id and run is divisible by it."""
    spark = docs.sparkSession
    folder, parts = run_folder(spark), shuffle_partitions(spark)
    counts = word_counts(docs, id_col, text_col, noise)
    vocabulary = stage(counts.filter((F.col("n") >= min_count) & (F.char_length("word") >= max(2, min_length))), folder, "vocabulary")
    near = near_words(blocks(vocabulary, folder), parts)
    # the most frequent near word; among equals the smallest, which a maximum reaches by the least negative order
    best = stage(near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
        .select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n")), folder, "near")
    judged = vocabulary.join(best, "word", "left").withColumn("fits", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
    judged = stage(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(F.col("fits"), F.col("near")).alias("form"),
                                 F.when(F.col("fits"), F.col("near_n")).alias("form_n")), folder, "forms")
    end = roots(judged.filter("form IS NOT NULL"), folder)
    return judged.join(end, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
