"""Operator 9: byte-level BPE encoding and decoding through a word lexicon.

* **Corpus pass.** Pre-tokens ("words", by the tokenizer's own split pattern) are
  counted over all texts in Spark; the ``max_words`` most frequent ones (a bound
  on the lexicon, not on what is encoded) get their ids.
* **Lexicon.** Those words are compiled into a minimal acyclic transducer: states
  with equal futures are shared, each edge carries the number of words that sort
  before it, and the sum along a word's path is its number, which points into an
  id table.  Edges lie in flat sorted arrays in one file in the shared folder;
  Spark ships the file to each executor and workers map it into memory.
* **Encoding.** The distinct words of a batch walk the transducer together, one
  byte per step (binary search over edges).  Words outside are merged exactly by
  rank (:func:`merge_word`) and remembered up to a bound.
* **Decoding** joins the bytes of each id and replaces malformed UTF-8.

Added special tokens inside a text become their own id, as the tokenizers
library does by default.  A NULL text is the empty text: no ids, empty result.
Very long words are merged with a heap, so they cost n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, run_folder, stage, text_blocks

MAX_WORDS = 131_072            # words compiled into the lexicon
CACHE_WORDS = 400_000          # distinct words one worker remembers
CACHE_WORD_BYTES = 64
BLOCK = 4 << 20                # text bytes that are coded together
_WIDE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S)(?= \S)")

# ------------------------------------------------------------------ fixed values
# The split pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Byte ranges that the vocabulary writes as the character of the same number;
# the other bytes are written as 256, 257, ... in byte order.
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))


def byte_letters() -> dict[str, int]:
    """Vocabulary character -> byte."""
    plain = [b for lo, hi in PLAIN_BYTES for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] \
                or not pre["use_regex"] or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.ids.items()} | \
            {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self._arrays = None
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None

    def merge_arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges sorted by pair: pair as one number, rank, merged id."""
        if self._arrays is None:
            m = sorted((a << 20 | b, r, n) for (a, b), (r, n) in self.merges.items())
            self._arrays = tuple(np.array(x, np.int64) for x in zip(*m))
        return self._arrays

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token is an element of its own."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return [text]
        if self.cut is None or not self.cut.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out


def merge_word(vocab: Vocabulary, word: bytes) -> list[int]:
    """Exact BPE of one pre-token: always the lowest rank, leftmost first."""
    ids = [vocab.byte_ids[b] for b in word]
    merges = vocab.merges
    if len(ids) <= 24:
        while len(ids) > 1:
            found = [(merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
            if not found:
                break
            k = min(found)[1]
            ids[k:k + 2] = [merges[ids[k], ids[k + 1]][1]]
        return ids
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(merges[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        r = right[k]
        if ids[k] != a or r >= n or ids[r] != b:
            continue                     # one side has been merged meanwhile
        ids[k], ids[r] = merges[a, b][1], -1
        right[k] = right[r]
        if right[r] < n:
            left[right[r]] = k
        for i in (left[k], k):
            j = right[i] if i >= 0 else n
            if i >= 0 and j < n and (ids[i], ids[j]) in merges:
                heapq.heappush(heap, (merges[ids[i], ids[j]][0], i, ids[i], ids[j]))
    return [x for x in ids if x >= 0]


def merge_words(vocab: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """:func:`merge_word` for many words at once: each step merges the lowest-ranked,
    leftmost pair of every word that still has one."""
    out: list[list[int]] = [[] for _ in words]
    short = [k for k, w in enumerate(words) if 0 < len(w) <= 48]
    for k, w in enumerate(words):
        if len(w) > 48:
            out[k] = merge_word(vocab, w)
    if not short:
        return out
    lens = np.array([len(words[k]) for k in short])
    sym = np.array(vocab.byte_ids, np.int64)[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
    word = np.repeat(np.array(short), lens)
    score, to = _pair_ranks(vocab, sym, word, np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        at = np.arange(len(sym))
        best = np.minimum.reduceat(score << 32 | at, first)
        more = best >> 32 < _NO_PAIR
        if not more.all():                        # words without a pair are done
            done = np.repeat(~more, size)
            ids, end = sym[done].tolist(), np.cumsum(size[~more])
            for w, a, b in zip(word[first[~more]].tolist(), (end - size[~more]).tolist(), end.tolist()):
                out[w] = ids[a:b]
            if not more.any():
                break
        pos = best[more] & 0xFFFFFFFF
        sym[pos] = to[pos]
        keep = np.repeat(more, size)
        keep[pos + 1] = False
        new_at = np.cumsum(keep) - 1
        sym, word, score, to = sym[keep], word[keep], score[keep], to[keep]
        near = np.concatenate([new_at[pos], np.maximum(new_at[pos] - 1, 0)])
        score[near], to[near] = _pair_ranks(vocab, sym, word, near)
    return out


_NO_PAIR = 1 << 20


def _pair_ranks(vocab: Vocabulary, sym: np.ndarray, word: np.ndarray, at: np.ndarray):
    """Rank and merged id of the pairs that begin at positions ``at``."""
    pairs, rank, new = vocab.merge_arrays()
    nxt = np.minimum(at + 1, len(sym) - 1)
    key = np.where((word[at] == word[nxt]) & (nxt > at), sym[at] << 20 | sym[nxt], -1)
    k = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    hit = pairs[k] == key
    return np.where(hit, rank[k], _NO_PAIR), new[k]


# --------------------------------------------------------------------- transducer

def build_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer over ``words`` as flat arrays.

    ``edge`` holds ``state * 256 + byte`` in ascending order, ``to`` the target
    state, ``add`` the words that sort before this edge at its state; ``final``
    marks states at which a word ends; ``first``/``ids`` are the id table by word
    number (the order of the sorted words)."""
    ordered = sorted(words)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]], int]] = []   # final, edges, words below

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append((node[0], node[1], node[0] + sum(states[t][2] for _, t in node[1])))
        return known[key]

    path: list[list] = [[False, []]]     # nodes of the last word, still open
    last = b""
    for w in ordered:
        keep = os.path.commonprefix([last, w])
        while len(path) > len(keep) + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        path += [[False, []] for _ in w[len(keep):]]
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    edge, to, add = [], [], []
    for s, (final, edges, _) in enumerate(states):
        before = int(final)
        for b, t in edges:
            edge.append(s * 256 + b)
            to.append(t)
            add.append(before)
            before += states[t][2]
    lens = [len(words[w]) for w in ordered]
    return {"edge": np.array(edge, np.int64), "to": np.array(to, np.int32),
            "add": np.array(add, np.int32),
            "final": np.array([s[0] for s in states], np.uint8), "root": np.array([root], np.int64),
            "first": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64),
            "ids": np.array([i for w in ordered for i in words[w]], np.int32)}


_PARTS = (("edge", np.int64), ("to", np.int32), ("add", np.int32), ("final", np.uint8),
          ("root", np.int64), ("first", np.int64), ("ids", np.int32))


def lexicon_bytes(lex: dict[str, np.ndarray]) -> bytes:
    head = np.array([len(lex[k]) for k, _ in _PARTS], np.int64).tobytes()
    body = [lex[k].astype(t).tobytes() for k, t in _PARTS]
    return head + b"".join(x + bytes(-len(x) % 8) for x in body)


def open_lexicon(path: str) -> dict[str, np.ndarray]:
    """The arrays of a lexicon file, mapped into memory."""
    raw = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    sizes = raw[:8 * len(_PARTS)].view(np.int64)
    at, out = 8 * len(_PARTS), {}
    for (k, t), n in zip(_PARTS, sizes):
        size = int(n) * np.dtype(t).itemsize
        out[k] = raw[at:at + size].view(t)
        at += size + -size % 8
    return out


def look_up(lex: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Word number of each word in the lexicon, -1 where it isn't one."""
    n = len(words)
    if n == 0 or len(lex["edge"]) == 0:
        return np.full(n, -1, np.int64)
    lens = np.array([len(w) for w in words], np.int64)
    start = np.concatenate([[0], np.cumsum(lens)])[:-1]
    data = np.frombuffer(b"".join(words), np.uint8)
    state = np.full(n, lex["root"][0], np.int64)
    total = np.zeros(n, np.int64)
    live = np.flatnonzero(lens > 0)
    out = np.full(n, -1, np.int64)
    step = 0
    while len(live):
        key = state[live] * 256 + data[start[live] + step]
        at = np.minimum(np.searchsorted(lex["edge"], key), len(lex["edge"]) - 1)
        hit = lex["edge"][at] == key
        live, at = live[hit], at[hit]
        state[live] = lex["to"][at]
        total[live] += lex["add"][at]
        step += 1
        done = lens[live] == step
        end = live[done]
        end = end[lex["final"][state[end]] == 1]
        out[end] = total[end]
        live = live[~done]
    return out


# ---------------------------------------------------------------------- Spark jobs

_VOCABS: dict[str, Vocabulary] = {}
_CODERS: dict[tuple[str, str], "Coder"] = {}


def _vocab(path: str) -> Vocabulary:
    if path not in _VOCABS:
        _VOCABS[path] = Vocabulary(path)
    return _VOCABS[path]


class Coder:
    """Encoder of one worker: vocabulary, mapped lexicon, remembered chunks.

    A text is cut before each blank that has no white space beside it; the split
    pattern always starts a new word there, so chunks can be split one by one.
    ``known`` maps a chunk, and ``after`` a chunk without the blank before it, to
    (ids as text, bytes that the ids decode to)."""

    def __init__(self, tokenizer_path: str, lexicon_path: str):
        self.vocab = _vocab(tokenizer_path)
        self.lex = open_lexicon(lexicon_path)
        self.known: dict[str, tuple] = {}
        self.after: dict[str, tuple] = {}
        self.id_text = {i: str(i) for i in self.vocab.bytes_of}
        self.listed: dict[int, tuple] = {}            # records of lexicon words, by number

    def _records(self, chunks: list[str]) -> list[tuple]:
        vocab, first, ids = self.vocab, self.lex["first"], self.lex["ids"]
        split = [vocab.words(c) for c in chunks]
        words = list({w for s in split for w in s})
        raw = [w.encode() for w in words]
        number = look_up(self.lex, raw).tolist()
        unseen = [k for k, n in enumerate(number) if n < 0]
        made: dict[str, tuple] = {}
        for k, seq in zip(unseen, merge_words(vocab, [raw[k] for k in unseen])):
            made[words[k]] = self._record(seq)
        for w, n in zip(words, number):
            if n >= 0:
                if n not in self.listed:
                    self.listed[n] = self._record(ids[first[n]:first[n + 1]].tolist())
                made[w] = self.listed[n]
        made.update((w, self._record([i])) for w, i in vocab.special.items())
        return [made[s[0]] if len(s) == 1 else
                (",".join([made[w][0] for w in s]), b"".join([made[w][1] for w in s])) for s in split]

    def _record(self, seq: list[int]) -> tuple[str, bytes]:
        return (",".join(map(self.id_text.__getitem__, seq)),
                b"".join(map(self.vocab.bytes_of.__getitem__, seq)))

    def records(self, texts: list[str]) -> list[list[tuple]]:
        """The chunk records of each text, in order."""
        cut = [chunks(t) for t in texts]
        heads = self._look([h for h, _ in cut], self.known, "")
        tails = self._look([r for _, r in cut], self.after, " ")
        return [h + r for h, r in zip(heads, tails)]

    def _look(self, lists: list[list[str]], known: dict[str, tuple], lead: str) -> list[list[tuple]]:
        found = [list(map(known.get, c)) for c in lists]
        open_ = [k for k, f in enumerate(found) if None in f]
        new: set[str] = set()
        for k in open_:
            new.update([c for c, x in zip(lists[k], found[k]) if x is None])
        if new:
            order = list(new)
            fresh = dict(zip(order, self._records([lead + c for c in order] if lead else order)))
            for k in open_:
                found[k] = [x or fresh[c] for c, x in zip(lists[k], found[k])]
            if len(known) > CACHE_WORDS:
                known.clear()                         # bounded; chunks can be coded again
            known.update((c, r) for c, r in fresh.items() if len(c) <= CACHE_WORD_BYTES)
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids_of(rec) for rec in self.records(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def ids_of(found: list[tuple]) -> list[int]:
    return [int(i) for x in found for i in x[0].split(",")]


def chunks(text: str) -> tuple[list[str], list[str]]:
    """(chunks as they stand, further chunks without the blank before them)."""
    if not text:
        return [], []
    if text[0] == " " or text[-1] == " " or _WIDE.search(text):
        return _CUT.split(text), []
    parts = text.split(" ")
    return parts[:1], parts[1:]


def frequent_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                   max_words: int = MAX_WORDS) -> list[bytes]:
    """The most frequent pre-tokens of all texts, ``max_words`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen, lead = _vocab(tokenizer_path), Counter(), Counter()

        def rows():
            total: Counter = Counter()
            for mark, part in (("", lead), (" ", seen)):
                for c, n in part.items():
                    for w in vocab.words(mark + c):
                        total[w] += n
            seen.clear()
            lead.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["w", "n"])

        for b in text_blocks(batches, "_t", BLOCK):
            for t in b.column(0).to_pylist():
                h, r = chunks(t or "")
                lead.update(h)
                seen.update(r)
            if len(seen) + len(lead) > CACHE_WORDS:   # bounded memory: hand on and start afresh
                yield rows()
        yield rows()

    counted = (docs.select(docs[text_col].alias("_t")).mapInArrow(count, "w string, n long")
               .filter(F.length("w") <= CACHE_WORD_BYTES).groupBy("w").agg(F.sum("n").alias("n")))
    top, _ = most_frequent(stage(counted.filter("n > 1"), run_folder(docs.sparkSession), "words"), "n", max_words)
    special = _vocab(tokenizer_path).special
    words = top.select("w").toPandas()["w"]              # max_words rows at most
    return [w.encode() for w in words if w not in special]


def publish_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                    max_words: int = MAX_WORDS) -> str:
    """Build the lexicon of ``docs``, write it to the shared folder, let Spark ship
    it to every executor; returns the file's name for ``SparkFiles.get``."""
    spark = docs.sparkSession
    vocab = _vocab(tokenizer_path)
    words = frequent_words(docs, tokenizer_path, text_col, max_words)
    blob = lexicon_bytes(build_lexicon(dict(zip(words, merge_words(vocab, words)))))
    folder = run_folder(spark)
    name = f"lexicon-{folder[-32:]}.bin"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(conf).create(path, True)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    return name


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                  text_col: str = "text", max_words: int = MAX_WORDS,
                  digest: bool = False) -> DataFrame:
    """Per row: id, ``ids`` (array<int>) and ``decoded`` text; with ``digest`` the
    number of ids and the SHA-256 of both instead."""
    name = publish_lexicon(docs, tokenizer_path, text_col, max_words)
    id_type = docs.schema[id_col].dataType.simpleString()
    cols = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest \
        else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, SparkFiles.get(name))
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = Coder(*key)
        coder = _CODERS[key]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in text_blocks(batches, "_t", BLOCK):
            found = coder.records([t or "" for t in b.column(1).to_pylist()])
            back = [b"".join([x[1] for x in f]).decode("utf-8", "replace") for f in found]
            if digest:
                seqs = [",".join([x[0] for x in f]) for f in found]
                rest = [pa.array([s.count(",") + 1 if s else 0 for s in seqs], pa.int64()),
                        pa.array([sha(s) for s in seqs], pa.string()),
                        pa.array([sha(t) for t in back], pa.string())]
            else:
                rest = [pa.array([ids_of(f) for f in found], pa.list_(pa.int32())),
                        pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *rest], names=[id_col, *(c.split()[0] for c in cols.split(", "))])

    return docs.select(docs[id_col], docs[text_col].alias("_t")).mapInArrow(run, f"{id_col} {id_type}, {cols}")
