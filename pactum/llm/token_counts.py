"""Operator 3: token counts by a sentencepiece model, lengths only.

Every text is cut at safe boundaries, the distinct pieces of an Arrow batch are
encoded together in sub-batches of about equal bytes, and only lengths are kept.

Safe boundary: the model writes a blank as U+2581 and puts one in front of every
text.  If no vocabulary entry has U+2581 after another character, no merge can
reach across "character, blank", so the text may be cut there; the blank itself
comes back as the mark in front of the next piece.  The property is checked on
the vocabulary when the model is loaded, and so is that the model leaves blanks
as they are; without them texts are encoded whole.

A NULL or empty text has 0 tokens.  Repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_blocks

_BLANK = " \u2581"
_CUT = re.compile("(?<=[^ ▁]) (?=.)", re.S)
CACHE_PIECES = 300_000         # distinct pieces whose lengths one worker remembers
CACHE_PIECE_CHARS = 64         # longer pieces are not remembered
ENCODE_BYTES = 1 << 18         # characters per encode call

_MODELS: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Token lengths of texts under one model, with a bounded memory of pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        inner = re.compile("[^▁]▁", re.S)
        names = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.cuts = not any(inner.search(p) for p in names) and self._keeps_blanks()
        self.known: dict[str, int] = {}

    def _keeps_blanks(self) -> bool:
        size = lambda x: len(self.sp.encode(x))
        return size("a  a b ") == size("a") + size(" a") + size("b ") and size("  a") > size("a")

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        if "  " in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return _CUT.split(text)
        return text.split(" ")

    def _lengths(self, texts: list[str]) -> list[int]:
        """Encoded lengths; each call of the library gets about the same bytes."""
        out = [0] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        i = 0
        while i < len(order):
            j, size = i, 0
            while j < len(order) and (j == i or size + len(texts[order[j]]) <= ENCODE_BYTES):
                size += len(texts[order[j]]) + 4
                j += 1
            for k, ids in zip(order[i:j], self.sp.encode([texts[k] for k in order[i:j]], num_threads=1)):
                out[k] = len(ids)
            i = j
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: remembered pieces by memory, pieces that come twice in
        the batch once, and the other pieces of a text joined (cuts are safe both ways)."""
        cut = [self.pieces(t or "") for t in texts]
        found = [list(map(self.known.get, p)) for p in cut]
        total = [sum(n for n in f if n) for f in found]
        rest = [[x for x, n in zip(p, f) if n is None] if None in f else [] for p, f in zip(cut, found)]
        seen = Counter(x for r in rest for x in r)
        twice = [x for x, n in seen.items() if n > 1]
        learnt = dict(zip(twice, self._lengths(twice)))
        joined, owner = [], []
        for k, r in enumerate(rest):
            total[k] += sum(learnt[x] for x in r if x in learnt)
            run: list[str] = []
            size = 0
            for x in r:
                if x in learnt:
                    continue
                if x[0] in _BLANK or x[-1] in _BLANK:      # only inner cuts may be undone
                    joined.append(x)
                    owner.append(k)
                    continue
                run.append(x)
                size += len(x)
                if size > ENCODE_BYTES:
                    joined.append(" ".join(run))
                    owner.append(k)
                    run, size = [], 0
            if run:
                joined.append(" ".join(run))
                owner.append(k)
        for k, n in zip(owner, self._lengths(joined)):
            total[k] += n
        if len(self.known) > CACHE_PIECES:
            self.known = {}                                # bounded; pieces can be encoded again
        self.known.update((p, n) for p, n in learnt.items() if len(p) <= CACHE_PIECE_CHARS)
        return total


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text; a narrow one-pass job."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from .common import flat_text

        if model_path not in _MODELS:
            _MODELS[model_path] = PieceCounter(model_path)
        counter = _MODELS[model_path]
        for b in text_blocks(batches, "_t"):
            n = counter.counts(b.column(1).to_pylist())
            size = np.diff(flat_text(b.column(1))[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col], docs[text_col].alias("_t"))
    return src.mapInArrow(run, f"{id_col} {id_type}, n_bytes long, n_tokens long, over_limit boolean")
