"""Registered queries over whole small tables: against their SQL or brute force."""
import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from pactum.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    res = compare(spark, name, E.queries()[name], registry.ORACLE[name], SMALL, duck(SMALL))
    assert res["ok"], res


def test_every_operator_is_registered_once():
    names = [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES]
    assert sorted(names) == list(range(1, 14)) and "pipeline" in E.queries()


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_class_lm_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in registry.op2_class_lm(spark, SMALL).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in documents}
    tokens = {i: [*_words(t), None] for i, t in documents}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(ws), n)
        assert r.n_known == sum(w in counts for w in ws)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)      # it learns something


def test_token_counts_against_the_library(spark, documents):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in registry.op3_token_counts(spark, SMALL).collect()}
    for i, t in documents:
        n = len(sp.encode(t))
        assert got[i] == (len(t.encode()), n, n > 4096)


def test_bpe_against_the_library(spark, documents):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in registry.op9_bpe_round_trip(spark, SMALL).collect()}
    for i, t in documents:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_nearest_recall_and_scores(spark, vectors):
    ids, mat = vectors
    rows = registry.op8_nearest(spark, SMALL).collect()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        at = int(np.flatnonzero(ids == q)[0])
        score = mat @ mat[at]
        order = [k for k in np.lexsort((ids, -score)) if k != at][:20]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            assert r.score == pytest.approx(score[np.flatnonzero(ids == r.vec_id)[0]], abs=1e-12)
        hits += len({r.vec_id for r in mine} & set(ids[order]))
        total += len(order)
    assert hits >= 0.9 * total


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or \
                    kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_against_plain_patterns(spark, documents):
    got = {r.doc_id: r for r in registry.op5_pii(spark, SMALL).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        spans = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].spans.split(",")[:len(spans)] == (spans or [""])[:len(spans)]
        assert got[i].n_email == sum(s.startswith("email") for s in spans)


def test_quality_on_held_out_labels(spark):
    from pactum.llm.common import table
    from pactum.llm.ordinal import GRADES, classify, corpus_ratings
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    found = classify(table(spark, d, "documents"), corpus_ratings(labels.filter("doc_id % 2 = 0")), GRADES)
    rows = found.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r for r in rows if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.9 and np.mean([r.keep for r in junk]) < 0.15
    assert np.mean([r.expected_grade for r in good]) > np.mean([r.expected_grade for r in junk]) + 0.5


def test_packing_of_all_documents(spark, documents):
    from pactum.llm.packing import MAX_LEN, TOKEN_BUDGET
    rows = registry.op10_packing(spark, SMALL).collect()
    length = {i: len(_words(t)) + (t != "") for i, t in documents}
    pieces, batches, places = Counter(), Counter(), set()
    for r in rows:
        assert r.n_tokens == length[r.doc_id]
        if r.piece is None:
            assert r.n_tokens == 0
            continue
        pieces[r.doc_id] += r.piece_len
        assert r.piece_len <= r.bucket_len <= MAX_LEN and r.padding == r.bucket_len - r.piece_len
        batches[r.bucket_len, r.batch] += 1
        assert (r.bucket_len, r.batch, r.place) not in places
        places.add((r.bucket_len, r.batch, r.place))
    assert dict(pieces) == {i: n for i, n in length.items() if n}
    for (bound, batch), n in batches.items():
        last = batch == max(b for w, b in batches if w == bound)
        assert n == TOKEN_BUDGET // bound or last and n <= TOKEN_BUDGET // bound
