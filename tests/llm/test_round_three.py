"""Operators 11 to 13 against brute force, on odd inputs and split groups."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import bond, registry, spelling, substring

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ hard negatives

def plain_negatives(rows, n_pos=5, n_neg=3, low=50, high=95, scale=256):
    """rows: (id, vector, label, anchor?) with distinct ids."""
    v = {i: (np.floor(np.array(x, float) * scale), y) for i, x, y, _ in rows}
    out = []
    for a, _, y, chosen in rows:
        if not chosen:
            continue
        score = {i: int(v[a][0] @ x) for i, (x, _) in v.items() if i != a and len(x) == len(v[a][0])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][1] == y][:n_pos]:
            fits = [i for i in order if v[i][1] != y and low * score[p] <= 100 * score[i] <= high * score[p]][:n_neg]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, id string, dim string, shard string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, y, "a", "b", "c") for i, x, y in rows], VECTORS)


@pytest.mark.parametrize("dim,spread,block", [(3, 2, 4096), (20, 1, 4096), (20, 1, 40)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, dim, spread, block):
    monkeypatch.setattr(bond, "SHARD_ROWS", block)
    rnd = np.random.default_rng(dim)
    rows = [(i, np.round(rnd.normal(0.3, 1, dim) * spread) / 4, int(rnd.integers(0, 3))) for i in range(300)]   # many ties
    rows += [(300 + i, rows[7][1], rows[7][2] if i % 2 else 9) for i in range(12)]                             # copies
    df = vectors(spark, [(i, x.tolist(), y) for i, x, y in rows])
    got = sorted(tuple(r) for r in bond.hard_negatives(df, F.col("vec_id") % 9 == 0).collect())
    assert got == plain_negatives([(i, x, y, i % 9 == 0) for i, x, y in rows])
    assert len(got) > 100


def test_hard_negatives_on_odd_rows(spark):
    assert bond.hard_negatives(vectors(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], None), (4, None, 2), (5, [0.5, None], 2),
            (6, [0.5, float("nan")], 2), (7, [0.5, float("inf")], 2), (8, [0.6, 0.6, 0.6], 2), (None, [0.6, 0.6], 2), (2, [0.5, 0.5], 2),
            (10, [], 1), (12, [-1.0, 0.0], 3), (14, [-1.0, 0.0], 3)]
    got = sorted(tuple(r) for r in bond.hard_negatives(vectors(spark, rows), F.col("vec_id") % 2 == 0).collect())
    assert got == [(0, 1, 1, 2, 131072, 65536)]


# ----------------------------------------------------------------- substring dedup

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_removal(rows, w):
    first = {}
    for i, t in rows:
        x = words_of(t)
        for k in range(len(x) - w + 1 if i is not None else 0):
            first[tuple(x[k:k + w])] = min(first.get(tuple(x[k:k + w]), i), i)
    out = []
    for i, t in rows:
        x = words_of(t)
        gone = {j for k in range(len(x) - w + 1 if i is not None else 0) if first[tuple(x[k:k + w])] < i for j in range(k, k + w)}
        out.append((i, len(x), len(gone), " ".join(v for j, v in enumerate(x) if j not in gone)))
    return sorted(out, key=str)


def removed(spark, rows, w):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, id string, h string, vals string")
    found = substring.remove_repeats(df.repartition(5), w).collect()
    for r in found:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))          # maximal
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str)


@pytest.mark.parametrize("w,chunk", [(13, 1 << 23), (13, 300), (4, 300), (5, 300), (1, 1 << 23), (2, 300)])
def test_repeats_against_all_windows(spark, monkeypatch, w, chunk):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    rnd = random.Random(w)
    pool = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 60))] for _ in range(12)]
    rows = [(None, " ".join(pool[0])), (5, None), (6, ""), (7, " \n\x0b")]
    for _ in range(120):
        x = []
        for _ in range(rnd.randint(0, 4)):
            q, a = rnd.choice(pool), rnd.randint(0, 60)
            x += q[a:a + rnd.randint(0, 50)] + [str(rnd.random()) for _ in range(rnd.randint(0, 2))]
        rows.append((rnd.randint(0, 100), "\t ".join(x)))               # ids repeat with different texts
    rows += rows[40:60]                                                # whole rows repeat
    assert removed(spark, rows, w) == plain_removal(rows, w)


def test_repeats_in_empty_and_very_long_texts(spark):
    assert removed(spark, [], 13) == []
    long = " ".join(str(i * i % 7919) + "é" for i in range(20_000))
    rows = [(1, long), (2, "a " * 30 + long[500:] + " b"), (3, "x " * 20_000), (4, "x " * 13), (5, "x " * 12)]
    assert removed(spark, rows, 13) == plain_removal(rows, 13)


# ---------------------------------------------------------------- spelling variants

def plain_variants(rows, noise=None):
    c = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if noise and h % noise == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            c[r] += 1
    v = {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, count = {}, {}
    for w, n in v.items():
        found = sorted((x for x in v if x != w and near(w, x)), key=lambda x: (-v[x], x))
        count[w] = len(found)
        form[w] = found[0] if found and v[found[0]] >= 2 * n else None
    out = {}
    for w, n in v.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, count[w], v[form[w]] if form[w] else None)
    return out


def variants(spark, rows, noise=None):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, word string, n string, key string")
    return {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df.repartition(4), noise=noise).collect()}


@pytest.mark.parametrize("noise,block", [(5, 512), (None, 4), (3, 64)])
def test_variants_against_all_pairs(spark, monkeypatch, noise, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)               # 4: blocks are split to single positions
    monkeypatch.setattr(spelling, "HELD_WORDS", 100)
    rnd = random.Random(block)
    rows = [(i, " ".join("".join(rnd.choice("abé×À") for _ in range(rnd.randint(3, 8))) for _ in range(300))) for i in range(40)]
    rows += [(None, "HELLO hello Hello hallo Hallo"), (None, None), (99, ""), (100, "12 Āx"), *rows[:3]]
    want = plain_variants(rows, noise)
    assert variants(spark, rows, noise) == want and sum(x[0] is not None for x in want.values()) > 20


def test_variants_of_equal_counts_and_long_words(spark):
    assert variants(spark, []) == {}
    w = "z" * 5000
    rows = [(i, f"aaaaa aaaab aaaac {w} {w}z {w}y") for i in range(3)] + [(9, "aaaaa " * 20_000), (10, f"{w}y " * 9)]
    got = variants(spark, rows)
    assert got == plain_variants(rows)
    assert got["aaaab"][:2] == ("aaaaa", "aaaaa") and got[w][0] == w + "y"


def test_registered_variants(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: tuple(r)[1:] for r in registry.op13_spelling_variants(spark, SMALL).collect()}
    assert len(got) > 1000
    want = plain_variants(rows, spelling.NOISE) if len(got) < 6000 else None
    assert want is None or got == want


# ------------------------------------------------------------- the join's blocks

LOWER = {c: c + 32 for c in range(65, 91)}


def near_sets(texts, width):
    out = []
    for t in texts:
        w = words_of((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def plain_links(texts, width, num, den):
    sets = near_sets(texts, width)
    root, links = list(range(len(sets))), [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return [(len(s), r, n) for s, r, n in zip(sets, root, links)]


@pytest.mark.parametrize("block,pairs", [(2, 0), (256, 1 << 17)])
def test_blocks_lose_no_link(spark, monkeypatch, block, pairs):
    """Sets that share rare shingles, linked or not, in blocks of two and in whole lists."""
    from pactum.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 1)
    rnd = random.Random(block)
    common = [f"c{i}" for i in range(12)]
    texts = [None, ""]
    for _ in range(8):
        own = [f"w{rnd.randint(0, 400)}" for _ in range(40)]
        for _ in range(6):                               # groups that differ by a little, all with one passage
            w = list(own)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9)}"
            texts.append(" ".join(common + w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_join.near_duplicates(df, 2, 80, 100).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows}
    assert [got[i] for i in range(len(texts))] == plain_links(texts, 2, 80, 100)


def test_registered_link_counts(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [" ".join(words_of((t or "").translate(lower))) for _, t in docs]
    want = plain_links([w.replace(" ", "_") for w in words], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in registry.op1_link_counts(spark, SMALL).collect()}
    assert got == {i: (n, docs[c][0], k) for (i, _), (n, c, k) in zip(docs, want)}
