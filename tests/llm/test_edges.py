"""Operators on nulls, empty tables, ties, repeated rows, clashing and extra columns."""
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pactum.llm import class_lm, cross_polytope, lexicon_bpe, maxscore, ngram_join, ordinal, packing, pii, url_cascade
from pactum.llm.token_counts import PieceCounter, token_counts

DOCS = "doc_id long, text string, n_tokens string, score string, id string, h1 string"
BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "a ", " a", "a  b", "\n\t", "ab" * 3000 + " " * 60, "<|endoftext|>x <s>", "é🙂 　▁a", "it's 12 ok"]


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], DOCS)


OPERATORS = {
    "near": lambda d: ngram_join.near_duplicates(d),
    "lm": lambda d: class_lm.score_documents(d),
    "tokens": lambda d: token_counts(d, PIECE),
    "quality": lambda d: ordinal.classify(d, d.sparkSession.createDataFrame(
        [(1, 2), (1, None), (None, 1), (2, 0)], "id long, grade int"), 3),
    "pii": lambda d: pii.report(d),
    "bpe": lambda d: lexicon_bpe.encode_decode(d, BPE),
    "packing": lambda d: packing.pack(packing.word_counts(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_null_and_odd_texts(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0
    texts = [None, *ODD, *ODD]
    rows = OPERATORS[name](docs(spark, texts)).select("doc_id").collect()
    assert {r.doc_id for r in rows} == set(range(1, len(texts) + 1))


def jaccard_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_near_duplicates_against_all_pairs(spark, width, num, den):
    rnd = random.Random(width)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 30)) for _ in range(n)] for n in (8, 25, 60, 60, 200)]
    texts = [None, "", "   ", "one two", "one two", "ONE  two"]
    for words in base:
        for _ in range(14):                           # chains of edits: some link, some just don't
            w = list(words)
            for _ in range(rnd.randint(0, max(1, len(w) // 20))):
                w[rnd.randrange(len(w))] = str(rnd.random())
            texts.append(" ".join(w))
            if rnd.random() < 0.3:
                words = w
    texts += [" ".join(base[4][:100] + base[3]), " ".join(base[3] + base[4][:100])]
    sizes, root = jaccard_components(texts, width, num, den)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs(spark, texts, 0), width, num, den).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root


@pytest.mark.parametrize("chunk", [3, 256])
def test_every_link_is_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)          # 3: groups of several chunks
    rnd = random.Random(chunk)
    texts = [None, "", "one two", "ONE  two"]
    for size in (30, 90):
        words = [f"w{size}x{i}" for i in range(size)]
        for _ in range(24):                                  # near copies; some pairs link, some don't
            w = list(words)
            for _ in range(rnd.randint(0, size // 25)):
                w[rnd.randrange(size)] = f"e{rnd.random()}"
            texts += [" ".join(w)] * rnd.randint(1, 2)
    sets = [{tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    links = [sum(1 for k, y in enumerate(sets) if k != i and x and 100 * len(x & y) >= 85 * len(x | y)) for i, x in enumerate(sets)]
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs(spark, texts, 0)).collect()}
    assert [got[i].n_links for i in range(len(texts))] == links
    assert max(links) > 10 and all((got[i].class_id == got[k].class_id) == (x == y) for i, x in enumerate(sets)
                                   for k, y in enumerate(sets) if x and y)


def test_overlaps_of_sparse_and_dense_members(monkeypatch):
    rnd = np.random.default_rng(1)
    for limit in (0, 4, 4096):
        monkeypatch.setattr(ngram_join, "SPARSE_PAIRS", limit)
        monkeypatch.setattr(ngram_join, "STRIP_CELLS", 100)
        sides = [[np.unique(rnd.integers(0, 60, n)).astype(np.uint64) for n in rnd.integers(0, 150, rows)] for rows in (7, 5)]
        args = [x for s in sides for x in (np.array([len(v) for v in s]), np.concatenate(s))]
        assert ngram_join.overlaps(*args).tolist() == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]


def test_one_per_group_keeps_the_least_id_once(spark):
    t = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(5, t, "a"), (3, t, "b"), (3, t, "b"), (9, "other words here", "c"), (None, t, "d"), (7, None, "e")],
                                  "doc_id long, text string, lang string")
    out = ngram_join.one_per_group(frame, 5, 80, 100)
    assert out.columns == frame.columns
    assert sorted((r.doc_id or 0, r.lang) for r in out.collect()) == [(0, "d"), (3, "b"), (7, "e"), (9, "c")]


def test_piece_counts_and_bpe_on_random_texts():
    import sentencepiece
    from tokenizers import Tokenizer
    rnd = random.Random(4)
    alpha = "ab  \n\t'stréß12 　▁.,!é🙂\x1c\x85\u200b\x00ⅷ"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ODD
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert PieceCounter(PIECE).counts(texts) == [len(x) for x in sp.encode(texts)]
    vocab = lexicon_bpe.Vocabulary(BPE)
    tok = Tokenizer.from_file(BPE)
    for t in texts:
        ids = [i for w in vocab.words(t) for i in ([vocab.special[w]] if w in vocab.special else lexicon_bpe.merge_word(vocab, w.encode()))]
        assert ids == tok.encode(t, add_special_tokens=False).ids, t
    words = sorted({w for t in texts for w in vocab.words(t) if w not in vocab.special})
    raw = [w.encode() for w in words]
    assert lexicon_bpe.merge_words(vocab, raw) == [lexicon_bpe.merge_word(vocab, w) for w in raw]


def test_lexicon_is_minimal_and_numbers_its_words(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é"])}
    lex = lexicon_bpe.build_lexicon(words)
    path = tmp_path / "lex.bin"
    path.write_bytes(lexicon_bpe.lexicon_bytes(lex))
    back = lexicon_bpe.open_lexicon(str(path))
    asked = [*words, b"ta", b"stopss", b"", b"x"]
    got = lexicon_bpe.look_up(back, asked)
    assert [asked.index(w) for w in sorted(words)] == [list(got).index(k) for k in range(len(words))]
    assert list(got[len(words):]) == [-1] * 4
    for w, k in zip(words, got):
        assert list(back["ids"][back["first"][k]:back["first"][k + 1]]) == words[w]
    # root, t, s, st, the byte of é, "p(s)" (after ta, to and sto), "(s)", the end
    assert len(lex["final"]) == 8


VECS = "vec_id long, embedding array<float>, score string, label int"


def vector_frame(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [0.0, 0.0]), (60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]),
            (7, [2.0, -1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [float("inf"), 0.0]), (200, [-1.0, 0.5])]
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], VECS)


def test_nearest_with_very_differing_lengths(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 32))
    mat = centres[rnd.integers(0, 40, 2600)] + 0.3 * rnd.normal(size=(2600, 32))
    mat /= np.sqrt((mat * mat).sum(1))[:, None]
    mat[1] *= 10                                      # one very long vector
    mat[2100:] *= 3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "vec_id long, embedding array<double>")
    rows = cross_polytope.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, len(mat), 20):
        score = mat @ mat[q]
        score[q] = -np.inf
        mine = {r.vec_id: r.score for r in rows if r.query_id == q}
        best = np.argsort(-score)[:20]
        assert len(mine) == 20 and (1 not in best or 1 in mine)
        assert all(abs(score[i] - x) < 1e-9 for i, x in mine.items())
        hits += len(set(mine) & set(best.tolist()))
    print("recall", hits / (20 * len(range(0, len(mat), 20))))
    assert hits >= 0.95 * 20 * len(range(0, len(mat), 20))


def test_vector_searches_on_odd_rows(spark):
    empty = spark.createDataFrame([], VECS)
    assert maxscore.exact_top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert cross_polytope.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0
    top = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in
           maxscore.exact_top_k(vector_frame(spark), F.col("vec_id") % 100 == 0, k=3).collect()}
    # query 0: 8 and 20 tie; a repeated row counts once; the own row is out
    assert [top[0, k] for k in (1, 2, 3)] == [(8, 5 * 1024 ** 2), (20, 5 * 1024 ** 2), (7, 0)]
    assert (100, 1) not in top and (200, 1) in top
    near = cross_polytope.nearest(vector_frame(spark), F.col("vec_id") % 20 == 0, k=2, probes=4).collect()
    assert {r.query_id for r in near} == {0, 20, 200}
    assert [(r.vec_id, r.score) for r in near if r.query_id == 0] == [(8, 5.0), (20, 5.0)]


def test_maxscore_prunes_without_loss():
    rnd = np.random.default_rng(2)
    mat = rnd.integers(-300, 300, (3000, 24)).astype(float)
    mat[:, :4] *= 20                                   # a few strong terms: the others become non-essential
    ids = np.arange(3000) * 3
    q = np.array([5, 700, 2999])
    qi, v, s = maxscore.maxscore(ids, mat, ids[q], mat[q], 10)
    for k in q:
        score = mat @ mat[k]
        order = [j for j in np.lexsort((ids, -score)) if j != k][:10]
        assert v[qi == ids[k]].tolist() == ids[order].tolist() and s[qi == ids[k]].tolist() == score[order].tolist()


def test_url_cascade_is_exact_in_parts(spark):
    rows = [(i, u) for i, u in enumerate([None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y", "https://www.example.com/en/",
                                          "http://x.net/es/", "http://x.net/fr", "ftp://bad.org/q", "ftp://deep.bad.org", "http://notbad.org/",
                                          "http://com/", "x://com", "http://h#/es/"])]
    pages = spark.createDataFrame([(i, u, "z", "w") for i, u in rows], "page_id long, url string, rule string, host string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    hosts = spark.createDataFrame([("bad.org",), ("bad.org",), (None,), ("absent.org",)], "host string")
    want = {4: ("a.example.com", "/en/x", "example.com/en/", "block"), 5: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            6: ("x.net", "/es/", "net/es/", "block"), 7: ("x.net", "/fr", None, "allow"), 8: ("bad.org", "/q", None, "block"),
            9: ("deep.bad.org", "", None, "block"), 10: ("notbad.org", "/", None, "allow"), 11: ("com", "/", "com/", "allow"),
            12: ("com", "", None, "allow"), 13: ("h", "", None, "allow"), 0: ("", "", None, "allow"), 2: ("", "", None, "allow")}
    for bits in (url_cascade.MAX_BITS, 40):            # one cascade, then several
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages, rules, hosts, max_bits=bits).collect()}
        assert len(got) == len(rows) and {k: got[k] for k in want} == want
    assert url_cascade.judge_urls(pages.limit(0), rules, hosts).count() == 0


def test_pii_positions_and_disclosing_terms(spark):
    text = "é🙂 mail bob@x.org, 1.2.3.4 and 300.1.1.1; 4111 1111-1111 1111 +1 (386) 555-3733."
    spans = {r.doc_id: r.spans for r in pii.report(docs(spark, [text])).collect()}[1].split(",")
    assert [text[int(a):int(b)] for _, a, b in (s.split(":") for s in spans)] == \
        ["bob@x.org", "1.2.3.4", "4111 1111-1111 1111", "+1 (386) 555-3733"]
    # "zorro" stands only near bob, in differing contexts; "the" stands everywhere
    near = [f"the day {k} zorro wrote bob@x.org the {w} end" for k, w in enumerate(["red", "blue", "green"])]
    rest = ["the cat and the dog by the tree"] * 60
    frame = docs(spark, near + rest)
    found = {r.doc_id: r.spans for r in pii.report(frame).collect()}
    for i, t in enumerate(near, 1):
        terms = [t[int(a):int(b)] for k, a, b in (s.split(":") for s in found[i].split(",")) if k == "term"]
        assert "zorro" in terms and "the" not in terms
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert all("zorro" not in clean[i] and "bob@x.org" not in clean[i] and "[EMAIL]" in clean[i] for i in (1, 2, 3))
    assert all(clean[i] == rest[0] for i in range(4, 64))


def test_linear_patterns_on_hostile_texts(spark):
    texts = ["x" * 60000 + "@", "1.2" * 8000, "a@b" + ".c" * 20000, "1 " * 30000, "+" * 5000, "a@b.c%x@d.e", "1-2" * 9000]
    assert pii.report(docs(spark, texts)).count() == len(texts)


def test_bucket_bounds_are_optimal():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randint(1, 9)
        lens = np.array(sorted(rnd.sample(range(1, 40), n)))
        counts = np.array([rnd.randint(1, 9) for _ in lens])
        k = rnd.randint(1, 4)

        def cost(bounds):
            return sum(c * min(b for b in bounds if b >= x) for x, c in zip(lens, counts))
        best = min(cost([*c, lens[-1]]) for j in range(k) for c in itertools.combinations(lens[:-1], min(j, n - 1)))
        got = packing.bucket_bounds(lens, counts, k)
        assert len(got) <= k and got == sorted(got) and cost(got) == best
    assert packing.bucket_bounds(np.zeros(0), np.zeros(0), 3) == []


def test_exchange_finds_the_two_languages():
    """Units 0-3 follow each other, and so do units 4-7; the end (8) follows both."""
    big = np.zeros((9, 9))
    big[:4, :4] = big[4:8, 4:8] = 50
    big[8, :8] = big[:8, 8] = 5
    cls = class_lm.exchange(big, 2, 10)
    assert len(set(cls[:4])) == len(set(cls[4:8])) == 1 and cls[0] != cls[4] and cls[8] == 2


def test_ordinal_gradient():
    rnd = np.random.default_rng(3)
    idx, off = rnd.integers(0, 6, 40), np.array([0, 0, 5, 9, 20, 31, 40])
    grade, w, t = np.array([0, 1, 2, 2, 0, 1]), rnd.normal(size=6) * 0.1, np.array([-0.3, 0.8])
    v, g_w, g_t = ordinal.loss_and_gradient(idx, off, grade, w, t)
    for k in range(6):
        d = np.zeros(6)
        d[k] = 1e-6
        assert (ordinal.loss_and_gradient(idx, off, grade, w + d, t)[0] - v) / 1e-6 == pytest.approx(g_w[k], abs=1e-3)
    for k in range(2):
        d = np.zeros(2)
        d[k] = 1e-6
        assert (ordinal.loss_and_gradient(idx, off, grade, w, t + d)[0] - v) / 1e-6 == pytest.approx(g_t[k], abs=1e-3)
