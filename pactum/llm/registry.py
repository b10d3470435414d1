"""Registered queries of the operators, with production parameters, and their SQL.

An entry without SQL cannot be said in SQL (learned models, tokenizer libraries,
approximate search); ``tests/llm`` holds it against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bond import hard_negatives
from .class_lm import score_documents
from .common import table
from .cross_polytope import nearest
from .lexicon_bpe import encode_decode
from .maxscore import exact_top_k
from .ngram_join import near_duplicates
from .ordinal import GRADES, classify, corpus_ratings
from .packing import pack, word_counts
from .pii import report
from .spelling import NOISE, spelling_variants
from .substring import remove_repeats
from .token_counts import token_counts
from .url_cascade import judge_urls, url_parts


# ------------------------------------------------------------------ fixed values
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Domain labels whose hosts go on the host list of op7.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), links=False).drop("class_id")


def op1_link_counts(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_class_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), corpus_ratings(table(spark, sf_dir, "labels")), GRADES)


def op5_pii(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_url_verdicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = url_parts(F.col("url"))[0]
    domain = F.regexp_extract(host, r"(?:^|\.)((?:" + "|".join(BLOCKED_LABELS) + r")\..*)$", 1)
    return judge_urls(pages, URL_RULES, pages.select(domain.alias("host")))


def op8_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_bpe_round_trip(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                         digest=True)


def op10_packing(spark, sf_dir):
    return pack(word_counts(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op12_substring_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"), noise=NOISE)


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_class_lm, op3_token_counts, op4_quality, op5_pii, op6_exact_top_k, op7_url_verdicts,
    op8_nearest, op9_bpe_round_trip, op10_packing, op11_hard_negatives, op12_substring_dedup,
    op13_spelling_variants)}

#: The whole join of operator 1 (class and number of links of each document); its SQL below fixes three columns.
MORE_QUERIES = {"op1_link_counts": op1_link_counts}

ORACLE = {
    "op6_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
          WHERE q.vec_id % 100 = 0),
        r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
          FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
        p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        p AS (SELECT doc_id, rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
        win AS (
          SELECT p.doc_id, p.rid, i, array_to_string(ws[i:i + 12], ' ') AS x
          FROM p JOIN w USING (rid) WHERE i + 12 <= len(ws)),
        least AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x),
        gone AS (
          SELECT DISTINCT rid, i + unnest(range(0, 13)) AS i FROM win JOIN least USING (x) WHERE doc_id > first),
        kept AS (
          SELECT p.rid, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS words
          FROM p ANTI JOIN gone ON p.rid = gone.rid AND p.i = gone.i GROUP BY p.rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(words, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (rid)""",
    "op1_near_duplicates": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, row_number() OVER () AS rid,
                 list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (
          SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
                   WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 2),
                     lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
          FROM w),
        e AS (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM s),
        l AS (
          SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b USING (x) WHERE a.rid <> b.rid
          GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (
          SELECT rid AS a, rid AS b FROM s
          UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
        SELECT s.doc_id, CAST(len(any_value(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
        FROM s JOIN reach ON reach.a = s.rid JOIN s o ON o.rid = reach.b
        GROUP BY s.rid, s.doc_id""",
    "op7_url_verdicts": r"""
        WITH r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
          ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        u AS (
          SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        v AS (
          SELECT row_number() OVER () AS rid, page_id,
                 translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM u),
        best AS (
          SELECT rid, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
          FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
        SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action
                 WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')
                 THEN 'block' ELSE 'allow' END AS verdict
        FROM v LEFT JOIN best USING (rid)""",
}
