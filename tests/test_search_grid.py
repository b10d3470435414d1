"""A query set above the broadcast bound is scored block against block, not at the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from pactum.operators import search as S


def plain(corpus, queries, k):
    unit = lambda v: (lambda a: a / (np.linalg.norm(a) or 1.0))(np.asarray(v, dtype=np.float64))
    rows = {}
    for q, v in queries:
        scored = sorted((-round(float((unit(v) * unit(w)).sum()), 12), i) for i, w in corpus)[:k]
        rows |= {(q, r + 1): i for r, (_, i) in enumerate(scored)}
    return rows


@pytest.mark.parametrize("n,k,tile", [(160, 3, 7), (2, 5, 1024), (1, 1, 16)])
def test_grid_equals_brute_force(spark, monkeypatch, n, k, tile):
    monkeypatch.setattr(S, "TILE_COLS", tile)
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)                    # several blocks of either side
    rnd = np.random.default_rng(n)
    vecs = [[float(np.float32(x)) for x in v] for v in rnd.normal(size=(n, 6))]
    for i in range(n):
        if i % 4 == 1:
            vecs[i] = vecs[0]                                   # more copies than k: the least ids win
        if i % 10 == 7:
            vecs[i] = [0.0] * 6
    corpus = [(f"v{i:03d}", v) for i, v in enumerate(vecs)]
    queries = [(i, v) for i, v in enumerate(vecs + vecs[:3])]
    c = spark.createDataFrame(corpus, "vec_id string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id bigint, query_vec array<float>")

    def whole(df):
        raise AssertionError("the query set went to the driver")
    monkeypatch.setattr(DataFrame, "toPandas", whole)
    found = S.cosine_topk(c, q, k, max_queries=0)
    assert found.columns == ["query_id", "vec_id", "cosine", "rank", "distance"]
    assert {(r.query_id, r.rank): r.vec_id for r in found.collect()} == plain(corpus, queries, k)


def test_grid_refuses_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    q = rows.selectExpr("vec_id AS query_id", "embedding AS query_vec")
    with pytest.raises(Exception, match="another length|inhomogeneous|mismatch"):
        S.cosine_topk(rows, q, 1, max_queries=0).collect()
