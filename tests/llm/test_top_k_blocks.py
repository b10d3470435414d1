"""Operator 6: query blocks are dealt, not gathered."""
import numpy as np
from pyspark.sql import functions as F

from pactum.llm import maxscore


def test_copies_of_query_blocks_are_not_gathered(spark, monkeypatch):
    """The planner took the copies of a small query table for small and sent them all through the driver."""
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 16)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    rng = np.random.default_rng(1)
    vec = rng.integers(-9, 9, (300, 6))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "vec_id long, embedding array<double>")
    out = maxscore.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5, scale=1)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    want = []
    for q in range(0, 300, 10):
        best = sorted((-int(vec[q] @ vec[v]), v) for v in range(300) if v != q)[:5]
        want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    assert got == want
