"""The pipeline's stages, each held against what it claims."""
import corpus_pipeline as P
from test_edges import jaccard_components
from test_queries import SMALL, plain_spans

from pactum.llm.common import run_folder, stage, table


def test_stages_against_brute_force(spark):
    docs, folder, cols = table(spark, SMALL, "documents"), run_folder(spark), None
    cols = docs.columns
    seen = {}
    for name, step in P.STAGES:
        out = stage(step(spark, docs, SMALL), folder, name.replace(" ", "_"))
        seen[name] = (docs, out)
        if name != P.STAGES[-1][0]:
            assert out.columns == cols
        docs = out
    before, after = seen["near duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    _, root = jaccard_components([t for _, t in rows], P.NEAR_WIDTH, P.NEAR_NUM, P.NEAR_DEN)
    assert sorted(r.doc_id for r in after.collect()) == sorted(rows[k][0] for k in set(root))
    before, after = seen["personal data"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(old[r.doc_id]):
            assert r.text == old[r.doc_id]
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert sorted(map(str, P.run(spark, SMALL).collect())) == sorted(map(str, after.collect()))
