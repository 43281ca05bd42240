"""The pipeline's stages one after the other, against plain versions of them."""

import corpus_pipeline
from palisade.llm import common
from test_operators import SF, brute_components, brute_lines


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, leaks), (_, tokens) = corpus_pipeline.STAGES
    a = common.stored(quality(spark, docs, SF), "a")
    assert a.columns == columns and 0 < a.count() < docs.count()
    b = common.stored(lines(spark, a, SF), "b")
    rows = sorted((r.doc_id, r.text) for r in a.collect())
    want = brute_lines([t for _, t in rows])
    assert b.columns == columns and sorted((r.doc_id, r.text) for r in b.collect()) == [(d, t) for (d, _), t in zip(rows, want, strict=True)]
    c = common.stored(near(spark, b, SF), "c")
    kept = [d for (d, _), (i, _, k) in zip(rows, brute_components(want, 5, 80), strict=True) if i == k]
    assert c.columns == columns and sorted(r.doc_id for r in c.collect()) == kept
    e = common.stored(leaks(spark, c, SF), "e")
    assert e.columns == columns and set(r.doc_id for r in e.collect()) <= set(kept)
    out = tokens(spark, e, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in e.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in out)
