"""The pipeline's stages against plain versions on a small table."""

import corpus_pipeline
from docloom.llm import piece_codec, secret_scan
from docloom.llm.common import table
from tests.llm.test_methods import plain_components


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    names = set(docs.columns)
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, data).cache()
    labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(good.columns) == names
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    single = stage["near_duplicates"](spark, good, data).cache()
    expected = {d for d, (_, c) in plain_components(kept).items() if d == c}
    assert {r.doc_id for r in single.collect()} == expected and set(single.columns) == names
    safe = stage["secrets"](spark, single, data).cache()
    for r in safe.collect():
        assert r.text == secret_scan.redact(kept[r.doc_id]) and r.n_chars == len(r.text)
    mixed = stage["mixture"](spark, safe, data).cache()
    assert set(mixed.columns) == names and {r.doc_id for r in mixed.collect()} <= expected
    last = stage["pieces"](spark, mixed, data).collect()
    assert len(last) == mixed.count()
    codec, text = piece_codec.codec(piece_codec.DEFAULT_MODEL), {r.doc_id: r.text for r in safe.collect()}
    assert all(codec.decode(r.ids) == text[r.doc_id] for r in last)


def test_run_gives_the_stages_rows(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "lang", "source", "ids"]
