import shutil

import pytest

import corpus_pipeline
from slateledger.llm import toxicity
from slateledger.llm.queries import ORACLE, QUERIES
from tests.llm import brute


def test_stages_equal_brute_force(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    stay = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert stay == {d for d, t in text.items() if model.score([(t or "").encode()])[0] < 0.5}
    left = [(d, text[d]) for d in sorted(stay)]
    left = [(d, t) for d, t in left if brute.copies(left)[d][0] == d]
    near = brute.components({d: brute.fingerprint(t) for d, t in left})
    left = [(d, t) for d, t in left if near[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    dirty = brute.contamination(left, items)
    left = {d for d, _ in left if not dirty[d][3]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == left
    assert left < stay < set(text)


def test_stages_keep_columns_and_rows_without_ids(spark, sf):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (None, "ab", "z"), (None, None, None)], "doc_id long, text string, gone_id string")
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, sf), sf)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 2


def test_registered():
    assert [f"op{n}_" for n in range(1, 14)] == [k.split("_")[0] + "_" for k in QUERIES]
    assert set(ORACLE) <= set(QUERIES)


ODD = [(1, "you idiot moron scum you", "x"), (2, None, "y"), (None, "a plain text", "z"), (None, None, None), (3, "", "v"), (3, "", "v"), (4, "word " * 3000, "w")]
COLUMNS = "doc_id long, text string, gone_id string, score double, spans string, part int, _n long"


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows_and_clashing_columns(spark, sf, stage):
    """Rows without id or text, repeated rows, columns that the operators use themselves; then no rows at all."""
    fn = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame([(d, t, x, 0.5, "s", 1, 2) for d, t, x in ODD], COLUMNS)
    out = fn(spark, docs, sf).collect()
    if stage == "packing":
        assert sorted({(r.doc_id or 0, r.doc_tokens) for r in out if r.doc_tokens < 20}) == [(0, 1), (0, 4), (1, 8), (2, 1), (3, 1)] and {r.doc_id for r in out} == {1, 2, 3, 4, None}
    else:
        assert out and out[0].__fields__ == docs.columns
        ids = [r.doc_id for r in out]
        assert ids.count(None) == 2 and ids.count(4) == 1
        assert set(ids) == {"toxicity": {1, 2, 3, 4, None}, "exact_dedup": {1, 2, 4, None}, "near_dedup": {1, 2, 4, None}, "decontamination": {1, 2, 3, 4, None}}[stage]
    empty = fn(spark, docs.where("false"), sf)
    assert empty.count() == 0 and (stage == "packing" or empty.columns == docs.columns)


def test_toxicity_learns_from_the_table(spark, sf):
    """The odd rows above, with the labelled documents: only the toxic one goes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9_000_000 + (d or 0), t) for d, t, _ in ODD], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs.unionByName(odd), sf).where("doc_id >= 9000000").collect()}
    assert kept == {9_000_000, 9_000_002, 9_000_003, 9_000_004}
