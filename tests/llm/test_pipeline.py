import brute
import corpus_pipeline
import pytest
from blotter.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's result, each written and read again."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(str(out / name))
        frames.append(spark.read.parquet(str(out / name)))
    return frames


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    for f in stages[1:-1]:
        assert f.columns == stages[0].columns


def test_toxicity_stage_follows_the_operator(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in toxicity.toxicity(stages[0], labels).collect() if not r.predicted}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_document_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    _, comps, _ = brute.simhash_components(rows)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(comps))


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect() if not brute.contamination(r.text, items)[1]}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_secrets_are_masked_and_no_document_lost(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not brute.base_spans(r.text)
        assert brute.base_spans(before[i].text) or "[secret]" in r.text or r.text == before[i].text


def test_packing_has_every_document(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
