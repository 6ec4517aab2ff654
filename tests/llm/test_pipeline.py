import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as P

SF_DIR = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in P.STAGES] == [
        "toxicity", "exact dedup", "MinHash near-dedup", "mixing to target weights", "BPE encoding and decoding",
    ]
    names = list(contract.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").persist()
    out = [docs]
    for _, function in P.STAGES:
        out.append(function(spark, out[-1], SF_DIR).persist())
    yield out
    for df in out:
        df.unpersist()


def test_stages_only_choose_rows(steps):
    whole = {tuple(r) for r in steps[0].collect()}
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == P.COLUMNS
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        assert {tuple(r) for r in after.collect()} <= whole


def test_exact_copies_go(steps):
    texts = ["".join(r.text.split()) for r in steps[2].collect()]
    assert len(texts) == len(set(texts)) == len({"".join(r.text.split()) for r in steps[1].collect()})


def test_last_stage_encodes(steps):
    library = Tokenizer.from_file(P.TOKENIZER)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_run_equals_the_stages(spark, steps):
    rows = sorted((r.doc_id, r.ids) for r in P.run(spark, SF_DIR).collect())
    assert rows == sorted((r.doc_id, r.ids) for r in steps[-1].collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, function in P.STAGES:
        docs = function(spark, docs, SF_DIR)
        assert docs.count() == 0
