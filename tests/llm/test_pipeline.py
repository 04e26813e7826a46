"""Every stage of the pipeline against brute force on its own input."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from llm.edge_rows import ROWS, documents
from llm.test_exact_dedup import brute as exact_brute
from llm.test_mixing import brute as mix_brute
from llm.test_mixing import copies_by_cell
from llm.test_similarity import brute as near_brute
from tokenizers import Tokenizer

from renderscope.llm import quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents(spark).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i == 13 else 1) for i in range(1, 16)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "MinHash near-dedup", "source mixing", "BPE encoding",
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    passed = {r.doc_id for r in quality.classified(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == passed

    exact = corpus_pipeline.exact_stage(spark, docs, folder)
    assert exact.columns == columns
    assert {r.doc_id for r in exact.collect()} == {r[0] for r in exact_brute(ROWS) if r[3]}

    near = corpus_pipeline.near_stage(spark, docs, folder)
    assert near.columns == columns
    assert {r.doc_id for r in near.collect()} == {r[0] for r in near_brute(ROWS) if r[3]}

    mix = corpus_pipeline.mix_stage(spark, docs, folder)
    assert mix.columns == columns
    assert copies_by_cell(mix.collect()) == {k: n for k, n in mix_brute(ROWS).items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.encode_stage(spark, near.filter("doc_id is not null"), folder).collect():
        ids = library.encode(next(x[1] for x in ROWS if x[0] == r.doc_id) or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() > 0
