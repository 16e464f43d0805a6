from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_names():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, DATA).collect()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert 0 < len(out)
    assert all(r.round_trip for r in out)
    same = 0
    for r in out:
        assert r.n_tokens * 4 == len(r.ids)
        same += library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) == source[r.doc_id]
    assert same > 0.8 * len(out)  # the others hold personal data


def test_stages_keep_the_columns_and_survive_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_queries_run(spark, name):
    full = next(x for x in entry.queries() if x.startswith(name))
    assert entry.queries()[full](spark, DATA).count() > 0
