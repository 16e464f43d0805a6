"""Encoding by distinct chunks against the library over whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = pieces.Cut(block_bytes=8_000, slice_bytes=1_000, bucket_bytes=2_000)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n: int) -> list:
    r = random.Random(5)
    some = [*"abcdeéß \n\t▁.,0中🎉　\xa0", "the", "ing", " a", "  "]
    made = ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(n)]
    return [None, "", " ", "  ", "▁", "a ", "\x00", " a  b\nc ", "x" * 3000, "中" * 500, "a b " * 2000, *made]


def test_equals_the_library(spark, library):
    texts = odd_texts(300)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` int, block string")
    rows = pieces.digests(docs, PATH, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_and_decoded(spark, library):
    texts = odd_texts(20)
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "same"), (None, "same")], "doc_id long, text string")
    rows = pieces.encoded(docs, PATH, SMALL).collect()
    assert sorted((np.frombuffer(r.ids, "<u4").tolist() if r.ids else [], r.decoded) for r in rows) == sorted((library.encode(t or ""), library.decode(library.encode(t or ""))) for t in [*texts, "same", "same"])


def test_empty(spark):
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_tokens for r in pieces.digests(only, PATH).collect()] == [0, 0]


def test_cut():
    chunks, counts = pieces.cut(pa.array(["a  b", None, "", " c▁", "d"]))
    assert chunks.to_pylist() == [" a", "  b", "  c", " ", " d"]
    assert counts.tolist() == [2, 0, 0, 2, 1]


def test_wide_ids():
    data = np.array([1, 2], "<u2").tobytes() + np.array([70_000], "<u4").tobytes() + b"\1" + np.array([3], "<u2").tobytes()
    flat, n = pieces._unpacked(data, np.array([4, 5, 2]))
    assert (flat.tolist(), n.tolist()) == ([1, 2, 70_000, 3], [2, 1, 1])
