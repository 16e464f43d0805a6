import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from pagemill.llm import bpe, lexicon, tokens, wavelet

TEXTS = [
    None, "", " ", "\n", "The and attion*** to!! thanedble,\nanea. Eriner  thanea.", "don't can't!' we'll __a_ b_c 12ab 3.5", " lead", "trail ", "a\n \nb c\n d  e \t f　 g\n\n h", "x\x1cy a\x85b \xa0c",
    "a <|endoftext|> b<|startoftext|>c  <|endoftext|>", "İstanbul ΣΑΣ été naïve ﬁne ß́ À́", "日本語 テキスト 😀👍🏽 Ⅷ ² ½", "!" * 300 + "ab" * 200 + " " * 70 + "x", "é ́e a​b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    syllables = ["the", "an", "er", "Ing", "é", "ß", "***", "!!", ",", ".", "|", "7", "'s"]
    made = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = [(i * 2, t) for i, t in enumerate(TEXTS + made)] + [(4, "again"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_lexicon():
    rng = random.Random(1)
    words = {("".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))).encode(): [rng.randint(0, 9) for _ in range(rng.randint(0, 3))] for _ in range(500)}
    held = lexicon.Lexicon(lexicon.build(words.items()))
    assert len(held) == len(words)
    assert sorted(held.numbers(sorted(words)).tolist()) == list(range(len(words)))
    ask = [*words, b"abcabcabcabc", b"", b"zz", b"a\xff"]
    assert held.lookup(ask) == [np.array(words[w], "<u4").tobytes() if w in words else None for w in ask]
    assert held.lookup([]) == []


def test_lexicon_shares_suffixes_and_maps(tmp_path):
    words = [(f"{a}{b}tion".encode(), [1]) for a in "abcdef" for b in "xyz"]
    content = lexicon.build(words)
    assert lexicon.Lexicon(content).n_states == 7  # two letters, then one common end
    (tmp_path / "l").write_bytes(content)
    held = lexicon.Lexicon(str(tmp_path / "l"))
    assert isinstance(held.keys, np.memmap)
    assert held.numbers([b"axtion", b"axtio"]).tolist() == [0, -1]
    assert lexicon.Lexicon(lexicon.build([])).numbers([b"a"]).tolist() == [-1]
    with pytest.raises(ValueError, match="not a lexicon"):
        lexicon.Lexicon(b"x" * 80)


@pytest.mark.parametrize("words", [0, 20, 40_000])
def test_bpe_against_the_library(docs, words):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    out = bpe.encoded(docs, path, bpe.Lexical(lexicon_words=words, memo=50)).collect()
    assert {(r.doc_id, r.text) for r in out} == text
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, r.text
        assert r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_bpe_compares_in_the_worker(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = {(r.doc_id, r.ids, r.decoded == (r.text or "")) for r in bpe.encoded(docs, path).collect()}
    out = bpe.encoded(docs, path, compare=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert {(r.doc_id, r.ids, r.round_trip) for r in out.collect()} == whole


def test_bpe_digests_and_clashes(docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = bpe.digests(docs.where("doc_id = 8"), path).first()
    ids = library.encode(TEXTS[4], add_special_tokens=False).ids
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TEXTS[4].encode()).hexdigest())
    clash = spark.createDataFrame([(1, "ab", "x", 5)], "doc_id long, text string, ids string, n int")
    assert bpe.encoded(clash, path).columns == ["doc_id", "text", "n", "n_tokens", "ids", "decoded"]
    dotted = spark.createDataFrame([(1, "ab", "x", 5)], "doc_id long, text string, `a b.c` string, n int")
    (row,) = bpe.encoded(dotted, path).collect()
    assert (row["a b.c"], row.decoded, row.n) == ("x", "ab", 5)
    assert bpe.digests(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("n_bits", [1, 5, 16, 18])
def test_wavelet(n_bits):
    rng = np.random.default_rng(n_bits)
    ids = (rng.zipf(1.4, 3000) % (1 << n_bits)).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(ids, n_bits, {"x": np.arange(3)}))
    assert (m.decode() == ids).all()
    assert (m.extra("x") == np.arange(3)).all()
    at = rng.integers(0, len(ids), 200)
    assert (m.access(at) == ids[at]).all()
    for token in [*set(ids[:20].tolist()), (1 << n_bits) - 1, 1 << n_bits]:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where)
        for place in (0, 1, 511, 512, 513, 2999, 3000, 9999):
            assert m.rank(token, place) == (where < place).sum()
        for k in {0, len(where) // 2, len(where) - 1, len(where)}:
            assert m.select(token, k) == (where[k] if 0 <= k < len(where) else -1)


def test_wavelet_opens_only_what_it_needs(tmp_path):
    rng = np.random.default_rng(3)
    n, n_bits = (1 << 20) + 77, 12
    ids = (rng.zipf(1.3, n) % (1 << n_bits)).astype(np.uint16)
    (tmp_path / "w").write_bytes(wavelet.build(ids, n_bits))
    content = np.memmap(tmp_path / "w", np.uint8, "r")
    m = wavelet.WaveletMatrix(content.data)
    assert m.n_pieces == 5 and m.opened == 0
    for place in (0, 262_143, 262_144, n // 2, n - 1):
        m = wavelet.WaveletMatrix(content.data)
        assert m.access([place])[0] == ids[place] and m.opened <= n_bits
    for token in (1, 2, 7, 300, 4000):
        where = np.flatnonzero(ids == token)
        for k in {0, len(where) // 3, len(where) - 1}:
            m = wavelet.WaveletMatrix(content.data)
            assert m.select(token, k) == where[k] and m.opened <= 4 * n_bits
            place = int(where[k]) + 1
            m = wavelet.WaveletMatrix(content.data)
            assert m.rank(token, place) == k + 1 and m.opened <= 2 * n_bits
    m = wavelet.WaveletMatrix(content.data, keep=3)
    at = rng.integers(0, n, 500)
    assert (m.access(at) == ids[at]).all() and len(m._held) <= 3
    assert (m.decode() == ids).all()


def test_wavelet_empty():
    m = wavelet.WaveletMatrix(wavelet.build(np.empty(0, np.uint16), 16))
    assert len(m.decode()) == m.count(3) == 0
    assert m.select(3, 0) == -1
    with pytest.raises(ValueError, match="not a wavelet"):
        wavelet.WaveletMatrix(b"12345678901234567890")


@pytest.mark.parametrize("p", [tokens.Shards(), tokens.Shards(shard_tokens=50, part_chars=2000, memo=30, batch_bytes=500)])
def test_shards(docs, p):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = tokens.round_trip(docs, path, p).collect()
    rows = sorted((r for r in out), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    expected = sorted((r.doc_id is not None, r.doc_id or 0, ids) for r in docs.collect() for ids in [[*library.encode(r.text or "", add_special_tokens=False).ids, 2]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == sorted((a, b, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for a, b, ids in expected)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_shards_of_nothing(docs):
    assert tokens.round_trip(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
