import re

import numpy as np
import pyarrow as pa

from pagemill.llm import grams

TEXTS = [None, "", " \t\n", "one", "Über den\x0bWolken ", "a a a a a a", "x " * 50 + "\x1cq\x85 z", "日本 語\n日本", "last"]


def test_words_and_slices():
    for most in (1, 20, 1 << 20):
        found, hashes = [], {}
        for i, _, texts in grams.slices(pa.array(TEXTS), most):
            w = grams.words(texts)
            for d, a, b, h in zip(w.doc, w.start, w.end, w.hash, strict=True):
                word = texts.data[a:b].tobytes().decode()
                found.append((i + int(d), word))
                assert hashes.setdefault(word, int(h)) == int(h)
        assert found == [(i, x) for i, t in enumerate(TEXTS) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        assert len(set(hashes.values())) == len(hashes)
    assert list(grams.slices(pa.array([], pa.string()))) == []


def test_sliced_column():
    column = pa.array(["zero", "one two", "three"]).slice(1)
    (_, _, texts), = grams.slices(column)
    assert texts.data.tobytes() == b"one twothree"


def test_shingles_are_those_of_the_words():
    texts = ["A b C d e f", "a B c D E", "b c d e f", "b c", "B C", "c b", "", None, "d e b c"]
    (_, _, t), = grams.slices(pa.array(texts))
    doc, h = grams.shingles(t)
    made = [set(h[doc == i].tolist()) for i in range(len(texts))]

    def true(x):
        w = (x or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(made[i] & made[j]) == len(true(a) & true(b))


def test_characters():
    (_, _, t), = grams.slices(pa.array(["añ", "", "日😀x"]))
    points, at = grams.characters(t)
    assert "".join(map(chr, points)) == "añ日😀x"
    assert at.tolist() == [0, 2, 2, 5]


def test_features_do_not_depend_on_neighbours():
    alone = grams.features(next(grams.slices(pa.array(["the the cat"])))[2], 16)
    both = grams.features(next(grams.slices(pa.array(["zz y", "the the cat", ""])))[2], 16)
    for (_, a), (d, b) in zip(alone, both, strict=True):
        assert sorted(a.tolist()) == sorted(b[d == 1].tolist())
    assert all(len(b) == 0 for _, b in grams.features(next(grams.slices(pa.array([""])))[2], 16))


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(grams.mix(x))) == len(x)


def regular(n):
    """The Thue-Morse word of 2**n letters and its complement."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_regular_runs_have_hashes_of_their_own():
    for n in (6, 10, 12):
        a, b = regular(n)
        for first, second in ((a, b), (a.replace("a", "xy"), b.replace("a", "xy")), (" ".join(a), " ".join(b))):
            (_, _, t), = grams.slices(pa.array([first, second]))
            doc, h = grams.shingles(t)
            w = grams.words(t)
            if " " not in first:
                assert len(set(w.hash.tolist())) == 2
                assert len(set(h.tolist())) == 2
            whole = grams.run_hashes(t.data, t.at[:-1], t.at[1:])
            assert whole[0] != whole[1]


def test_runs_by_bytes():
    data = np.frombuffer(b"abcabdabc" + b"x" * 100 + b"x" * 99 + b"y", np.uint8)
    start, end = np.array([0, 3, 6, 9, 109, 0]), np.array([3, 6, 9, 109, 209, 3])
    other, stop = np.array([6, 0, 0, 109, 109, 0]), np.array([9, 3, 2, 209, 209, 3])
    assert grams.same_runs(data, start, end, other, stop).tolist() == [True, False, False, False, True, True]
    h = grams.run_hashes(data, start[:5], end[:5])
    assert h[0] == h[2] and len(set(h.tolist())) == 4
    assert grams.run_hashes(np.frombuffer(b"ABC", np.uint8), np.array([0]), np.array([3]), True)[0] == grams.run_hashes(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3]))[0]
