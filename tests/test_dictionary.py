import random
import string

import pytest
from pyspark.sql import functions as F

from pagemill.operators import dictionary as dic
from pagemill.operators import positions, spelling, tagging
from pagemill.sources import lists

XML = (
    "<mediawiki><page><title>Ada</title><text xml:space=\"preserve\">'''Ada''' wrote [[Notes (text)|notes]] on the [[engine#Parts]]. {{Infobox|a=1}} See [[File:x.png]] &amp; [[Babbage]].</text></page>"
    "<page><title>Countess</title><text>#REDIRECT [[Ada]]</text></page>"
    "<page><title>Engine</title><text>== Parts ==\nA {| table |} of [[gear]]s, 12 in all_of_it.<ref>none</ref></text></page></mediawiki>"
)


def frame(spark, d):
    return spark.createDataFrame(list(d.items()), "word string, freq long")


def as_dict(df):
    return {r.word: r.freq for r in df.collect()}


def test_algebra(spark):
    rows = spark.createDataFrame([("The cat's the 2nd",), (None,)], "text string")
    assert as_dict(dic.train(rows)) == {"the": 2, "cat": 1, "s": 1, "nd": 1}
    a, b = frame(spark, {"x": 2, "y": 1}), frame(spark, {"x": -2, "z": 4})
    assert as_dict(dic.merge(a, b)) == {"y": 1, "z": 4}
    assert as_dict(dic.shrink(a, 1)) == {"x": 2}
    assert as_dict(dic.add(a, "a banana a")) == {"x": 2, "y": 1, "a": 2, "banana": 1}
    assert as_dict(dic.remove(a, ["Y 7", ""])) == {"x": 2}
    assert as_dict(dic.remove_all(a, b)) == {"y": 1}


@pytest.mark.parametrize(("most", "left"), [(1, 1), (2, 1), (3, 3), (9, 4), (0, 0)])
def test_cap(spark, most, left):
    assert dic.cap(frame(spark, {"a": 9, "b": 5, "c": 5, "d": 1}), most).count() == left


def test_files(spark, tmp_path):
    lists.write_dictionary(frame(spark, {"a": 3, "b": 1}), str(tmp_path / "d"))
    assert as_dict(lists.dictionary(spark, str(tmp_path / "d"))) == {"a": 3, "b": 1}
    (tmp_path / "odd").write_text("a x\nb\n\nc 4\n")
    assert as_dict(lists.dictionary(spark, str(tmp_path / "odd"))) == {"a": 1, "b": 1, "c": 4}
    (tmp_path / "list").write_text("# note\n One \n\ntwo words\n")
    assert lists.patterns(spark, str(tmp_path / "list")) == ["one", "two words"]
    (tmp_path / "none").write_text("# note\n")
    assert "the" in lists.patterns(spark, str(tmp_path / "none"), stop=True)


def edits1(w):
    s = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    a = string.ascii_lowercase
    return {x + y[1:] for x, y in s if y} | {x + y[1] + y[0] + y[2:] for x, y in s if len(y) > 1} | {x + c + y[1:] for x, y in s if y for c in a} | {x + c + y for x, y in s for c in a}


def suggest(w, d):
    if len(w) == 1 or w in d:
        return w, 1.0
    for cands in (edits1(w) & d.keys(), {y for x in edits1(w) for y in edits1(x)} & d.keys()):
        if cands:
            total = sum(d[c] for c in cands)
            return max((d[c] / total, c) for c in cands)[::-1]
    return w, 0.0


def test_suggestions_against_brute_force(spark):
    rng = random.Random(3)
    made = lambda k: "".join(rng.choice("abcde") for _ in range(k))
    d = {made(rng.randint(1, 6)): rng.randint(1, 9) for _ in range(120)} | {"test": 3, "ac": 2}
    words = sorted({made(rng.randint(1, 7)) for _ in range(80)} | {"tset", "ca", "abc", "zzzzzz", "q"})
    got = spelling.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), frame(spark, d))
    found = {r.word: (r.correction, round(r.confidence, 9)) for r in got.collect()}
    assert found == {w: (c, round(p, 9)) for w in words for c, p in [suggest(w, d)]}


def test_correction_modes(spark):
    d = frame(spark, {"test": 5, "the": 9, "is": 2})
    rows = spark.createDataFrame([(1, "TSET the Tset zqzqzq x-y 12"), (2, "")], "k int, text string")
    out = lambda df: {r.k: r.text for r in df.collect()}
    assert out(spelling.autocorrected(rows, "k", d)) == {1: "TEST the Test zqzqzq x-y 12", 2: ""}
    assert out(spelling.autocorrected(rows, "k", d, remove=True)) == {1: "TEST the Test", 2: ""}
    assert out(spelling.known_only(rows, "k", d)) == {1: "the", 2: ""}
    marks = spark.createDataFrame([(1, "The tset is. It ran, the (tset)! 'the' e-mail_ ...")], "k int, text string")
    assert out(spelling.autocorrected(marks, "k", d)) == {1: "The test is. Is ran, the( test)! 'the' e-mail_..."}
    assert out(spelling.autocorrected(marks, "k", d, remove=True)) == {1: "The test is. Is, the( test)!_..."}
    assert out(spelling.known_only(marks, "k", d)) == {1: "The is., the()!_..."}
    log = spelling.correction_log(rows, "k", d).orderBy("pos").collect()
    assert [(r.word, r.attempted, r.correction) for r in log] == [("TSET", True, "TEST"), ("Tset", True, "Test"), ("zqzqzq", False, None)]


def test_documents_are_corrected_like_brute_force(spark, tmp_path):
    from pagemill.queries import FREQ_CUT, QUERIES

    words = ["river", "house", "table", "garden"]
    texts = [" ".join(words * (FREQ_CUT + 1)), "teh rievr Huose x zzzzzz " + "q" * 3000 + " gardn tabel 12", None, "A HOUES"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    d = {w: FREQ_CUT + 1 for w in words}
    run = lambda n: QUERIES[n](spark, str(tmp_path)).collect()
    low = {w for t in texts if t for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()}
    expected = {w: (c, round(p, 6)) for w in low for c, p in [suggest(w, d) if len(w) < 20 else (w, 0.0)]}
    assert {r.word: (r.correction, r.confidence) for r in run("spelling_suggest_documents")} == expected
    long = "q" * 3000
    assert {r.doc_id: r.text for r in run("autocorrect_documents")} == {0: texts[0], 1: f"teh river House x zzzzzz {long} garden table 12", 2: "", 3: "A HOUSE"}
    assert {r.doc_id: r.text for r in run("autocorrect_remove_documents")}[1] == "river House x garden table"
    log = [(r.word, r.correction) for r in run("corrections_documents") if r.doc_id == 1 and r.attempted]
    assert sorted(log) == [("Huose", "House"), ("gardn", "garden"), ("rievr", "river"), ("tabel", "table"), ("x", "x")]


def test_tags_and_lemmas(spark):
    rows = spark.createDataFrame([(w,) for w in ("The", "running", "quickly", "boxes", "12", "Rome", "cat", "happiest")], "w string")
    assert [r.t for r in rows.select(tagging.tag(F.col("w")).alias("t")).collect()] == ["DT", "VBG", "RB", "NNS", "CD", "NNP", "NN", "JJS"]
    d = frame(spark, {"box": 1, "walk": 1, "make": 1, "the": 1})
    rows = spark.createDataFrame([(1, "The boxes walked making it all"), (2, "")], "k int, text string")
    assert {r.k: r.text for r in tagging.lemmatized(rows, "k", d).collect()} == {1: "the box walk make it all", 2: ""}
    rows = spark.createDataFrame([(1, "The boxes walked. It ran, (boxes)!")], "k int, text string")
    assert tagging.lemmatized(rows, "k", d).first().text == "the box walk. it ran,( box)!"


def test_wiki(spark):
    pages = dic.wiki_pages(spark.createDataFrame([(XML,)], "xml string"))
    assert {r.title: r.links for r in pages.select("title", dic.wiki_links(F.col("body")).alias("links")).collect()}["Ada"] == ["Notes (text)", "engine", "Babbage"]
    assert {r.title: r.t for r in pages.select("title", dic.wiki_text(F.col("body")).alias("t")).collect()}["Ada"] == "Ada wrote on the See"
    assert {r.title: r.target for r in dic.wiki_redirects(pages).collect()} == {"Ada": None, "Countess": "Ada", "Engine": None}


def test_long_words_meet_by_their_parts(spark):
    """Every word within two edits of a long one is a candidate, whichever edits they are."""
    import random

    rng = random.Random(4)
    letters = "abcde"

    def edit(w: str) -> str:
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        if kind == 0:
            return w[:i] + w[i + 1 :]
        if kind == 1:
            return w[:i] + rng.choice(letters) + w[i:]
        if kind == 2:
            return w[:i] + rng.choice(letters) + w[i + 1 :]
        return w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]

    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(9, 40))) for _ in range(60)]
    pairs = {(edit(edit(w)), w) for w in words for _ in range(8)} | {(edit(w), w) for w in words for _ in range(4)}
    unknown = spark.createDataFrame([(u,) for u in sorted({u for u, _ in pairs})], "word string")
    d = spark.createDataFrame([(w, 3) for w in words], "word string, freq long")
    near = {(r.word, r.cand) for r in spelling._near(unknown, d, 2).collect()}
    assert pairs <= near


def test_pairs_are_checked_before_they_move(spark):
    unknown = spark.createDataFrame([("abcdef",)], "word string")
    d = spark.createDataFrame([(w, 3) for w in ["abcdxy", "badcef", "xycdef", "bcdefa", "abef", "cdefab"]], "word string, freq long")
    # cdefab meets abcdef by the key cdef but is four edits away
    assert {(r.cand, r.lev) for r in spelling._candidates(unknown, d, 2).collect()} >= {("abcdxy", 2), ("badcef", 3), ("abef", 2)}
    assert "cdefab" not in {r.cand for r in spelling._candidates(unknown, d, 2).where("lev < 4").collect()}
    far = spark.createDataFrame([("zzabcd", 3)], "word string, freq long")
    assert spelling._candidates(spark.createDataFrame([("abcdyy",)], "word string"), far, 2).count() == 0


def damerau(a, b):
    """Edits between two words, a transposition among them, by Lowrance and Wagner's recurrence."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
            k = max((x for x in range(1, i) if a[x - 1] == b[j - 1]), default=0)
            m = max((x for x in range(1, j) if b[x - 1] == a[i - 1]), default=0)
            if k and m:
                d[i, j] = min(d[i, j], d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
    return d[len(a), len(b)]


@pytest.mark.parametrize("edits", [1, 2])
def test_blocks_of_words_find_all_pairs(spark, monkeypatch, edits):
    monkeypatch.setattr(spelling, "KEYS_AT_ONCE", 300)  # several blocks of a length
    rng = random.Random(5)
    made = lambda low, high, letters: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    d = {made(1, 6, "abé"): rng.randint(1, 9) for _ in range(60)} | {"bxa": 1, "ca": 2, "aaaa": 3, "b": 4}
    base = made(spelling.LONG, spelling.LONG, "ab")
    d |= {base[k:] + base[: k // 2]: 1 for k in range(4)} | {base + "ab"[:k]: 2 for k in range(3)}
    words = {made(2, 7, "abé") for _ in range(80)} | {"ab", "abc", "aaab", "aa"} | {base[:-1], base + "ba", base + "abb", base[1:] + "a", base[2:]}
    words = sorted(words - d.keys())
    unknown = spark.createDataFrame([(w,) for w in words], "word string")
    assert spelling._dealt(unknown, frame(spark, d), edits).where("not known").groupBy(F.length("word")).agg(F.countDistinct("task").alias("n")).where("n > 1").count()
    found = sorted((r.word, r.cand, r.freq, r.edits) for r in spelling._near(unknown, frame(spark, d), edits).collect())
    expected = sorted((w, c, d[c], damerau(w, c)) for w in words for c in d if damerau(w, c) <= edits)
    assert found == expected


def test_words_move_and_not_their_keys(spark):
    """Words of 14 letters that share parts of three letters, but are far apart, met in pairs before."""
    rng = random.Random(6)
    far = lambda: "the" + "".join(rng.choice(string.ascii_lowercase) for _ in range(8)) + "ing"
    words, known = [far() for _ in range(400)], [far() for _ in range(300)]
    unknown, d = spark.createDataFrame([(w,) for w in words], "word string"), frame(spark, dict.fromkeys(known, 30))
    assert spelling._dealt(unknown, d, 2).count() == 700
    block = spelling._Block(words, 2)
    assert sum(len(w) for w, _, _ in block.near(known)) == spelling._near(unknown, d, 2).count() < 10


def _made_once(spark, d):
    """A dictionary, and how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def word(w):
        made.add(1)
        return w

    return frame(spark, d).select(F.udf(word)("word").alias("word"), "freq"), made


def test_frequent_tokens_do_not_move_to_be_corrected(spark):
    d, made = _made_once(spark, {"test": 5, "the": 9})
    rows = spark.createDataFrame([(1, "the The tHe THE test tset Tset zq 12, x-y!"), (2, "the " * 500 + "tHe"), (3, None)], "k int, text string")
    out = spelling.autocorrected(rows, "k", d)
    assert {r.k: r.text for r in out.collect()} == {1: "the The the THE test test Test zq 12, x-y!", 2: "the " * 500 + "the", 3: ""}
    assert made.value == 2
    texts = positions.cut(rows, "k")
    tokens = spelling._tokens(texts, frame(spark, {"the": 9}))
    assert {r.token: r.known for r in tokens.where("word = 'the'").collect()} == dict.fromkeys(["the", "The", "tHe", "THE"], True)
    same = tokens.where("token in ('the', 'The', ',')")
    changes = spark.createDataFrame([("tHe", "the")], "token string, value string")
    found = positions.with_changes(texts, "k", changes, same)
    assert {r.k: positions.changed(r.changes) for r in found.collect()} == {1: {"tHe": "the"}, 2: {"tHe": "the"}, 3: {}}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and plan.rindex("LeftAnti") > plan.index("Inner")  # below the join with the changes


def test_frequent_tokens_are_few(spark, monkeypatch):
    monkeypatch.setattr(positions, "FREQUENT", 10)
    tokens = positions.counted(spark.createDataFrame([("a " * 11 + "b " * 10 + " ".join("cdefghijk") * 9,)], "tokens string"))
    total = tokens.agg(F.sum("n")).first()[0]
    assert {r.token for r in positions.frequent(tokens).collect()} == {r.token for r in tokens.collect() if r.n * 10 > total} == {"a", "b"}
    assert positions.frequent(tokens.limit(0)).count() == 0


def test_frequent_tokens_do_not_move_to_be_removed(spark):
    d, made = _made_once(spark, {"test": 5, "the": 9})
    rows = spark.createDataFrame([(1, "the The tHe tset zq zq zq 12 12, x-y!"), (2, "the " * 500 + "12 zq"), (3, None)], "k int, text string")
    out = spelling.autocorrected(rows, "k", d, remove=True)
    assert {r.k: r.text for r in out.collect()} == {1: "the The the test,!", 2: ("the " * 500).strip(), 3: ""}
    assert made.value == 2


def test_frequent_tokens_do_not_move_to_be_logged(spark):
    d, made = _made_once(spark, {"test": 5, "the": 9})
    rows = spark.createDataFrame([(1, "the tset zq zq 12, a x-y!"), (2, "the " * 500 + "zq"), (3, None)], "k int, text string")
    log = spelling.correction_log(rows, "k", d)
    found = sorted((r.k, r.pos, r.word, r.correction) for r in log.collect())
    assert found == [(1, 1, "tset", "test"), (1, 2, "zq", None), (1, 3, "zq", None), (1, 6, "a", "a"), (2, 500, "zq", None)]
    assert made.value == 2
    texts = positions.cut(rows, "k")
    same = spark.createDataFrame([("the",), (",",)], "token string")
    assert sorted((r.k, r.pos) for r in positions.places(texts, "k", same).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 6), (1, 7), (1, 8), (2, 500)]
