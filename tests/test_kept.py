"""Kept dictionaries: edits across runs, interrupted and concurrent writers, commands."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from pagemill.operators import dictionary as dic
from pagemill.plans import dictionaries
from pagemill.sources import kept, lists


def as_dict(df):
    return None if df is None else {r.word: r.freq for r in df.collect()}


@pytest.fixture
def base(spark, tmp_path):
    (tmp_path / "words").write_text("the 5\ncat 1\nengine 2\n")
    return str(tmp_path / "words")


def test_edits_last_and_revert(spark, base):
    standard = lists.dictionary(spark, base)
    edited = lambda **o: as_dict(dictionaries.edited(spark, base, standard, **o))
    assert edited() == {"the": 5, "cat": 1, "engine": 2}
    assert edited(add="Cat dog") == {"the": 5, "cat": 2, "engine": 2, "dog": 1}
    assert edited(remove="the zzz") == {"cat": 2, "engine": 2, "dog": 1}
    assert edited() == as_dict(kept.current(spark, base + ".kept")) == {"cat": 2, "engine": 2, "dog": 1}
    assert edited(revert=True) == {"the": 5, "cat": 1, "engine": 2}
    assert kept.current(spark, base + ".kept") is None
    assert edited(add="dog", revert=True) == {"the": 5, "cat": 1, "engine": 2, "dog": 1}
    assert kept.last(spark, base + ".kept")[0] == 5
    assert as_dict(standard) == {"the": 5, "cat": 1, "engine": 2}


def test_interrupted_writers(spark, base, tmp_path, monkeypatch):
    folder = base + ".kept"
    kept.update(spark, folder, lambda found: lists.dictionary(spark, base))

    def stops(*args):
        raise KeyboardInterrupt

    # stopped while the words are written, and before the entry is made
    with monkeypatch.context() as m:
        m.setattr(kept.lists, "write_dictionary", stops)
        with pytest.raises(KeyboardInterrupt):
            kept.update(spark, folder, lambda found: dic.shrink(found, 1))
    with monkeypatch.context() as m:
        m.setattr(kept, "_enter", stops)
        with pytest.raises(KeyboardInterrupt):
            kept.update(spark, folder, lambda found: dic.shrink(found, 1))
    (tmp_path / "words.kept" / "log" / ".draft").write_text("half")
    assert as_dict(kept.current(spark, folder)) == {"the": 5, "cat": 1, "engine": 2}
    kept.update(spark, folder, lambda found: dic.shrink(found, 1))
    assert as_dict(kept.current(spark, folder)) == {"the": 5, "engine": 2}


def test_a_slower_writer_starts_again(spark, base):
    folder, seen = base + ".kept", []

    def slow(found):
        seen.append(as_dict(found))
        if len(seen) == 1:  # another writer comes between
            kept.update(spark, folder, lambda f: dic.add(lists.dictionary(spark, base), "dog"))
        return dic.add(found if found is not None else lists.dictionary(spark, base), "owl")

    kept.update(spark, folder, slow)
    assert seen == [None, {"the": 5, "cat": 1, "engine": 2, "dog": 1}]
    assert as_dict(kept.current(spark, folder)) == {"the": 5, "cat": 1, "engine": 2, "dog": 1, "owl": 1}
    with pytest.raises(kept.Conflict):
        kept.update(spark, folder, lambda f: kept.update(spark, folder, lambda g: g) and f, tries=2)


def test_no_edit_of_many_writers_is_lost(spark, base):
    folder, standard = base + ".kept", lists.dictionary(spark, base)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda w: kept.update(spark, folder, lambda f: dic.add(standard if f is None else f, w), tries=30), ["owl", "fox", "elk"]))
    assert as_dict(kept.current(spark, folder)) == {"the": 5, "cat": 1, "engine": 2, "owl": 1, "fox": 1, "elk": 1}


def test_commands(spark, base, tmp_path, capsys):
    run = lambda *a, **o: dictionaries.main([base, *a], spark, **o)
    now = lambda: as_dict(kept.current(spark, base + ".kept"))
    (tmp_path / "text").write_text("The owl, the fox.\nowl\n")
    assert run("-b", str(tmp_path / "text")) == 0
    assert now() == {"the": 2, "owl": 2, "fox": 1}
    assert run("-m") == 0
    assert now() == {"the": 7, "owl": 2, "fox": 1, "cat": 1, "engine": 2}
    assert run("-s") == 0
    assert now() == {"the": 7, "owl": 2, "engine": 2}
    (tmp_path / "other").write_text("owl 3\ncat -1\n")
    assert run("-m", str(tmp_path / "other")) == 0
    assert now() == {"owl": 3, "the": 5, "engine": 2, "cat": 2}
    assert run("-t", "Two_words", fetch=lambda titles: "".join(f"<page><title>{t}</title><text>An engine, {t}.</text></page>" for t in titles)) == 0
    assert now() == {"an": 1, "engine": 3, "two": 1, "words": 1, "the": 5, "cat": 1}
    assert "'words': 6" in capsys.readouterr().out
    assert dictionaries.main([str(tmp_path / "none"), "-s"], spark) == 1
    with pytest.raises(SystemExit):
        run("-s", "-m")
