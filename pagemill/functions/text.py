"""Cleaning, tokens and sort keys, as Column functions.

Single steps are Spark's own expressions. The whole cleaning and the cutting
into tokens, which every report needs of the whole corpus, run over Arrow
batches: a text is passed over by a few fast string methods, and what stands
between two spaces is cut once for all its occurrences.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that become several ASCII letters.
WIDE = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
#: Letters and signs without a decomposition.
PLAIN = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-"}
#: What may stand at the edges of a word and is taken off.
PUNCTUATION = string.punctuation

#: Signs that become an apostrophe.
APOSTROPHES = "[‘’‚‛′`]"
KEPT = "a-zA-Z0-9' .;,\"$/@!?&\\-()_"


def _folds() -> tuple[str, str]:
    """Characters up to U+FFFF whose decomposition is one ASCII character and marks."""
    source, target = [], []
    for code in range(0xA0, 0x10000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and " " < base < "\x7f" and c not in WIDE and c not in PLAIN:
            source.append(c)
            target.append(base)
    return "".join([*source, *PLAIN]), "".join([*target, *PLAIN.values()])


_SOURCE, _TARGET = _folds()


def whitespace(c: Column) -> Column:
    """Every kind of white space becomes a space; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]", " ")


def fold(c: Column) -> Column:
    """Latin letters to ASCII. What has no ASCII form stays until :func:`symbols`."""
    wide = c
    for a, b in WIDE.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(wide, _SOURCE, _TARGET)).otherwise(c)


def apostrophes(c: Column) -> Column:
    return F.regexp_replace(c, APOSTROPHES, "'")


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen and white space part."""
    return F.regexp_replace(c, r"(\S)-\s+", "$1")


def symbols(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{KEPT}]", "")


def spaced_letters(c: Column) -> Column:
    """Join single letters that stand apart."""
    return F.regexp_replace(c, r"(?<=\b\w)\s(?=\w\s)", "")


def spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s([.,;])", "$1")


def common_splits(c: Column) -> Column:
    """Repair "t h e" in any case and "a n d" in lower case."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)\b(t)\s?h\s?e\b", "$1he"), r"\ba\s?n\s?d\b", "and")


#: The steps of :func:`clean`, in order.
STEPS = {
    "whitespace": whitespace,
    "fold": fold,
    "apostrophes": apostrophes,
    "dehyphenate": dehyphenate,
    "symbols": symbols,
    "spaced_letters": spaced_letters,
    "spacing": spacing,
    "common_splits": common_splits,
    "trim": lambda c: F.trim(c),
}


#: Characters that cleaning deletes stand as this one until its step comes.
_GONE = "#"
_ASCII = dict.fromkeys([*range(9, 14), *range(28, 33)], " ") | {ord("`"): "'"}
_KEPT = set(string.ascii_letters + string.digits + "' .;,\"$/@!?&-()_")
_DELETED = dict.fromkeys(i for i in range(128) if chr(i) not in _KEPT)


class _Folds(dict):
    """Letters beyond ASCII as the steps up to :func:`apostrophes` leave them; what those keep is deleted later."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = " " if c.isspace() else "'" if re.match(APOSTROPHES, c) else _GONE
        return out


_FOLDS = _Folds({ord(a): b for a, b in [*zip(_SOURCE, _TARGET, strict=True), *WIDE.items()]})
_BEYOND = re.compile(r"[^\x00-\x7f]")
#: Letters beyond ASCII, of one text, that are replaced one after another; a text with more is passed over letter by letter.
_FEW = 32
# each begins with the letter or sign it looks for, which the search then skips to
_HYPHEN = re.compile(r"-(?<=\S-) +")
_LETTER = re.compile(r" (?=\w )(?<=\b\w )")
_THE = re.compile(r"([tT])(?!he\b)(?<=\b[tT]) ?[hH] ?[eE]\b")
_T_H, _TH_E = re.compile(r"t h(?<=\bt h)"), re.compile(r"th e(?<=\bth e)")
_AND = re.compile(r"a(?!nd\b)(?<=\ba) ?n ?d\b")


def _folded(t: str) -> str:
    found = set(_BEYOND.findall(t))
    if len(found) > _FEW:
        return _BEYOND.sub(lambda m: _FOLDS[ord(m[0])], t)
    for c in found:
        t = t.replace(c, _FOLDS[ord(c)])
    return t


def _cleaned(t: str | None) -> str:
    """All steps of one text. Behind the first one it is ASCII."""
    if not t:
        return ""
    if not t.isascii():
        t = _folded(t)
    t = t.translate(_ASCII)
    if "- " in t:
        t = _HYPHEN.sub("", t)
    t = _LETTER.sub("", t.translate(_DELETED))
    if "  " in t:
        t = re.sub(" {2,}", " ", t)
    for sign in ".,;":
        t = t.replace(f" {sign}", sign)
    # what is split, or has a capital behind its first letter, is rarer than "the" and faster to find
    low = t.lower()
    if "TH" in t or "tH" in t or "hE" in t or _T_H.search(low) or _TH_E.search(low):
        t = _THE.sub(r"\1he", t)
    return _AND.sub("and", t).strip(" ")


def _each(values: pa.Array, change: Callable[[str | None], str | None]) -> pa.Array:
    return pa.array([change(v) for v in values.to_pylist()], pa.string())


def _clean(values: pa.Array) -> pa.Array:
    return _each(values, _cleaned)


def clean(c: Column, upto: str = "trim") -> Column:
    """All cleaning steps up to and including one of them."""
    if upto not in STEPS:
        raise ValueError(f"no cleaning step is named {upto}")
    if upto == "trim":
        return _arrow(_clean)(c)
    for name, step in STEPS.items():
        c = step(c)
        if name == upto:
            break
    return c


def _arrow(change: Callable) -> Callable[[Column], Column]:
    return F.arrow_udf(change, StringType())


_SIGN = re.compile(r"(?a)([^\w\s'.-])")
_STOP = re.compile(r"\.( |\Z)")
_CANNOT = re.compile(r"(?ai)\b(can)(not)\b")
_NOT = re.compile(r"(?ai)(n't)\b")
_SHORT = re.compile(r"(?ai)('s|'m|'d|'ll|'re|'ve)\b")
_SPACES = dict.fromkeys(range(9, 14), " ")


def _pieces(t: str) -> list[str]:
    """Pieces of what stands between white space, signs and contractions cut off."""
    t = _CANNOT.sub(r"\1 \2", _STOP.sub(r" . \1", _SIGN.sub(r" \1 ", t)))
    t = _SHORT.sub(r" \1", _NOT.sub(r" \1", t))
    return [x for x in t.split(" ") if x]


def _word(t: str) -> str:
    bare = t.strip(PUNCTUATION)
    return t if bare and t[0] == "'" else bare


def _marked(t: str) -> list[str]:
    rest = t.lstrip(PUNCTUATION)
    core = rest.rstrip(PUNCTUATION)
    return [t] if not core or t[0] == "'" else [t[: len(t) - len(rest)], core, rest[len(core) :]]


class Cut(dict):
    """What stands between spaces, as what a function makes of it, once for each.

    ``quick`` makes the same of a whole ASCII text, and looks up here what it
    doesn't know how to cut: most words are met once or twice in any corpus, and
    the more there are of them, the less often one is remembered.
    """

    #: Entries kept at most, a few tens of MB.
    MOST = 200_000

    def __init__(self, cut: Callable[[str], str], quick: Callable[[str, Callable[[str], str]], Iterable[str]] | None = None):
        super().__init__()
        self.cut, self.quick = cut, quick

    def __missing__(self, t: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        self[t] = out = self.cut(t)
        return out

    def text(self, t: str | None) -> str | None:
        if t is None:
            return None
        t = t.translate(_SPACES)
        return _joined(self.quick(t, self.__getitem__) if self.quick and t.isascii() else map(self.__getitem__, t.split(" ")))

    def texts(self, values: pa.Array) -> pa.Array:
        return _each(values, self.text)


def _joined(parts: Iterable[str]) -> str:
    return " ".join(filter(None, parts))


def _plain(t: str) -> str | None:
    """The word of a piece that has no other but signs around it, an empty one where it has none; None where it takes a closer look."""
    core = t.strip(PUNCTUATION)
    plain = "'" not in t and (not core or core.isascii() and core.isalnum() and "cannot" not in core.lower())
    return core if plain else None


def _cut_words(t: str) -> list[str]:
    core = _plain(t)
    return [_word(x) for x in _pieces(t)] if core is None else [core]


def _cut_tokens(t: str) -> list[str]:
    if core := _plain(t):
        lead = t[: t.index(core)]
        tail = t[len(lead) + len(core) :]
        if len(lead) < 2 and len(tail) < 2:
            return [lead, core, tail]
    return [y for x in _pieces(t) for y in _marked(x)]


def _split_cannot(t: str) -> list[str]:
    return (_CANNOT.sub(r"\1 \2", t) if "cannot" in t.lower() else t).split(" ")


def _quick_words(t: str, found: Callable[[str], str]) -> list[str]:
    return [x if x.isalnum() else core if (core := x.strip(PUNCTUATION)).isalnum() and "'" not in x else found(x) for x in _split_cannot(t)]


def _quick_counted(t: str, found: Callable[[str], str]) -> list[str]:
    return _quick_words(t.lower(), found)


#: Signs that are a token of their own behind a word.
_ENDS = frozenset(".,;:!?")


def _quick_tokens(t: str, found: Callable[[str], str]) -> list[str]:
    return [x if x.isalnum() else f"{x[:-1]} {x[-1]}" if x[-1:] in _ENDS and x[:-1].isalnum() else found(x) for x in _split_cannot(t)]


# one of each in a worker, whatever its batches
_WORDS, _TOKENS = Cut(lambda t: _joined(_cut_words(t)), _quick_words), Cut(lambda t: _joined(_cut_tokens(t)), _quick_tokens)
_COUNTED = Cut(lambda t: _joined(x.lower().strip(PUNCTUATION) for x in _cut_words(t)), _quick_counted)


def _word_text(t: str | None) -> str | None:
    return _WORDS.text(t)


def _word_texts(values: pa.Array) -> pa.Array:
    return _WORDS.texts(values)


def _counted_texts(values: pa.Array) -> pa.Array:
    return _COUNTED.texts(values)


def _token_texts(values: pa.Array) -> pa.Array:
    return _TOKENS.texts(values)


def _tokens(c: Column, cut: Callable) -> Column:
    joined = _arrow(cut)(c)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def words(c: Column) -> Column:
    """Tokens: contractions and "cannot" cut, punctuation off the edges.

    Works on cleaned text, in which word characters are ASCII.
    """
    return _tokens(c, _word_texts)


def counted_words(c: Column) -> Column:
    """The words of a text as reports count them: :func:`counted` of :func:`words`."""
    return _tokens(c, _counted_texts)


_REPORT = pa.struct([("word", pa.string()), ("freq", pa.int64()), ("first_no", pa.int32())])


def rows_of(found: list, kind: pa.StructType, columns: Sequence[list]) -> pa.Array:
    """Lists of structs from the lengths of the lists and all their fields one after another."""
    offsets = list(accumulate(map(len, found), initial=0))
    fields = [pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


#: Texts that are counted at once, so that their words don't all stand in memory.
_AT_ONCE = 500


def by_slices(values: pa.Array, kind: pa.DataType, change: Callable[..., pa.Array], *more: pa.Array) -> pa.Array:
    """What ``change`` makes of an array, and of others beside it, a few values at a time."""
    parts = [change(*(v.slice(k, _AT_ONCE) for v in (values, *more))) for k in range(0, len(values), _AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def _reported(values: pa.Array, pick: Callable[[list[tuple[str, int]]], list[tuple[str, int]]] | None) -> pa.Array:
    """Each text's words with their counts, in the order in which they occur first, or those that ``pick`` takes in its order."""
    lists, words, freqs, firsts = [], [], [], []
    for joined in _COUNTED.texts(values).to_pylist():
        each = joined.split(" ") if joined else []
        counts = Counter(each)  # keeps the order of first occurrence
        first = dict(zip(reversed(each), range(len(each) - 1, -1, -1), strict=True))
        if pick:
            counts = dict(pick(list(counts.items())))
        lists.append(counts)
        words += counts
        freqs += counts.values()
        firsts += map(first.__getitem__, counts)
    return rows_of(lists, _REPORT, [words, freqs, firsts])


def word_counts(c: Column, pick: Callable[[list[tuple[str, int]]], list[tuple[str, int]]] | None = None) -> Column:
    """(word, freq, first_no) of each distinct one of :func:`counted_words`, counted where the text is.

    ``pick`` takes a text's (word, freq) in the order of first occurrence and gives those that stay.
    """
    return F.arrow_udf(lambda v: by_slices(v, _REPORT, lambda part: _reported(part, pick)), "array<struct<word: string, freq: bigint, first_no: int>>")(c)


def tokens(c: Column) -> Column:
    """The tokens of :func:`words`, and between them the punctuation around them."""
    return _tokens(c, _token_texts)


def token_text(c: Column) -> Column:
    """The tokens of :func:`tokens`, none of which has a space in it, joined by spaces."""
    return _arrow(_token_texts)(c)


def counted_text(c: Column) -> Column:
    """The words of :func:`counted_words` joined by spaces."""
    return _arrow(_counted_texts)(c)


def word_text(c: Column) -> Column:
    """The tokens of :func:`words` joined by spaces."""
    return _arrow(_word_texts)(c)


#: Tokens with a space before each that has a letter or digit; signs are glued.
SPACED = Cut(lambda t: f" {t}" if re.search("[A-Za-z0-9]", t) else t)


def counted(tokens: Column) -> Column:
    """Tokens as reports count them: lower case, without edge punctuation."""
    return F.filter(F.transform(tokens, lambda t: F.btrim(F.lower(t), F.lit(PUNCTUATION))), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Text cut behind ``.!?``, closing signs and white space; a rule, not a model."""
    marked = F.regexp_replace(c, r"([.!?]+[\"')]*)\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


_SENTENCE = pa.struct([("word_count", pa.int32()), ("sentence", pa.string())])
_END = re.compile(r"(?a)([.!?]+[\"')]*)\s+")


def _sentences_counted(values: pa.Array) -> pa.Array:
    lists, flat = [], []
    for t in values.to_pylist():
        lists.append([s for s in _END.sub("\\1\x01", t or "").split("\x01") if s.strip(" ")])
        flat += lists[-1]
    joined = _WORDS.texts(pa.array(flat, pa.string())).to_pylist()
    return rows_of(lists, _SENTENCE, [[x.count(" ") + 1 if x else 0 for x in joined], flat])


def counted_sentences(c: Column) -> Column:
    """(word_count, sentence) of each of :func:`sentences`, cut and counted in one pass."""
    return F.arrow_udf(lambda v: by_slices(v, _SENTENCE, _sentences_counted), "array<struct<word_count: int, sentence: string>>")(c)


#: Rows of words in a batch that goes back to Spark, at most.
_ROWS_AT_ONCE = 50_000
_BESIDE = pa.struct([("text", pa.string()), ("raw", pa.string())])


def _sentence_text(t: str | None) -> str:
    return "\x01".join(s for s in _END.sub("\\1\x01", t or "").split("\x01") if s.strip(" "))


def _beside(cut: Callable[[str | None], str | None], sign: str) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def lists(joined: list[str | None]) -> tuple[np.ndarray, pa.Array]:
        found = pc.split_pattern(pa.array([x or None for x in joined], pa.string()), sign)
        return found.value_lengths().fill_null(0).to_numpy(), found.flatten()

    def change(texts: pa.Array, raws: pa.Array) -> pa.Array:
        both = list(zip(texts.to_pylist(), raws.to_pylist(), strict=True))
        joined = [cut(t) for t, _ in both]
        n, units = lists(joined)
        m, raw = lists([x if t == r else cut(r) for x, (t, r) in zip(joined, both, strict=True)])
        ends = np.cumsum(n)
        at = np.arange(len(units)) - np.repeat(ends - n, n)
        raw = raw.take(pa.array(at + np.repeat(np.cumsum(m) - m, n), mask=at >= np.repeat(m, n)))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([units, raw], fields=list(_BESIDE)))

    return change


def word_batches(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (file, page, text, raw text) as rows of words: file, page, number, length, word, and the raw text's word of the same number or null.

    For mapInArrow: words become rows where they are cut, and stand in no list of Spark's.
    """
    change = _beside(_word_text, " ")
    for batch in batches:
        for k in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(k, _AT_ONCE)
            units = change(part.column(2), part.column(3))
            n = units.value_lengths().to_numpy()
            of = pa.array(np.repeat(np.arange(len(n)), n))
            number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 1
            word, raw = units.flatten().flatten()
            rows = pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(number.astype(np.int32)), pc.utf8_length(word), word, raw], names=list(names))
            for at in range(0, rows.num_rows, _ROWS_AT_ONCE):
                yield rows.slice(at, _ROWS_AT_ONCE)


def sentences_beside(c: Column, raw: Column) -> Column:
    """(text, raw) of each of :func:`sentences` of a text, and that of the raw text at its place, null where it has fewer; cut where the texts are."""
    return F.arrow_udf(lambda v, w: by_slices(v, _BESIDE, _beside(_sentence_text, "\x01"), w), "array<struct<text: string, raw: string>>")(c, raw)


def natural_key(c: Column) -> Column:
    """A sort key under which file2 comes before file10."""
    return F.regexp_replace(F.regexp_replace(c, r"(\d+)", "00000000000000000000$1"), r"\d*(\d{20})", "$1")
