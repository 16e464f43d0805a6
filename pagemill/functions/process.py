"""Text processing steps on cleaned text, as Column functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def strip_punctuation(c: Column) -> Column:
    """Tokens joined by a space, without punctuation but apostrophes and hyphens."""
    return F.regexp_replace(F.array_join(text.words(c), " "), r"[^\w\s'-]|_", "")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "")


def drop_numeric_words(c: Column) -> Column:
    return F.array_join(F.filter(text.words(c), lambda w: ~w.rlike(r"\d")), " ")


def _escaped(p: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", p)


def _pattern(p: str, regex: bool) -> str:
    return rf"(?i)\b{p if regex else _escaped(p)}\b"


def _overlap(a: list[str], b: list[str]) -> bool:
    """Whether matches of two phrases, as words and the signs between, can share a word of a text."""
    for shift in range(1 - len(b), len(a)):
        places = range(max(0, shift), min(len(a), shift + len(b)))
        if all(a[i] == b[i - shift] for i in places) and any(re.match(r"\w", a[i]) for i in places):
            return True
    return False


def passes(patterns: Sequence[str]) -> list[list[str]]:
    """Literal patterns by the pass over a text in which they can be looked for.

    Patterns of one pass never match at places that overlap, and no deletion
    makes a match of another one, so they can be taken all at once; a pattern
    goes behind earlier ones that it can overlap with. Matches begin and end at
    word boundaries, so two of them share whole words or nothing; and behind a
    deleted word two signs at least stand where it stood, so a phrase whose
    words have one sign between them cannot come into being. Patterns of another
    kind (with an outer sign, or several between words) are alone in a pass, and
    nothing moves across them.
    """
    out: list[list[str]] = []
    placed: list[tuple[list[str], int]] = []
    by_word: dict[str, list[int]] = {}
    least = 0
    for p in patterns:
        parts = re.findall(r"\w+|\W+", p.lower())
        if not re.fullmatch(r"(?a:\w+)(?:[\x00-\x7f](?a:\w+))*", p):  # the last pass and alone in it
            out.append([p])
            least = len(out)
            continue
        rivals = {k for w in parts for k in by_word.get(w, ())}
        at = max([least, *(placed[k][1] + 1 for k in rivals if _overlap(placed[k][0], parts) and placed[k][0] != parts)])
        if at == len(out):
            out.append([])
        out[at].append(p)
        for w in {x for x in parts if x[0].isalnum() or x[0] == "_"}:
            by_word.setdefault(w, []).append(len(placed))
        placed.append((parts, at))
    return out


def automaton(patterns: Sequence[str]) -> str:
    """One regular expression for literal patterns: their trie, between word boundaries.

    At each word the expression goes down the trie letter by letter, so a text
    is read once however many patterns there are.
    """
    root: dict = {}
    for p in patterns:
        at = root
        for c in p.lower():
            at = at.setdefault(c, {})
        at[""] = {}

    def below(node: dict) -> str:
        ways = [_escaped(c) + below(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return joined + ("?" if "" in node else "")

    return rf"(?i)\b{below(root)}\b"


def only(c: Column, patterns: Sequence[str], regex: bool = False) -> Column:
    """The matches of each pattern in turn, in the order of the patterns.

    Without patterns every word matches. Patterns are literal phrases unless
    ``regex`` is set; they must then have no capturing groups. Literal patterns
    are found in few passes (:func:`passes`) and then put in order.
    """
    if not patterns:
        return F.array_join(F.regexp_extract_all(c, F.lit(r"\b\w+\b"), F.lit(0)), " ")
    if regex:
        return F.array_join(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(_pattern(p, True)), F.lit(0)) for p in patterns))), " ")
    listed = [p.lower() for p in patterns]
    if len(patterns) < 4 or len(set(listed)) < len(listed) or any(not p.isascii() for p in listed):
        found = [F.regexp_extract_all(c, F.lit(_pattern(p, False)), F.lit(0)) for p in patterns]
        return F.array_join(F.flatten(F.array(*found)), " ")
    order = F.array(*map(F.lit, listed))
    found = [F.regexp_extract_all(c, F.lit(automaton(some)), F.lit(0)) for some in passes(patterns)]
    placed = [F.transform(x, lambda m, i: F.struct(F.array_position(order, F.lower(m)).alias("p"), i.alias("i"), m.alias("m"))) for x in found]
    return F.array_join(F.transform(F.array_sort(F.flatten(F.array(*placed))), lambda x: x["m"]), " ")


def ignore(c: Column, patterns: Sequence[str], regex: bool = False) -> Column:
    """Delete each pattern in turn, then close the gaps.

    Literal patterns are deleted in as few passes as give the same result as
    one pass for each (:func:`passes`), four for a usual list of stop words.
    """
    for p in ([_pattern(p, True) for p in patterns] if regex else map(automaton, passes(patterns))):
        c = F.regexp_replace(c, p, "")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def like_case(word: Column, model: Column) -> Column:
    """``word`` in upper or title case where ``model`` is."""
    letters = model.rlike("[A-Za-z]")
    return F.when(letters & (model == F.upper(model)), F.upper(word)).when(letters & (model == F.initcap(model)), F.initcap(word)).otherwise(word)
