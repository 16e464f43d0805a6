"""Byte-level BPE encoding and decoding through a transducer lexicon.

A text is cut into chunks, each a run of white space with the run of other
characters behind it. The pre-tokens of byte-level BPE never cross from a
non-space to a space, so chunks are encoded apart and their ids joined. The
chunks that are most frequent in the corpus are compiled, with their ids, into
a minimal acyclic transducer that every worker maps into memory; any other
chunk is merged exactly, by rank.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import string
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, lexicon
from .store import give_back, quoted, worker_cache, worker_task, written

#: White space as Unicode's property has it; Python's own \s differs by U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The published pre-token pattern of byte-level BPE.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Lexical:
    """``lexicon_words`` most frequent chunks are compiled.

    ``longest`` bounds the characters of such a chunk, ``memo`` the encoded
    chunks that a worker keeps.
    """

    lexicon_words: int = 40_000
    longest: int = 40
    memo: int = 1_100_000


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's strings.

    Printable bytes stand for themselves; the others are numbered from U+0100.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space that may stand beside a space.
BESIDE = [c + " " for c in "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def pieces(text: str) -> list[str] | None:
    """The text split at spaces, or None where white space stands before a space."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or any(b in text for b in BESIDE):
        return None
    return text.split(" ")


class Bpe:
    """Exact merges of one vocabulary file in the tokenizers library's format."""

    def __init__(self, vocabulary: str):
        held = json.loads(vocabulary)
        byte = byte_names()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.id = {raw(s): i for s, i in held["model"]["vocab"].items() if s not in self.special}
        #: For each pair of ids, packed as (left << 20 | right): rank << 20 | merged id.
        self.rank: dict[int, int] = {}
        for i, pair in enumerate(held["model"]["merges"]):
            x, y = (raw(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[self.id[x] << 20 | self.id[y]] = i << 20 | self.id[x + y]
        self.base = [self.id.get(bytes([b]), -1) for b in range(256)]
        #: Tokens that their own merges lead to; a piece that is one needs no merging.
        self.whole = {t: i for t, i in self.id.items() if self.merge(t) == [i]}
        self.piece = regex.compile(PIECE, regex.V0)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = [b""] * (1 + max([*self.id.values(), *self.special.values()]))
        for token, i in self.id.items():
            self.text[i] = token
        for token, i in self.special.items():
            self.text[i] = token.encode()

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank merges first, from the left."""
        if len(piece) > 64:
            return self._merge_long(piece)
        none, get = 1 << 60, self.rank.get
        ids = list(map(self.base.__getitem__, piece))
        ranks = [get(x << 20 | y, none) for x, y in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in O(n log n), with a heap of pairs over a linked list."""
        n, get = len(piece), self.rank.get
        ids = [self.base[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of any text; strings of special tokens become their ids."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                letters = part.isalpha() or part[:1] == " " and part[1:].isalpha()
                for piece in [part] if letters else self.piece.findall(part):
                    raw = piece.encode()
                    if (whole := self.whole.get(raw)) is None:
                        out += self.merge(raw)
                    else:
                        out.append(whole)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


def frequent(documents: DataFrame, p: Lexical, text: str = "text") -> list[str]:
    """The most frequent chunks that begin with a space, without it.

    Ties go by the chunk itself.

    Tasks count their own rows first, so that a chunk makes one row for each
    a quarter of ``memo`` distinct chunks of a task. A table of how many chunks occur how
    often, which has few rows, tells the least count that is needed; the driver
    gets the chunks above it, and of those at it as many as are missing.
    """

    @worker_task("bpe")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = [(c, n) for c, n in seen.items() if 0 < len(c) <= p.longest and CHUNK.fullmatch(c)]
            for k in range(0, len(rows), 50_000):
                chunk, n = zip(*rows[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.string()), pa.array(n, pa.int64())], names=["chunk", "n"])
            seen.clear()

        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    one = value.as_py()
                    parts = pieces(one)
                    seen.update([c[1:] for c in CHUNK.findall(one) if c[0] == " "] if parts is None else parts[1:])
                    if len(seen) > p.memo // 4:
                        yield from flushed()
        yield from flushed()

    counted = documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(task, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = written(counted, "chunks")
    left = p.lexicon_words
    for row in counted.groupBy("n").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("n")).collect():
        if row.chunks >= left:
            top = [r.chunk for r in counted.where(F.col("n") > row.n).orderBy(F.desc("n"), "chunk").collect()]
            return top + [r.chunk for r in counted.where(F.col("n") == row.n).orderBy("chunk").limit(left).collect()]
        left -= row.chunks
    return [r.chunk for r in counted.orderBy(F.desc("n"), "chunk").collect()]


def opened(content: bytes) -> lexicon.Lexicon:
    """A lexicon mapped from a file in this worker's temporary folder.

    The file has no name any more once it is mapped, so nothing stays behind.
    """
    with tempfile.NamedTemporaryFile(prefix="lexicon-") as file:
        file.write(content)
        file.flush()
        return lexicon.Lexicon(file.name)


class Encoder:
    """Encodes many texts: lexicon first, exact merges for the rest.

    A text is split at spaces; each piece stands for itself behind a space.
    That is a cut between chunks, but for white space on both sides of a space,
    where the run is one chunk; texts that have it are cut by the pattern.
    """

    def __init__(self, bpe: Bpe, words: lexicon.Lexicon, memo: int):
        self.bpe, self.words, self.most = bpe, words, memo
        self.memo: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}

    def _first(self, piece: str) -> bytes:
        """The ids of a text's first piece, which has no space before it."""
        if (ids := self.starts.get(piece)) is None:
            if len(self.starts) > self.most // 10:
                self.starts.clear()
            ids = self.starts[piece] = b"".join(map(self._ids, CHUNK.findall(piece)))
        return ids

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text), "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Put pieces, without their space, into the memo.

        A piece the lexicon does not have is encoded exactly; letters with ASCII
        punctuation behind are cut in between, as pre-tokens are.
        """
        memo, whole, merge = self.memo, self.bpe.whole, self.bpe.merge
        rests: dict[str, bytes] = {"": b""}
        for piece, ids in zip(new, self.words.lookup([(" " + c).encode() for c in new]), strict=True):
            if ids is None:
                core = piece.rstrip(string.punctuation)
                if core.isalpha():
                    if (ids := memo.get(core)) is None:
                        raw = b" " + core.encode()
                        one = whole.get(raw)
                        ids = array("I", merge(raw) if one is None else (one,)).tobytes()
                        memo[core] = ids
                    if core is not piece:
                        rest = piece[len(core) :]
                        if rest not in rests:
                            rests[rest] = self._ids(rest)
                        ids += rests[rest]
                else:
                    ids = b"".join(map(self._ids, CHUNK.findall(" " + piece)))
            memo[piece] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        whole = [pieces(t) for t in texts]
        if len(self.memo) > self.most:  # what this batch has is likely to come again
            seen = set().union(*(w for w in whole if w))
            self.memo = {c: self.memo[c] for c in seen & self.memo.keys()}
        get = self.memo.get
        held = [list(map(get, w[1:])) if w else [] for w in whole]
        gaps = [[i for i, x in enumerate(h) if x is None] if None in h else [] for h in held]
        new = {w[i + 1] for w, g in zip(whole, gaps, strict=True) for i in g}
        if new:
            self._learn(list(new))
        out = []
        for text, w, h, g in zip(texts, whole, held, gaps, strict=True):
            if w is None:
                out.append(b"".join(map(self._ids, CHUNK.findall(text))))
                continue
            for i in g:
                h[i] = self.memo[w[i + 1]]
            out.append(b"".join([self._first(w[0]), *h]))
        return out


def encoded(documents: DataFrame, vocabulary_path: str, p: Lexical = Lexical(), text: str = "text", digest: bool = False, compare: bool = False) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (binary) and ``decoded`` to the columns of ``documents``.

    With ``digest``, ``ids_sha256`` and ``decoded_sha256`` stand for the last
    two and for ``text``, so that neither leaves the worker. With ``compare``,
    ``round_trip``, whether decoding gives the text back, stands for ``decoded``
    and ``text``: a text enters the worker once and no text leaves it.
    Whole texts are encoded and decoded; null is the empty text and has no ids.
    Texts of any length are worked on one at a time; rows that repeat an id each
    give a row. Input columns of these names are replaced, others stay, whatever
    their names. The vocabulary and
    the lexicon, both of bounded size, are broadcast.
    """
    spark = documents.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    own_bpe = Bpe(vocabulary)
    content = lexicon.build(((" " + c).encode(), own_bpe.encode(" " + c)) for c in frequent(documents, p, text))
    del own_bpe
    give_back()
    held = spark.sparkContext.broadcast((vocabulary, content))
    names = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "round_trip" if compare else "decoded"])]
    own = {f"__own{i}": c for i, c in enumerate(documents.columns) if c not in names and not ((digest or compare) and c == text)}  # safe names for tasks

    @worker_task("bpe")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, content = held.value
        key = hashlib.sha1(vocabulary.encode() + content).hexdigest()
        bpe = worker_cache(("bpe", key), lambda: Bpe(vocabulary))
        encoder = worker_cache(("encoder", key), lambda: Encoder(bpe, opened(content), p.memo))
        gc.disable()  # words and ids make no cycles, and there are millions of them
        for batch in batches:
            texts = batch.column("__text").fill_null("")
            for i, j, _ in grams.slices(texts, 3 << 20):
                own_texts = texts[i:j].to_pylist()
                ids = encoder.encode(own_texts)
                back = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                new = [pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digest:
                    new.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                    new.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()))
                else:
                    new += [pa.array(ids, pa.binary()), pa.array([x == y for x, y in zip(own_texts, back, strict=True)], pa.bool_()) if compare else pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in own), *new], names=[*own, *names])

    added = ["n_tokens long", *(["ids_sha256 string", "decoded_sha256 string"] if digest else ["ids binary", "round_trip boolean" if compare else "decoded string"])]
    schema = ", ".join([*(f"{k} {documents.schema[c].dataType.simpleString()}" for k, c in own.items()), *added])
    given = documents.select(*(F.col(quoted(c)).alias(k) for k, c in own.items()), F.col(f"`{text}`").alias("__text"))
    return given.mapInArrow(task, schema).select(*(F.col(k).alias(c) for k, c in own.items()), *names)


def digests(documents: DataFrame, vocabulary_path: str, p: Lexical = Lexical()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encoded(documents.select("doc_id", "text"), vocabulary_path, p, digest=True)
