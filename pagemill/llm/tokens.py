"""Token ids of a corpus in shards, each a wavelet matrix."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import grams, store, wavelet
from .bpe import SPACE
from .store import worker_cache, worker_task


@dataclass(frozen=True)
class Shards:
    """A shard is closed at the first document with which it has ``shard_tokens``.

    ``part_chars`` is the bytes of text that one writing task gets, until
    there are ``most_parts`` of them. ``end_id`` is put
    behind every document. ``memo`` bounds the words that a worker
    keeps, ``batch_bytes`` the text that is cut into words at once.
    """

    end_id: int = 2
    shard_tokens: int = 1 << 21
    part_chars: int = 24 << 20
    most_parts: int = 20_000
    memo: int = 1_800_000
    batch_bytes: int = 6 << 20


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct word once.

    For vocabularies whose normaliser and pre-tokeniser treat white space as a
    separator that leaves nothing behind, a text's ids are those of its words.
    """

    def __init__(self, vocabulary: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.word = re.compile(f"[^{SPACE}]+")
        self.most, self.memo = memo, {}
        held = self.library.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if len(held) <= 1 << 16 else "<u4"
        model = json.loads(vocabulary)
        suffix = model["model"].get("end_of_word_suffix")
        self.special = [x["content"] for x in model["added_tokens"]]
        # where one text of many words can be cut again: behind every pre-token's last id
        self.ends = np.zeros(max(held.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for t, i in held.items() if t.endswith(suffix)]] = True
            parts = [x["pattern"]["Regex"] for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
            self.piece = regex.compile(parts[0])
            self.plain = Tokenizer.from_str(vocabulary)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        else:
            self.plain = None

    def _n_pieces(self, word: str) -> int:
        if word.isascii() and word.isalpha():
            return 1
        folded = unicodedata.normalize("NFC", word).lower()
        return 1 if folded.isalpha() else len(self.piece.findall(folded))

    def _add(self, words: list[str], plain) -> None:
        """Encode new words, many as one text where their ids can be told apart.

        ``plain`` is the library without normaliser and pattern, for words that
        are lower-case letters alone and so one pre-token each.
        """
        if self.ends is not None and words:
            ids = np.array((plain or self.library).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
            stop = np.flatnonzero(self.ends[ids]) + 1
            upto = np.arange(1, len(words) + 1) if plain else np.cumsum([self._n_pieces(w) for w in words])
            if upto[-1] == len(stop) and (not len(stop) or stop[-1] == len(ids)):
                at = (np.concatenate([[0], stop])[np.concatenate([[0], upto])] * ids.itemsize).tolist()
                raw = ids.tobytes()
                self.memo.update(zip(words, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))
                return
        for word, got in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.memo[word] = np.array(got.ids, self.kind).tobytes()

    def _words(self, text: str) -> list[str]:
        # str.split differs from the pattern by four control characters only
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return self.word.findall(text) if odd else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(t) for t in texts]
        if len(self.memo) > self.most:  # what this batch has is likely to come again
            self.memo = {w: self.memo[w] for w in set().union(*cut) & self.memo.keys()}
        get = self.memo.get
        held = [list(map(get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(h) if x is None] if None in h else [] for h in held]
        new = {c[i] for c, g in zip(cut, gaps, strict=True) for i in g}
        if new:
            self._learn(new, texts)
        for c, h, g in zip(cut, held, gaps, strict=True):
            for i in g:
                h[i] = self.memo[c[i]]
        return [b"".join(h) for h in held]

    def _learn(self, new: set[str], texts: list[str]) -> None:
        """Put words that occur in some texts into the memo.

        Letters with ASCII punctuation behind are cut in between, as the
        pre-tokeniser does, so that a word is encoded once for all its endings
        and cases.
        """
        hidden = [s for s in self.special if any(s in t for t in texts)]
        odd = {w for w in new if any(s in w for s in hidden)} if hidden else set()
        joined: list[tuple[str, str, str]] = []
        letters, other = set(), set()
        for word in new - odd if odd else new:
            core = word.rstrip(string.punctuation)
            low = core.lower()
            if low.isalpha() and core.isalpha() and (core.isascii() or "\u03a3" not in core and unicodedata.is_normalized("NFC", core)):
                letters.add(low)
                if low != word:
                    rest = word[len(core) :]
                    if rest:
                        other.add(rest)
                    joined.append((word, low, rest))
            else:
                other.add(word)
        memo = self.memo
        many = [w for w in letters if w not in memo]
        for k in range(0, len(many), 2000):
            self._add(many[k : k + 2000], self.plain)
        many = [w for w in other if w not in memo]
        for k in range(0, len(many), 2000):
            self._add(many[k : k + 2000], None)
        memo[""] = b""
        for word, low, rest in joined:
            memo[word] = memo[low] + memo[rest]
        for word in odd:
            memo[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, self.kind).tobytes()


def write(documents: DataFrame, vocabulary_path: str, p: Shards = Shards()) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order.

    One row (part, file, n_docs, n_tokens, content) for each shard; shards
    follow each other by (part, file). Null texts are empty and have the end id
    alone. Null ids come first; documents that share an id stand together, in
    any order. Texts move once, to the part of their id's range. The range
    limits come from the ids alone, read before any text.
    """
    spark = documents.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    size = documents.agg(F.sum(F.octet_length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    n_parts = int(max(1, min((size.chars or 0) // p.part_chars + 1, size.n, p.most_parts)))
    limits: list[int] = []
    if n_parts > 1:
        wanted = [i / n_parts for i in range(1, n_parts)]
        limits = sorted(set(documents.approxQuantile("doc_id", wanted, 0.1 / n_parts)))
    held = spark.sparkContext.broadcast((vocabulary, np.array(limits, np.int64)))

    @worker_task("tokens")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, limits = held.value
        key = hashlib.sha1(vocabulary.encode()).hexdigest()
        encoder = worker_cache(("words", key), lambda: WordEncoder(vocabulary, p.memo))
        end = np.array([p.end_id], encoder.kind).tobytes()
        gc.disable()  # words and ids make no cycles, and there are millions of them
        for batch in batches:
            texts = batch.column(1).fill_null("")
            ids = batch.column(0).cast(pa.int64())
            part = np.where(np.asarray(ids.is_valid()), np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"), 0)
            for i, j, _ in grams.slices(texts, p.batch_bytes):
                got = [x + end for x in encoder.encode(texts[i:j].to_pylist())]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(part[i:j], pa.int32()), pa.array(got, pa.binary())], names=["doc_id", "part", "ids"])

    @worker_task("tokens")
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        vocabulary, _ = held.value
        n_vocabulary = worker_cache(("size", hashlib.sha1(vocabulary.encode()).hexdigest()), lambda: Tokenizer.from_str(vocabulary).get_vocab_size())
        n_bits = max(1, (max(n_vocabulary, p.end_id + 1) - 1).bit_length())
        width = 2 if n_vocabulary <= 1 << 16 else 4
        ids, doc_ids, size, part, n_file = [], [], 0, None, 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(x) // width for x in ids], np.int64)
            known = np.array([x is not None for x in doc_ids], np.uint8)
            extra = {"doc_id": np.array([x or 0 for x in doc_ids], np.int64), "known": known, "length": lengths}
            content = wavelet.build(np.frombuffer(b"".join(ids), f"<u{width}"), n_bits, extra)
            row = [[part], [n_file], [len(ids)], [int(lengths.sum())], [content]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "file", "n_docs", "n_tokens", "content"])

        for batch in batches:
            for doc_id, here, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (here != part or size >= p.shard_tokens * width):
                    yield closed()
                    n_file = 0 if here != part else n_file + 1
                    ids, doc_ids, size = [], [], 0
                part = here
                ids.append(x)
                doc_ids.append(doc_id)
                size += len(x)
        if ids:
            yield closed()

    rows = documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, ids binary")
    rows = rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"))
    return rows.mapInArrow(shard, "part int, file int, n_docs long, n_tokens long, content binary")


def located(files: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all shards before each shard.

    Sums run within a part first; over parts, of which there are few, only
    their totals are summed in one place.
    """
    narrow = files.select("part", "file", "n_tokens")
    parts = narrow.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("__part"), before.alias("__before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = narrow.withColumn("__inside", inside).join(parts, F.col("part") == F.col("__part"))
    starts = starts.select(F.col("part").alias("__p"), F.col("file").alias("__f"), (F.col("__before") + F.col("__inside")).alias("start"))
    return files.join(starts, (F.col("part") == F.col("__p")) & (F.col("file") == F.col("__f"))).drop("__p", "__f")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards.

    All planes are decoded; some places are also read through the directory,
    by access and select. A file that is damaged raises.
    """

    @worker_task("tokens")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = wavelet.WaveletMatrix(content.as_py())
                ids = matrix.decode().astype("<u4")
                length = matrix.extra("length")
                cut = np.concatenate([[0], np.cumsum(length)])
                last = cut[1:][:: max(1, len(length) // 64)] - 1
                if (matrix.access(last) != ids[last]).any() or matrix.select(int(ids[0]), 0) != 0:
                    raise ValueError("a shard's directory and planes disagree")
                crc = [zlib.crc32(ids[i:j].data) for i, j in zip(cut, cut[1:], strict=False)]
                doc = pa.array(matrix.extra("doc_id"), pa.int64(), mask=matrix.extra("known") == 0)
                yield pa.RecordBatch.from_arrays([doc, pa.array(start + cut[:-1]), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return located(files).select("start", "content").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, vocabulary_path: str, p: Shards = Shards()) -> DataFrame:
    """Write the shards to the shared folder, then read every document from them."""
    return read(store.written(write(documents, vocabulary_path, p), "shards", "uncompressed"))
