"""Packing by power-of-two decomposition.

Each document's ids are cut into whole pieces of the greatest length and the binary digits of the rest, largest first. Every
piece is a sequence of its own and its length is its bucket, so no sequence crosses documents and none is padded. Training
takes a batch from one bucket at a time; `write_buckets` lays the buckets out as folders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.memo import Memo
from docledger.llm.words import WHITE, slices, spread, words
from docledger.session import bound_batches

TAIL = np.zeros(256, bool)
TAIL[[ord(c) for c in ".,;:!?"]] = True
#: One letter run, not changed by composition: ASCII and the Latin letters up to U+00FF.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Ids and, by its bits, places that an encoder remembers, some 12 MB in all: every Python worker of an executor has its own.
POOL, MEMO_BITS = 1 << 20, 18


class _Encoder:
    """Ids of words, from a bounded pool. A word of plain letters goes to the merge model at once; any other through the whole
    tokenizer. The tokenizer drops white space and no pre-token holds any, so words are independent of each other; a run of
    punctuation after a letter is a pre-token of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
        self.memo, self.pool, self.used = Memo(MEMO_BITS), np.zeros(POOL, np.uint32), 0

    def ids(self, word: str) -> list[int]:
        if LETTERS.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and how many each has."""
        value, missed = self.memo.find(w.hash)
        if len(missed):
            new, where, back = np.unique(w.hash[missed], return_index=True, return_inverse=True)
            pick = missed[where]
            got = [self.ids(bytes(w.data[s:e]).decode()) for s, e in zip(w.start[pick], w.end[pick], strict=True)]
            count = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(count.sum()))
            if self.used + len(flat) > len(self.pool):
                self.memo.clear()
                self.used = 0
                if len(flat) > len(self.pool):
                    self.pool = np.zeros(len(flat), np.uint32)
                elif len(missed) < len(w.hash):
                    return self.encode(w)
            self.pool[self.used : self.used + len(flat)] = flat
            entry = (self.used + np.cumsum(count) - count) << 24 | count
            self.used += len(flat)
            fits = count < 1 << 24
            self.memo.put(new[fits], entry[fits])
            value[missed] = entry[back]
        first, count = value >> 24, value & ((1 << 24) - 1)
        return self.pool[spread(first, count)], count


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_ids(path: str, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, each closed by end_id, and how many each has."""
    w = words(column, WHITE, tail=TAIL)
    flat, count = _encoder(path).encode(w)
    total = np.concatenate([[0], np.cumsum(count)])
    own = total[w.first[1:]] - total[w.first[:-1]]
    size = own + 1
    ends = np.cumsum(size)
    out = np.empty(int(size.sum()), np.uint32)
    out[spread(ends - size, own)] = flat
    out[ends - 1] = end_id
    return out, size


def binary_lengths(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' lengths, text by text, and how many each text has."""
    full, rest = size // most, size % most
    digits = rest[:, None] & (1 << np.arange(most.bit_length() - 2, -1, -1))
    few = (digits > 0).sum(1)
    pieces = full + few
    length = np.full(int(pieces.sum()), most, np.int64)
    length[spread(np.cumsum(pieces) - few, few)] = digits[digits > 0]
    return length, pieces


def pack(docs: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids are little-endian unsigned 32-bit.

    A null or empty text is the closing id alone. Repeated rows are packed each on its own; null keys stay; other columns are
    not read. `most` has to be a power of two. There is no shuffle: a piece is a sequence, numbered by partition and row, so a
    task that runs again gives the same numbers.
    """
    if most < 2 or most & (most - 1):
        raise ValueError("most has to be a power of two")
    bound_batches(docs.sparkSession)
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                ids, size = token_ids(tokenizer_path, part.column(1), end_id)
                length, pieces = binary_lengths(size, most)
                of = np.repeat(np.arange(len(size)), pieces)
                ends = np.cumsum(length)
                start = ends - length - np.repeat(np.cumsum(size) - size, pieces)
                places = np.concatenate([[0], ends * 4]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(places), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(start), pa.array(length), blob, pa.array(size[of])], ["key", "start", "length", "ids", "doc_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long")
    return out.select(F.col("key").alias(key), "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, for trainers that draw each batch from one bucket."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
