"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they stand in it. For each of `samples` hash functions every term has fixed
random numbers r, c ~ Gamma(2, 1) and b ~ U(0, 1); a term of weight w has t = floor(ln w / r + b) and the value
ln c - r (t - b + 1), and the sample is the term and t of the least value. Two texts draw the same sample with probability equal
to the generalised Jaccard similarity of their weights, sum of minima over sum of maxima. The value stands for the sample, as
it depends on hash function, term and t alone; 16 mixed bits of it are kept. A term is its full 64-bit hash, from which its
numbers follow; a table of fixed size only keeps those of words that come often, so that they are not worked out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.words import mix, slices, words

SAMPLES = 128
PLACES = 1 << 16
ROWS = 1 << 14
BLOCK = 256
STEP = np.uint64(0x9E3779B97F4A7C15)


def _numbers(h: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, b, ln c, and the values of weight one, by term and hash function, from the terms' hashes."""
    out = tuple(np.empty((len(h), samples), np.float32) for _ in range(4))
    step = np.arange(samples, dtype=np.uint64) * np.uint64(3)
    for a in range(0, len(h), BLOCK):
        rows = slice(a, a + BLOCK)
        r, b, c, ones = (x[rows] for x in out)
        for i, to in ((1, r), (2, c)):
            bits = mix(h[rows, None] + (step + np.uint64(i)) * STEP)
            pair = (bits >> np.uint64(32)).astype(np.float64) + 0.5
            pair *= (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
            pair *= 2.0**-64
            np.negative(np.log(pair, out=pair), out=pair)
            to[:] = pair if i == 1 else np.log(pair, out=pair)
        b[:] = (mix(h[rows, None] + (step + np.uint64(3)) * STEP) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        ones[:] = c - r * (np.float32(1) - b)
    return out


class Kept:
    """Numbers of words that came before: one word to a place. A word that finds its place taken is worked out; it takes the
    place if the other has not been asked for since the last that wanted it."""

    def __init__(self, samples: int):
        self.samples = samples
        self.word, self.used = np.zeros(PLACES, np.uint64), np.zeros(PLACES, bool)
        self.known = np.zeros(PLACES, bool)
        self.numbers = tuple(np.empty((PLACES, samples), np.float32) for _ in range(4))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Places of the hashes; and for those that have none (-1 there), which of the new numbers is theirs, and these."""
        at = (h >> np.uint64(48)).astype(np.int64)
        hit = self.known[at] & (self.word[at] == h)
        new, own = np.unique(h[~hit], return_inverse=True)
        numbers = _numbers(new, self.samples)
        self.used[at[hit]] = True
        which = np.full(len(h), -1, np.int64)
        which[~hit] = own
        return np.where(hit, at, -1), which, (new, numbers)

    def put(self, new: np.ndarray, numbers: tuple[np.ndarray, ...]) -> None:
        at = (new >> np.uint64(48)).astype(np.int64)
        at, first = np.unique(at, return_index=True)
        free = ~self.used[at]
        self.used[at] = False
        at, first = at[free], first[free]
        self.word[at], self.known[at] = new[first], True
        for to, x in zip(self.numbers, numbers, strict=True):
            to[at] = x[first]


@cache
def _kept(samples: int) -> Kept:
    return Kept(samples)


def _values(kept: Kept, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of terms with these hashes and weights, by term and hash function."""
    at, own, (new, numbers) = kept.find(h)
    value = np.empty((len(h), kept.samples), np.float32)
    for rows, (r, b, c, ones), place in ((np.flatnonzero(at >= 0), kept.numbers, at), (np.flatnonzero(own >= 0), numbers, own)):
        value[rows] = ones[place[rows]]
        many = rows[n[rows] > 1]
        q = place[many]
        t = np.floor(np.log(n[many]).astype(np.float32)[:, None] / r[q] + b[q])
        value[many] = c[q] - r[q] * (t - b[q] + np.float32(1))
    kept.put(new, numbers)
    return value


def signatures(column: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples per text; all zero when it has no words."""
    kept = _kept(samples)
    w = words(column)
    texts = len(column)
    out = np.zeros((texts, samples), np.uint16)
    if not len(w.hash):
        return out
    distinct, number = np.unique(w.hash, return_inverse=True)
    joint = np.sort(w.text_of_word() * len(distinct) + number)
    new = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
    weight = np.diff(np.concatenate([new, [len(joint)]]))
    doc, term = joint[new] // len(distinct), joint[new] % len(distinct)
    least = np.full((texts, samples), np.inf, np.float32)
    for a in range(0, len(doc), ROWS):
        d = doc[a : a + ROWS]
        value = _values(kept, distinct[term[a : a + ROWS]], weight[a : a + ROWS])
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        own = d[heads]
        least[own] = np.minimum(least[own], np.minimum.reduceat(value, heads, axis=0))
    drawn = np.unique(doc)
    out[drawn] = (mix(least[drawn].view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision rate, row by row; two texts without words are alike, one without and one with words are not."""
    none_a, none_b = ~a.any(1), ~b.any(1)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), (a == b).mean(1))


def hexed(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows]


def fingerprints(docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row. Null and empty texts, and texts of white space, have a fingerprint of zeros."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hexed(signatures(part.column(1), samples)), pa.string())], ["key", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next by key, after the last the first; the edited text has the last half of its code points
    replaced by as many first ones of the next document. Rows with one key are ordered by a hash of their text. Null texts are
    empty. A row without a key has no next document: its edited text is its first half, its near_next null. Other columns are
    not read.

    The keys are cut into ranges of about equal counts. Each range is one stream of rows in order; the first document of a
    range also travels to the range before it. Texts move once, compressed.
    """
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("key").filter(F.col("key").isNotNull()).repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("cut"))
    cuts = sorted(r["cut"] for r in found.collect())  # one key per range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        edges = np.array(cuts)
        for batch in batches:
            for part in slices(batch, 1):
                keys = part.column(0)
                known = np.flatnonzero(np.asarray(keys.is_valid()))
                own = np.full(len(keys), -1, np.int64)
                values = np.asarray(keys.take(pa.array(known)).to_pylist()) if len(known) else edges[:0]
                own[known] = np.searchsorted(edges, values, side="right") - 1
                first = np.zeros(len(keys), bool)
                first[known] = edges[own[known]] == values
                sent = np.concatenate([np.arange(len(keys)), np.flatnonzero(first)])
                to = np.concatenate([own, (own[first] - 1) % max(len(cuts), 1)])
                last = np.arange(len(sent)) >= len(keys)
                blobs = pa.array([press.compress(x.as_py().encode()) for x in part.column(1)], pa.binary()).take(pa.array(sent))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(last), keys.take(pa.array(sent)), part.column(2).take(pa.array(sent)), blobs], ["to", "last", "key", "tie", "blob"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        held = None
        for batch in batches:
            for part in slices(batch, 4, 1 << 20):
                to, last, keys = part.column(0).to_numpy(), np.asarray(part.column(1)), part.column(2)
                texts = [unpress.decompress(x.as_py()).decode() for x in part.column(4)]
                marks = np.zeros((0, samples), np.uint16)
                if held is not None:
                    to, last = np.concatenate([held[0], to]), np.concatenate([held[1], last])
                    keys, texts, marks = pa.concat_arrays([held[2], keys]), held[3] + texts, held[4]
                at = np.flatnonzero(~last[:-1])
                edited, marks, other = marked(to, texts, marks, at)
                held = to[-1:], last[-1:], keys.slice(len(keys) - 1), texts[-1:], marks[-1:]
                yield from finish(to, keys, texts, edited, marks, other, at)
        if held is not None and not held[1][0]:
            to, _, keys, texts, marks = held
            at = np.zeros(1, np.int64)
            edited, marks, other = marked(to, texts, marks, at)
            yield from finish(to, keys, texts, edited, marks, other, at)

    def next_of(to, at):
        follow = np.minimum(at + 1, len(to) - 1)
        return follow, (to[follow] == to[at]) & (follow > at) & (to[at] >= 0)

    def marked(to, texts, marks, at):
        """The edited texts of the rows `at`; the marks of all texts, the first of which are known, and of the edited ones. Each
        edited text comes right after its own, as they have words in common."""
        follow, follows = next_of(to, at)
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + (texts[j][: len(texts[i]) // 2] if ok else "") for i, j, ok in zip(at, follow, follows, strict=True)]
        known = len(marks)
        order = np.argsort(np.concatenate([2 * np.arange(known, len(texts)), 2 * at + 1]))
        column = texts[known:] + edited
        drawn = np.empty((len(column), samples), np.uint16)
        drawn[order] = signatures(pa.array([column[i] for i in order], pa.large_string()), samples)
        return edited, np.concatenate([marks, drawn[: len(texts) - known]]), drawn[len(texts) - known :]

    def finish(to, keys, texts, edited, marks, other, at):
        if not len(at):
            return
        follow, follows = next_of(to, at)
        near_next = pa.array(np.where(follows, likeness(marks[at], marks[follow]), np.nan), mask=~follows)
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(at)),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(hexed(marks[at]), pa.string()),
                pa.array(hexed(other), pa.string()),
                pa.array(likeness(marks[at], other)),
                near_next,
            ],
            ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = rows.withColumn("tie", F.xxhash64("text")).select("key", "text", "tie").mapInArrow(deal, f"to long, last boolean, key {kind}, tie long, blob binary")
    spot = F.when(F.col("to") < 0, F.pmod(F.col("tie"), F.lit(ranges))).otherwise(F.col("to"))
    ordered = dealt.repartition(spot).sortWithinPartitions("to", "last", "key", "tie")
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(pairs, schema).withColumnRenamed("key", key)
