"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams of one to four bytes that both hold (blended spectrum, presence only), divided
by the root of both texts' own counts. It is taken over the n-grams most common in the training sample. Some sample texts are
landmarks: the Nystrom map turns a text's kernel values with them into features, on which one ridge regression per language is
trained against the rest. All map and regression steps after the kernel are one matrix, so scoring a batch of texts is two
matrix products: presence by landmarks, and landmarks by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import small
from docledger.llm.rows import numbered
from docledger.llm.words import slices, utf8
from docledger.session import bound_batches, keep

PER_LABEL = 400
LANDMARKS = 64
GRAMS = 8192
LONGEST = 4
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"

#: A-Z to a-z; what is neither letter nor part of a longer character becomes a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class Grams:
    """Numbers of the chosen n-grams. An n-gram's code is its bytes as a number with its length above them."""

    codes: np.ndarray
    tables: dict = field(default_factory=dict)

    def __post_init__(self):
        for n in range(1, LONGEST + 1):
            own = np.flatnonzero(self.codes >> np.int64(40) == n)
            salt = 0
            while True:  # a salt that sends no two chosen n-grams to one slot
                slot = _slot(self.codes[own], salt)
                if len(np.unique(slot)) == len(own):
                    break
                salt += 1
            table = np.full(1 << 21, len(self.codes), np.int32)
            table[slot] = own
            self.tables[n] = salt, table

    def numbers(self, codes: np.ndarray, n: int) -> np.ndarray:
        salt, table = self.tables[n]
        number = table[_slot(codes, salt)]
        known = np.append(self.codes, -1)[number] == codes
        return np.where(known, number, len(self.codes))


def _slot(codes: np.ndarray, salt: int) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15 + 2 * salt * 0x2545F4914F6CDD1D) % (1 << 64) | 1)
    return (h >> np.uint64(43)).astype(np.int64)


def _codes(data: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """The n-gram at each byte; -1 where it would leave its text."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.int64)
    for j in range(n):
        code = (code << 8) | data[j : len(data) - n + 1 + j]
    code |= np.int64(n) << np.int64(40)
    for back in range(1, n):
        cut = edges[1:-1] - back
        code[cut[(cut >= 0) & (cut < len(code))]] = -1
    return code


def presence(grams: Grams, column: pa.Array) -> np.ndarray:
    """One row of booleans per text: which of the chosen n-grams it holds. Whole texts are read, in pieces."""
    data, at = utf8(column)
    n_texts, width = len(column), len(grams.codes)
    out = np.zeros((n_texts, width + 1), bool)
    flat = out.reshape(-1)
    step = 1 << 18
    for a in range(0, len(data), step):
        b = min(a + step + LONGEST - 1, len(data))  # pieces overlap, as presence counts once
        piece = FOLD[data[a:b]]
        inner = at[(at > a) & (at < b)] - a
        edges = np.unique(np.concatenate([[0], inner, [b - a]]))
        row = (np.searchsorted(at, edges[:-1] + a, side="right") - 1) * (width + 1)
        base = np.repeat(row, np.diff(edges))
        for n in range(1, LONGEST + 1):
            codes = _codes(piece, edges, n)
            flat[base[: len(codes)] + grams.numbers(codes, n)] = True
    return out[:, :width]


@dataclass
class Model:
    labels: list[str]
    grams: Grams
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, held: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(held.sum(1, dtype=np.float32), 1))
        kernel = held.astype(np.float32) @ self.landmarks
        return (kernel / own[:, None]) @ self.weights + self.bias


def _regress(held: np.ndarray, label: np.ndarray, labels: list[str], grams: Grams) -> Model:
    first = np.concatenate([np.flatnonzero(label == i)[:LANDMARKS] for i in range(len(labels))])
    unit = lambda x: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    x = held.astype(np.float32)
    marks = unit(x[first]).T
    values, vectors = np.linalg.eigh((unit(x[first]) @ marks).astype(np.float64))
    sound = values > 1e-6 * values.max()
    nystrom = vectors[:, sound] / np.sqrt(values[sound])
    z = (unit(x) @ marks).astype(np.float64) @ nystrom
    # each language counts alike, however many texts the sample has of it
    share = 1.0 / np.bincount(label, minlength=len(labels))[label]
    y = np.where(label[:, None] == np.arange(len(labels)), 1.0, -1.0)
    mean_z, mean_y = np.average(z, 0, share), np.average(y, 0, share)
    zc, yc = z - mean_z, y - mean_y
    beta = np.linalg.solve((zc * share[:, None]).T @ zc + RIDGE * len(labels) * np.eye(z.shape[1]), (zc * share[:, None]).T @ yc)
    return Model(labels, grams, marks.astype(np.float32), (nystrom @ beta).astype(np.float32), (mean_y - mean_z @ beta).astype(np.float32))


def fit(rows: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", per_label: int = PER_LABEL) -> Model | None:
    """Train on rows with label and text; None when there are none.

    The sample is bounded: by a hash of key and text, about per_label rows of each label are used, whole texts. The counts per
    label are over all rows. There have to be few labels, as for languages.
    """
    bound_batches(rows.sparkSession)
    usable = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = keep(usable.withColumn("place", place).filter(F.col("place") <= share[F.col("label")]).select("place", "label", "text"), "language_sample")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 18):
                data, at = utf8(part.column(0))
                for a, b in zip(at[:-1], at[1:], strict=True):
                    piece = FOLD[data[a:b]]
                    edges = np.array([0, b - a])
                    codes = np.concatenate([np.unique(_codes(piece, edges, n)) for n in range(1, LONGEST + 1)])
                    yield pa.RecordBatch.from_arrays([pa.array(codes)], ["code"])

    common = sample.select("text").mapInArrow(grams_of, "code long").groupBy("code").count().orderBy(F.desc("count"), "code").limit(GRAMS).collect()
    grams = Grams(np.array(sorted(r["code"] for r in common), np.int64))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                bits = np.packbits(presence(grams, part.column(2)), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in bits], pa.binary())], ["place", "label", "bits"])

    got = sorted(sample.mapInArrow(held, "place double, label string, bits binary").collect())
    labels = sorted({r["label"] for r in got})
    if not labels:
        return None
    x = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1)[:, : len(grams.codes)]
    return _regress(x, np.array([labels.index(r["label"]) for r in got]), labels, grams)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row. Texts that are null or have no letter, and all texts when nothing was learned,
    are `und` with score 0. Repeated rows each give a row; null keys stay; other columns are not read."""
    bound_batches(docs.sparkSession)
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: n-grams, landmarks, labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                lettered = np.asarray(part.column(2))
                named = np.full(part.num_rows, UNKNOWN, object)
                score = np.zeros(part.num_rows)
                of = np.flatnonzero(lettered) if model else np.zeros(0, np.int64)
                for a in range(0, len(of), 512):
                    some = of[a : a + 512]
                    s = model.scores(presence(model.grams, part.column(1).take(pa.array(some))))
                    best = s.argmax(1)
                    odds = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                    named[some] = np.array(model.labels, object)[best]
                    score[some] = 1 / odds.sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named.tolist(), pa.string()), pa.array(score)], ["key", "lang_pred", "score"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), lettered.alias("lettered")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def drop_unknown(docs: DataFrame, model: Model | None, text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose text has a language; a missing label is filled with the predicted one."""
    rows = numbered(docs, **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    told = predict(rows.select("rid", at[text].alias("text")), model, key="rid")
    told = keep(told.select("rid", "lang_pred"), "languages")
    gone = told.filter(F.col("lang_pred") == UNKNOWN).select("rid")
    rows = rows.join(small(gone), "rid", "left_anti")
    if label in at:
        bare = keep(rows.filter(at[label].isNull()).select("rid").join(told, "rid"), "filled")
        rows = rows.join(small(bare), "rid", "left")
        at[label] = F.coalesce(at[label], F.col("lang_pred"))
    return rows.select(*[c.alias(n) for n, c in at.items()])


def fold_of(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n: the folds of held-out tests."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))
