"""Quality classification by positive-unlabelled learning.

Trusted positives and unlabelled web texts train a linear model on the non-negative risk: with class prior p and logistic loss
l, the risk is p E_pos[l(+)] + max(0, E_unl[l(-)] - p E_pos[l(-)]), whose second term may not fall below zero, else the model
would fit the unlabelled texts as negatives. The prior is estimated from the unlabelled scores of a first classifier of
positives against unlabelled texts: the share of positives is the least ratio of the two score distributions' upper tails.
Inputs are shape measures of the whole text (case, symbols, repeats, word and line lengths) in bins and hashed character
classes of words; keys, sources and languages are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.words import slices, words

SAMPLE = 4000
ROUNDS = 400
RATE = 0.05
DECAY = 1e-4
BINS = 12
MEASURES = 16
SHAPES = 512

UP = np.zeros(256, bool)
UP[65:91] = True
LOW = np.zeros(256, bool)
LOW[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
POINT = np.zeros(256, bool)
POINT[[ord(c) for c in ".,;:!?'\"()-"]] = True
SYMBOL = np.array([33 <= b < 127 and not (UP[b] or LOW[b] or DIGIT[b] or POINT[b]) for b in range(256)])
#: One class letter per byte for the shapes of words.
CLASS = np.select([UP, LOW, DIGIT, POINT, SYMBOL, np.arange(256) >= 128], [1, 2, 3, 4, 5, 2], 0).astype(np.uint8)
BREAK = np.zeros(256, bool)
BREAK[10] = True


def _per_text(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(total)])
    return run[first[1:]] - run[first[:-1]]


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)


def measures(column: pa.Array) -> np.ndarray:
    """MEASURES numbers per text, then SHAPES root shares of hashed word shapes."""
    w = words(column)
    n = len(column)
    data = w.data
    at = np.concatenate([[0], np.cumsum(np.diff(w.first))])
    size = w.end - w.start
    doc = w.text_of_word()
    count = np.maximum(w.counts, 1).astype(float)
    out = np.zeros((n, MEASURES + SHAPES), np.float32)
    if not len(w.hash):
        return out
    byte = {}
    letters = np.maximum(_per_text(size, at), 1).astype(float)
    for name, table in (("up", UP), ("low", LOW), ("digit", DIGIT), ("point", POINT), ("symbol", SYMBOL)):
        run = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        byte[name] = run[w.end] - run[w.start]
    share = lambda flag: _per_text(flag.astype(np.int64), at) / count
    distinct = _distinct(w.hash, w.first)
    again = np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    lines = words(column, BREAK)
    n_lines = np.maximum(lines.counts, 1).astype(float)
    distinct_lines = _distinct(lines.hash, lines.first)
    alone = byte["up"] + byte["low"] + byte["digit"] == 0
    lone_symbol = alone & (data[w.start] < 128)
    columns = [
        _per_text(byte["up"], at) / letters,
        _per_text(byte["digit"], at) / letters,
        _per_text(byte["point"], at) / letters,
        _per_text(byte["symbol"], at) / letters,
        share((byte["up"] >= 2) & (byte["low"] == 0)),
        share((byte["symbol"] > 0) & ~alone),
        share(lone_symbol),
        share(byte["point"] >= 2),
        share(again),
        distinct / count,
        distinct_lines / n_lines,
        np.log1p(w.counts) / 12,
        letters / count / 20,
        np.log1p(count / n_lines) / 10,
        _per_text((size > 24).astype(np.int64), at) / count,
        share((byte["up"] == 1) & UP[data[w.start]]),
    ]
    for i, values in enumerate(columns):
        out[:, i] = values
    # shape of a word: classes of its first, second and last two bytes, and its length bin
    cls = CLASS[data].astype(np.int64)
    second, before = np.minimum(w.start + 1, w.end - 1), np.maximum(w.end - 2, w.start)
    shape = (((cls[w.start] * 6 + cls[second]) * 6 + cls[before]) * 6 + cls[w.end - 1]) * 4 + np.minimum(size // 6, 3)
    np.add.at(out[:, MEASURES:].reshape(n, SHAPES), (doc, (shape * 2654435761 >> 7) % SHAPES), 1.0)
    out[:, MEASURES:] = np.sqrt(out[:, MEASURES:] / count[:, None])
    return out


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(x, self.edges) @ self.weights + self.bias, -30, 30)))


def inputs(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Measures as numbers and as steps at the edges, then the word shapes."""
    steps = [(x[:, i : i + 1] > edges[i][None, :]).astype(np.float32) for i in range(MEASURES)]
    return np.concatenate([x[:, :MEASURES], *steps, x[:, MEASURES:]], axis=1)


def _descend(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior on plain positives against unlabelled texts."""
    w = np.zeros(pos.shape[1] + 1)
    p, u = (np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) for x in (pos, unl))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, ROUNDS + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        up = p.T @ (sp - 1) / len(p)
        if prior is None:
            g = up + u.T @ su / len(u)
        else:
            loss = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            g = prior * up + down if loss >= 0 else -down
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among unlabelled scores: below any score t the unlabelled texts hold at least the positives' share,
    so the least ratio of the tails above t bounds it from above. Tails of under 30 % of the positives are left
    out as too noisy, and each tail is moved by its standard error, as the least of many noisy ratios is too small."""
    cuts = np.quantile(pos, np.linspace(0, 0.7, 36))
    tail = lambda x, t, side: (x >= t).mean() + side * np.sqrt((x >= t).mean() * (x < t).mean() / len(x))  # noqa: E731  one standard error
    ratios = [tail(unl, t, 1) / max(tail(pos, t, -1), 1e-9) for t in cuts]
    return float(np.clip(min(ratios), 0.02, 0.98))


def _train(pos: np.ndarray, unl: np.ndarray) -> Model:
    both = np.concatenate([pos, unl])
    edges = np.quantile(both[:, :MEASURES], np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    p, u = inputs(pos, edges), inputs(unl, edges)
    half = np.arange(len(p)) % 2 == 0
    w, b = _descend(p[half], u[::2], None)
    rest = p[~half] if (~half).any() else p
    prior = estimate_prior(rest @ w + b, (u[1::2] if len(u) > 1 else u) @ w + b)
    w, b = _descend(p, u, prior)
    return Model(edges, w, b, prior)


def _bounded(rows: DataFrame, good: DataFrame, how: str, most: int) -> np.ndarray:
    """Measures of about `most` rows (key, text) chosen by a hash, in its order, of those with or without a key in good. All
    rows are counted, by their keys alone; texts are cut down before they meet the keys."""
    n = rows.select("key").join(good, "key", how).count()
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                x = measures(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["place", "x"])

    some = rows.withColumn("place", place).filter(F.col("place") <= min(1.0, most / max(n, 1))).join(good, "key", how).select("place", "text")
    got = sorted(some.mapInArrow(run, "place double, x binary").collect())
    return np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(-1, MEASURES + SHAPES)


def fit(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | None:
    """Train on whole texts of docs: those whose key is among the positives' keys, and all others as unlabelled.

    About `sample` texts of each kind are used, chosen by a hash of key and text. None when either kind is missing.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    good = positives.select(F.col(key).alias("key")).filter(F.col("key").isNotNull()).distinct()
    pos, unl = _bounded(rows, good, "left_semi", sample), _bounded(rows, good, "left_anti", sample)
    return _train(pos, unl) if len(pos) and len(unl) else None


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, 0 to 1. Null and empty texts are scored as texts without words; without a model all are 0.5.
    Repeated rows each give a row; null keys stay; other columns are not read."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                x = measures(part.column(1))
                s = sent.value.scores(x).astype(np.float64) if sent.value else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
