"""Token counts with the whole-token shortcut.

The model's pieces prove which strings encode alone as one token: a piece counts when encoding its text gives back just its
id. A text falls into units that no piece can cross: no piece has the word mark after another character, and none holds a
line feed together with anything else. `proof` checks both on the vocabulary, so a model that breaks them is encoded whole.
Words found in the proven table count one without merging; the others are merged by the library, once per distinct word.
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
from docledger.llm.words import slices, utf8, words

MARK = "▁"
GAPS = np.zeros(256, bool)
GAPS[[32, 10]] = True


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def proof(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether units are independent under this model, and the words that encode alone as one token."""
    sp = _model(path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    apart = not any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1) for p in pieces)
    apart = apart and sp.encode("a\nb") == sp.encode("a") + sp.encode("\n")[1:] + sp.encode("\nb")[2:]
    bare = [(i, p[1:]) for i, p in zip(ids, pieces, strict=True) if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:] and "\n" not in p]
    alone = [t for (i, t), got in zip(bare, sp.encode([t for _, t in bare], num_threads=1), strict=True) if got == [i]]
    return apart, tuple(alone)


@cache
def _whole(path: str) -> tuple[np.ndarray, Memo, Memo]:
    alone = proof(path)[1]
    table = np.sort(words(pa.array(alone, pa.large_string()), GAPS).hash)
    first = Memo(bits=17)
    first.put(table, np.ones(len(table), np.int64))
    return table, first, Memo(bits=20)


def _lengths(path: str, texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, _model(path).encode(texts, num_threads=1)), np.int64, len(texts))


def _word_counts(path: str, w, of: np.ndarray, after_break: np.ndarray) -> np.ndarray:
    """Tokens of each chosen word, with the word mark before it, or right after a line feed."""
    h = w.hash[of] ^ np.where(after_break, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
    _, shortcut, memo = _whole(path)
    n, rest = shortcut.find(h)
    got, missed = memo.find(h[rest])
    n[rest] = got
    todo = rest[missed]
    if len(todo):
        new, where, back = np.unique(h[todo], return_index=True, return_inverse=True)
        pick = todo[where]
        brk = after_break[pick]
        texts = [("\n" if b else "") + bytes(w.data[s:e]).decode() for b, s, e in zip(brk, w.start[of[pick]], w.end[of[pick]], strict=True)]
        count = _lengths(path, texts) - 2 * brk
        memo.put(new, count)
        n[todo] = count[back]
    return n


def text_lengths(path: str, column: pa.Array) -> np.ndarray:
    """Tokens of every text of an Arrow column."""
    data, at = utf8(column)
    w = words(column, GAPS)
    texts, first = len(column), w.first
    total = np.zeros(texts, np.int64)
    whole = np.zeros(texts, bool)
    if not proof(path)[0]:
        whole[:] = True
    elif MARK.encode() in data.tobytes():
        whole |= np.array([MARK.encode() in data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], bool)
    doc = w.text_of_word()
    n = len(w.hash)
    opens = np.zeros(n, bool)
    opens[first[:-1][w.counts > 0]] = True
    gap_from = np.where(opens, at[doc], np.concatenate([[0], w.end[:-1]])) if n else np.zeros(0, np.int64)
    gap = w.start - gap_from
    plain_open = opens & (gap == 0)
    one = ~opens & (gap == 1)
    before = data[np.maximum(w.start, 1) - 1] if n else np.zeros(0, np.uint8)
    brk = one & (before == 10)
    simple = (plain_open | one) & ~whole[doc]
    of = np.flatnonzero(simple)
    counts = np.zeros(n, np.int64)
    counts[of] = _word_counts(path, w, of, brk[of]) + brk[of]
    # runs of spaces and line feeds: the library merges the gap together with its word, behind a line feed that keeps them apart
    odd = np.flatnonzero(~simple & ~whole[doc])
    if len(odd):
        told = [("" if o else "\n") + bytes(data[a:b]).decode() for o, a, b in zip(opens[odd], gap_from[odd], w.end[odd], strict=True)]
        distinct = list(dict.fromkeys(told))
        known = dict(zip(distinct, _lengths(path, distinct).tolist(), strict=True))
        counts[odd] = np.array([known[t] for t in told]) - 2 * ~opens[odd]
    np.add.at(total, doc, counts)
    # what follows the last word
    ends = at[1:]
    last = np.where(w.counts > 0, w.end[np.maximum(first[1:], 1) - 1] if n else 0, at[:-1])
    for i in np.flatnonzero((ends > last) & ~whole):
        tail = bytes(data[last[i] : ends[i]]).decode()
        total[i] += len(_model(path).encode(tail)) if w.counts[i] == 0 else len(_model(path).encode("\n" + tail)) - 2
    for i in np.flatnonzero(whole):
        total[i] = len(_model(path).encode(bytes(data[at[i] : at[i + 1]]).decode()))
    return total


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row, as the sentencepiece model at model_path counts without begin and end tokens.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and keys each give a row, null keys stay null; other columns
    are not read. One pass over the input without a shuffle; a worker keeps a bounded table of words it has merged before.
    """
    schema = f"{docs.select(F.col(key).alias('key')).schema['key'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                size = np.diff(utf8(part.column(1))[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(text_lengths(model_path, part.column(1)))], ["key", "n_bytes", "n_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {schema}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("key", key)
