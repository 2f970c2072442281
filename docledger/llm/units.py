"""Units of text that no token crosses, and a bounded memory of what they encode to.

A single space between two characters that are no white space always opens a new pre-token of a byte-level tokenizer that
splits by its usual pattern, and no piece of a sentencepiece model that `tokens.proof` accepts goes over it. A text is therefore
cut there, and each distinct unit is encoded once in a while instead of each time it occurs. Where a tokenizer cannot be proved
to behave so, the whole text is one unit.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from docledger.llm.memo import Memo
from docledger.llm.words import mix, spread, utf8, words

CUT = re.compile(r"(?<=\S) (?=\S)")
#: A worker's memory is cleared once it holds so many units or so many characters.
UNITS, LETTERS = 240_000, 6_000_000


class Numbers(dict):
    """Numbers for units, given out as they are asked for; `new` lists the units since the last look."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.letters = 0

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        self.letters += len(key)
        return n

    @property
    def full(self) -> bool:
        return len(self) > UNITS or self.letters > LETTERS

    def take(self) -> list[str]:
        new, self.new = self.new, []
        return new


@cache
def cut_by(path: str) -> bool:
    """Whether the tokenizer file shows that units are independent: byte-level pre-tokens by pattern, nothing rewritten before,
    and added tokens that neither hold a space nor take one in."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    added = all(not (" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told.get("added_tokens") or [])
    return plain and added and told.get("normalizer") is None and not told.get("post_processor") and not told.get("truncation") and not told.get("padding")


@cache
def tokenizer_at(path: str, special: bool = True):
    """The tokenizer; special: whether strings of special tokens inside texts become those tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = not special
    return out


def parts_of(text: str | None, apart: bool) -> list[str]:
    """The units, without the space before each but the first; a null text is one empty unit."""
    return CUT.split(text) if apart and text else [text or ""]


#: A space, letters, and punctuation behind them: two pre-tokens, or one without punctuation.
PLAIN = re.compile("( ?[A-Za-z]+)([.,;:!?]*)")
#: White space beyond ASCII. A unit must not end in it, as it would part a run of white space.
WIDE = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
POOL = 1 << 22


class Merger:
    """Ids of units, each worked out anew."""

    def __init__(self, path: str, special: bool = True):
        self.tokenizer = tokenizer_at(path, special)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = cut_by(path) and not any(PLAIN.fullmatch(t) for t in added)

    def ids(self, units: list[str]) -> list[list[int]]:
        """A word of plain letters goes to the merge model at once, with the letter that stands for a space."""
        out: list[list[int] | None] = [None] * len(units)
        rest, tokenize = [], self.model.tokenize
        for i, unit in enumerate(units):
            told = PLAIN.fullmatch(unit) if self.plain else None
            if told is None:
                rest.append(i)
            else:
                word, tail = told.groups()
                out[i] = [t.id for t in tokenize(word.replace(" ", "Ġ"))]
                if tail:
                    out[i] += [t.id for t in tokenize(tail)]
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


class Ids:
    """Ids of texts from a worker's bounded memory, by 64-bit hashes of units.

    Here a unit is a run of ASCII white space with the characters up to the next such run: white space after anything else
    opens a new pre-token too, and only its own run decides how it is split. A text in which other white space stands before
    such a run is encoded whole, and so is every text if `cut_by` cannot show that units are independent.
    """

    def __init__(self, path: str):
        self.merger, self.apart = Merger(path), cut_by(path)
        self.memo, self.pool, self.used = Memo(bits=19), np.zeros(POOL, np.uint32), 0

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(data, start, end, hash, first) of the units of all texts."""
        data, at = utf8(column)
        w = words(column)
        texts, n = len(at) - 1, len(w.hash)
        begins = np.zeros(n, bool)
        begins[w.first[:-1][w.counts > 0]] = True
        of = w.text_of_word()
        start = np.where(begins, at[of], np.concatenate([[0], w.end[:-1]])[:n])
        gap = w.start - start
        key = w.hash ^ mix(gap.astype(np.uint64) + np.where(gap == 1, data[np.minimum(start, max(len(data) - 1, 0))].astype(np.uint64) << np.uint64(8), np.uint64(0)))
        whole = np.full(texts, not self.apart)
        wide = np.flatnonzero((data[w.end - 1] >= 0x80) & (w.end < at[of + 1])) if n else []
        for i in wide:
            if data[max(w.end[i] - 3, 0) : w.end[i]].tobytes().endswith(WIDE):
                whole[of[i]] = True
        long = np.flatnonzero((gap > 1) & ~whole[of])
        key[long] = _own([data[a:b] for a, b in zip(start[long], w.end[long], strict=True)])
        # the white space that ends a text, and whole texts, are units of their own
        last = np.where(w.counts > 0, w.end[np.maximum(w.first[1:], 1) - 1] if n else 0, at[:-1])
        last[whole] = at[:-1][whole]
        extra = np.flatnonzero(at[1:] > last)
        stay = ~whole[of]
        put = np.searchsorted(np.flatnonzero(stay), w.first[1:][extra])
        start, end, key, of = start[stay], w.end[stay], key[stay], of[stay]
        start, end = np.insert(start, put, last[extra]), np.insert(end, put, at[1:][extra])
        key = np.insert(key, put, _own([data[a:b] for a, b in zip(last[extra], at[1:][extra], strict=True)]))
        of = np.insert(of, put, extra)
        return data, start, end, key, np.searchsorted(of, np.arange(texts + 1))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        data, start, end, key, first = self._units(column)
        value, missed = self.memo.find(key)
        if len(missed) and self.used + 2 * int((end - start)[missed].sum()) > POOL:  # room for an id per byte, and more
            self.memo.clear()
            self.used = 0
            value, missed = self.memo.find(key)
        flat_new, base = np.zeros(0, np.uint32), self.used
        if len(missed):
            new, where, back = np.unique(key[missed], return_index=True, return_inverse=True)
            pick = missed[where]
            got = self.merger.ids([data[a:b].tobytes().decode() for a, b in zip(start[pick], end[pick], strict=True)])
            count = np.fromiter(map(len, got), np.int64, len(got))
            flat_new = np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))
            entry = (base + np.cumsum(count) - count) << 24 | count
            value[missed] = entry[back]
            if base + len(flat_new) <= POOL and (not len(count) or count.max() < 1 << 24):
                self.pool[base : base + len(flat_new)] = flat_new
                self.memo.put(new, entry)
                self.used += len(flat_new)
        at, count = value >> 24, value & ((1 << 24) - 1)
        pool = self.pool if base + len(flat_new) <= POOL else np.concatenate([self.pool[:base], flat_new])
        total = np.concatenate([[0], np.cumsum(count)])
        return pool[spread(at, count)], np.diff(total[first])


def _own(pieces: list[np.ndarray]) -> np.ndarray:
    return mix(np.array([hash(p.tobytes()) for p in pieces], np.int64).view(np.uint64))
