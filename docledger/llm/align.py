"""Alignment of two tokenizers' tokens by sparse incidence matrices.

Both tokenizers read the same bytes: a space and the text. A token-byte matrix has a row per token and a one for each byte that
the token covers; A times the transpose of B, row by row after Gustavson, gives the overlap links and how many bytes they share.
Bytes where tokens of both sides end cut a text into groups; the product of token-group and group-token incidence gives the
shared-group links. Neither kind of link leaves a unit of `units`, so products are made once per distinct unit of a worker.

Over the corpus, Spark counts in how many documents each pair of ids is linked and compares that with the best of its A id.
Pairs that occur in many documents are few and are joined from a broadcast; the others are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import BROADCAST_ROWS, small
from docledger.llm.tokens import proof
from docledger.llm.units import Merger, Numbers, cut_by, parts_of
from docledger.llm.words import slices, spread
from docledger.session import keep

NO = np.zeros(0, np.int64)
#: Products that are expanded at a time, and pairs of ids in one row.
BLOCK, ROW_PAIRS = 1 << 20, 1 << 16


@dataclass
class Sparse:
    """A matrix in compressed rows: row i holds data[start[i]:start[i + 1]] in columns column[start[i]:start[i + 1]]."""

    start: np.ndarray
    column: np.ndarray
    data: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.start) - 1

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, data: np.ndarray, shape: tuple[int, int]) -> Sparse:
        """From entries in any order; entries on one place are added."""
        place, value = _added(row * max(shape[1], 1) + column, data)
        row, column = np.divmod(place, max(shape[1], 1))
        return cls(np.searchsorted(row, np.arange(shape[0] + 1)), column, value, shape[1])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.start))

    def transposed(self) -> Sparse:
        return Sparse.of(self.column, self.rows(), self.data, (self.width, self.height))

    def times(self, other: Sparse) -> Sparse:
        """Gustavson's product: row i is the sum of the rows of `other` that its entries name, each times the entry. Rows are
        worked in blocks, so what is expanded at a time stays bounded."""
        size = np.diff(other.start)[self.column]
        work = np.concatenate([[0], np.cumsum(size)])[self.start]
        starts, columns, data = [np.zeros(1, np.int64)], [], []
        a = 0
        while a < self.height:
            b = max(a + 1, int(np.searchsorted(work, work[a] + BLOCK, side="right")) - 1)
            entries = slice(self.start[a], self.start[b])
            n = size[entries]
            pick = spread(other.start[self.column[entries]], n)
            row = np.repeat(np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1])), n)
            place, value = _added(row * max(other.width, 1) + other.column[pick], np.repeat(self.data[entries], n) * other.data[pick])
            row, column = np.divmod(place, max(other.width, 1))
            starts.append(starts[-1][-1] + np.searchsorted(row, np.arange(1, b - a + 1)))
            columns.append(column)
            data.append(value)
            a = b
        return Sparse(np.concatenate(starts), np.concatenate([NO, *columns]), np.concatenate([NO, *data]), other.width)


def _added(place: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(place):
        return NO, NO
    if len(place) > 1 and (np.diff(place) < 0).any():
        order = np.argsort(place, kind="stable")
        place, data = place[order], data[order]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[head], np.add.reduceat(data, head)


def incidence(end: np.ndarray, length: np.ndarray, size: int) -> Sparse:
    """Token-byte matrix of tokens that end at `end` and are `length` bytes long."""
    start = np.concatenate([[0], np.cumsum(length)])
    return Sparse(start, spread(end - length, length), np.ones(int(start[-1]), np.int64), size)


@cache
def byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies write for it: printable Latin-1 stands for itself, the rest follow from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}


class ByteLevel:
    """Side A: a byte-level tokenizer of the tokenizers library. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.merger, self.apart = Merger(path, special=False), cut_by(path)
        of = byte_letters()
        vocabulary = self.merger.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes([of[c] for c in piece]) if all(c in of for c in piece) else piece.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.merger.ids([" " + u for u in units])


class Pieces:
    """Side B: a sentencepiece model, which writes the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.apart = proof(path)[0]
        told = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(told)]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


@dataclass
class Aligned:
    """Figures of each unit, and its linked id pairs with links and shared bytes as (first, count) in the flat columns."""

    figures: np.ndarray
    groups: list[str]
    first: np.ndarray
    count: np.ndarray
    pair: np.ndarray
    links: np.ndarray
    shared: np.ndarray


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "whole"]


class Aligner:
    """Alignments of units, kept by a worker in bounded memory."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.apart = self.a.apart and self.b.apart
        self.width = len(self.b.bytes)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.told = [np.array([f"{i}{mark}" for i in range(len(side.bytes))], object) for side, mark in ((self.a, ","), (self.a, "|"), (self.b, ","), (self.b, ";"))]
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.all = Aligned(np.zeros((0, len(FIGURES)), np.int64), [], NO, NO, NO, NO, NO)

    def align(self, units: list[str]) -> Aligned:
        """Tokens, groups and links of each unit behind a space."""
        n = len(units)
        body = [(" " + u).encode() for u in units]
        ids_a, ids_b = self.a.encode(units), self.b.encode(units)
        whole = np.array([
            bool(u) and b"".join([self.a.bytes[i] for i in x]) == t and b"".join([self.b.bytes[i] for i in y]) == t
            for u, t, x, y in zip(units, body, ids_a, ids_b, strict=True)
        ], bool)
        size = np.where(whole, [len(t) for t in body], 0)
        count_a, count_b = (np.where(whole, [len(x) for x in ids], 0) for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for w, x in zip(whole, ids, strict=True) if w for i in x), np.int64) for ids in (ids_a, ids_b))
        of_a, of_b = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        len_a, len_b = self.size_a[a], self.size_b[b]
        end_a, end_b, edge = np.cumsum(len_a), np.cumsum(len_b), np.cumsum(size)
        total = int(edge[-1]) if n else 0

        over = incidence(end_a, len_a, total).times(incidence(end_b, len_b, total).transposed())
        left, right = over.rows(), over.column
        pair_over = _added_pairs(of_a[left], a[left] * self.width + b[right], over.data)

        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        # rows of the incidence with groups: the distinct ids of a unit, with how often a group holds them
        name_a, row_a = np.unique(of_a * len(self.a.bytes) + a, return_inverse=True)
        name_b, row_b = np.unique(of_b * len(self.b.bytes) + b, return_inverse=True)
        in_group = Sparse.of(row_a, group_a, np.ones(len(a), np.int64), (len(name_a), len(cut)))
        of_group = Sparse.of(group_b, row_b, np.ones(len(b), np.int64), (len(cut), len(name_b)))
        linked = in_group.times(of_group)
        left = name_a[linked.rows()]
        unit, pair = left // len(self.a.bytes), left % len(self.a.bytes) * self.width + name_b[linked.column] % len(self.b.bytes)
        order = np.lexsort((pair, unit))
        unit, pair, links = unit[order], pair[order], linked.data[order]
        shared = np.zeros(len(pair), np.int64)
        shared[_places(unit, pair, *pair_over[:2])] = pair_over[2]

        figures = np.zeros((n, len(FIGURES)), np.int64)
        figures[:, 0], figures[:, 1] = count_a, count_b
        figures[:, 2] = np.bincount(np.searchsorted(edge, cut), minlength=n) if len(cut) else 0
        figures[:, 3] = np.bincount(unit, links, minlength=n).astype(np.int64) if len(unit) else 0
        figures[:, 4] = np.bincount(of_a[over.rows()], minlength=n) if len(over.column) else 0
        figures[:, 5] = whole
        count = np.bincount(unit, minlength=n) if len(unit) else np.zeros(n, np.int64)
        return Aligned(figures, self._groups(n, (a, group_a, of_a, end_a), (b, group_b, of_b, end_b)), np.cumsum(count) - count, count, pair, links, shared)

    def _groups(self, n: int, side_a: tuple, side_b: tuple) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each unit."""
        (a, group_a, of_a, _), (b, group_b, of_b, _) = side_a, side_b
        if not len(a):
            return [""] * n
        last_a = np.concatenate([group_a[1:] != group_a[:-1], [True]])
        last_b = np.concatenate([group_b[1:] != group_b[:-1], [True]])
        told = np.concatenate([np.where(last_a, self.told[1][a], self.told[0][a]), np.where(last_b, self.told[3][b], self.told[2][b])])
        of, group = np.concatenate([of_a, of_b]), np.concatenate([group_a, group_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        told, of = told[order].tolist(), of[order]
        cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
        return ["".join(told[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self) -> None:
        new = self.known.take()
        if not new:
            return
        got, old = self.align(new), self.all
        got.first += len(old.pair)
        more = {name: np.concatenate([getattr(old, name), getattr(got, name)]) for name in ("figures", "first", "count", "pair", "links", "shared")}
        self.all = Aligned(groups=old.groups + got.groups, **more)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Figures of each text, its groups, and (text, pair, links, shared) sorted by text and pair."""
        if self.known.full or len(self.all.pair) > 1 << 23:
            self._clear()
        number, units, own = self.known.__getitem__, [], []
        for text in texts:
            own.append(len(units))
            if text:
                units.extend(map(number, parts_of(text, self.apart)))
        self._learn()
        at = np.array(units, np.int64)
        cuts = np.array([*own, len(units)])
        of = np.repeat(np.arange(len(texts)), np.diff(cuts))
        figures = np.zeros((len(texts), len(FIGURES)), np.int64)
        np.add.at(figures, of, self.all.figures[at])
        whole = (figures[:, 5] == np.diff(cuts)) & (np.diff(cuts) > 0)
        figures *= whole[:, None]
        told = self.all.groups
        groups = [";".join([told[i] for i in units[x:y]]) if w else "" for x, y, w in zip(cuts[:-1], cuts[1:], whole.tolist(), strict=True)]
        take = whole[of]
        at, of = at[take], of[take]
        count = self.all.count[at]
        pick = spread(self.all.first[at], count)
        of = np.repeat(of, count)
        order = np.lexsort((self.all.pair[pick], of))
        of, pick = of[order], pick[order]
        pair = self.all.pair[pick]
        head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])])) if len(of) else NO
        if not len(head):
            return figures, groups, NO, NO, NO, NO
        return figures, groups, of[head], pair[head], np.add.reduceat(self.all.links[pick], head), np.add.reduceat(self.all.shared[pick], head)


def _added_pairs(unit: np.ndarray, pair: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, unit))
    unit, pair, data = unit[order], pair[order], data[order]
    if not len(unit):
        return NO, NO, NO
    head = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])]))
    return unit[head], pair[head], np.add.reduceat(data, head)


def _places(unit: np.ndarray, pair: np.ndarray, some_unit: np.ndarray, some_pair: np.ndarray) -> np.ndarray:
    """Where sorted (unit, pair) hold the others, which are all among them: overlapping tokens share a group."""
    if not len(some_unit):
        return NO
    width = int(max(pair.max(), some_pair.max())) + 1
    return np.searchsorted(unit * width + pair, some_unit * width + some_pair)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


def token_groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Rows (key, part, n_a, n_b, n_groups, n_links, n_overlaps, groups, pairs, links, shared) of every document.

    pairs: linked ids as a * width of B + b, ascending, with how many links each has in the document and how many bytes those
    tokens share; beyond ROW_PAIRS of them further rows, with part from 1 on and figures 0, hold the rest. groups: their text,
    or its sha256 in hex unless asked for, empty without tokens. Null and empty texts, and those that a tokenizer does not give
    back, have no tokens.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = aligner(path_a, path_b)
        for batch in batches:
            for piece in slices(batch, 1, 1 << 21):
                figures, text_of, of, pair, links, shared = told.texts(piece.column(1).to_pylist())
                own = np.bincount(of, minlength=len(figures)) if len(of) else np.zeros(len(figures), np.int64)
                rows_of = np.maximum(1, -(-own // ROW_PAIRS))
                doc = np.repeat(np.arange(len(figures)), rows_of)
                part = spread(np.zeros(len(figures), np.int64), rows_of)
                size = np.minimum(own[doc] - part * ROW_PAIRS, ROW_PAIRS)
                cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (pair, links.astype(np.int32), shared.astype(np.int32))]
                shown = text_of if groups else [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text_of]
                first = part == 0
                told_of = pa.array(shown, pa.string()).take(pa.array(doc, mask=~first))
                numbers = [pa.array(figures[doc, i] * first) for i in range(len(COLUMNS))]
                columns = [piece.column(0).take(pa.array(doc)), pa.array(part), *numbers, told_of, *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", *COLUMNS, "groups", "pairs", "links", "shared"])

    fields = ", ".join(f"{c} long" for c in COLUMNS)
    return rows.mapInArrow(run, f"key {kind}, part long, {fields}, groups string, pairs array<long>, links array<int>, shared array<int>")


def _each_pair(told: DataFrame, *columns: str) -> DataFrame:
    each = told.select(*columns, F.explode(F.arrays_zip("pairs", "links", "shared")).alias("p"))
    return each.select(*columns, F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"), F.col("p.shared").alias("shared"))


def _counted(told: DataFrame, width: int) -> DataFrame:
    """(pair, n, best, all_links, all_shared): documents that hold a pair linked, and whether no pair of its A id has more."""
    pairs = _each_pair(told).groupBy("pair").agg(F.count("*").alias("n"), F.sum("links").alias("all_links"), F.sum("shared").alias("all_shared"))
    pairs = keep(pairs.withColumn("a", F.floor(F.col("pair") / width).cast("long")), "pairs")
    top = keep(pairs.groupBy("a").agg(F.max("n").alias("top")), "top")
    return keep(pairs.join(small(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"), "all_links", "all_shared"), "counts")


def links(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a_id, b_id, documents, links, shared_bytes, best) of every pair of ids that some document links: a table to carry
    embeddings or scores from one vocabulary over to the other. best: no other b_id is linked to a_id in more documents."""
    width = len(aligner(path_a, path_b).b.bytes)
    told = keep(token_groups(docs.select(F.lit(0).alias("key"), text), path_a, path_b, "key", text), "groups")
    a = F.floor(F.col("pair") / width).cast("long")
    b = (F.col("pair") - a * width).alias("b_id")
    told_of = F.col("n").alias("documents"), F.col("all_links").alias("links"), F.col("all_shared").alias("shared_bytes")
    return _counted(told, width).select(a.alias("a_id"), b, *told_of, "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups) of every row.

    n_links: A-B token pairs that share a group; n_overlaps: those that share bytes. A pair of ids counts the documents of the
    whole input that hold it linked; n_best: links whose count is the highest of their A id, ties included; count_sum: the
    counts of all links. groups: sha256 of the group text, or the text. Null, empty and unfaithful texts have zeros and ''.
    Repeated rows each count and each give a row; null keys stay; other columns are not read; an empty table gives no rows.
    """
    width = len(aligner(path_a, path_b).b.bytes)
    told = keep(token_groups(docs, path_a, path_b, key, text, groups).withColumn("row", F.monotonically_increasing_id() - F.col("part")), "groups")
    counts = _counted(told, width).select("pair", "n", "best")
    total = counts.agg(F.count("*"), F.sum("n")).first()
    each = _each_pair(told, "row").select("row", "pair", "links")
    most = total[0] if total[0] <= BROADCAST_ROWS else BROADCAST_ROWS
    often = counts if most == total[0] else counts.filter(F.col("n") * most >= total[1])  # at most so many, as the counts add up to the total
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    found = each.join(F.broadcast(often), "pair").groupBy("row").agg(*sums)
    if most != total[0]:
        rare = each.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*sums)
        found = found.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = told.filter("part = 0").select("row", "key", *COLUMNS, "groups").join(found, "row", "left")
    return out.select(F.col("key").alias(key), *COLUMNS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")
