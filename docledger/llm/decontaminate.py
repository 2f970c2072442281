"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: a block of documents holds, for each term that the benchmark uses, the sorted places where it
stands. It is written once to the shared folder and serves the corpus counts and every search. A search takes the windows of
the benchmark; in each block a window starts from the list of its rarest term over the corpus and is intersected with the
other terms' lists, shifted by their offsets, in order of rarity. With slop, a term may stand that many words off its place.
No row moves between tasks, so neither a frequent term nor a large group of copies lands in one of them. The benchmark side is
taken in blocks of a stated number of words, so what is broadcast has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import small
from docledger.llm.rows import numbered
from docledger.llm.words import LOWER, PUNCTUATION, slices, spread, words
from docledger.session import bound_batches, keep

WINDOW = 10
ITEM_WORDS = 500_000
INDEX = "rid array<long>, keys array<{0}>, n_words array<long>, terms array<long>, counts array<int>, places binary"


@dataclass
class Query:
    """terms: sorted hashes. size, term: of each distinct window its words and, by offset, their term numbers. items: of each
    window, by first and count into item."""

    terms: np.ndarray
    size: np.ndarray
    term: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray


def make_query(texts: list[str], window: int = WINDOW) -> Query:
    """Distinct windows of the items; item holds places in texts. An item shorter than a window is one window."""
    w = words(pa.array(texts, pa.large_string()), PUNCTUATION, LOWER)
    terms, number = np.unique(w.hash, return_inverse=True)
    n = w.counts
    starts = np.maximum(n - window + 1, np.minimum(n, 1))
    at = spread(w.first[:-1], starts)
    of = np.repeat(np.arange(len(n)), starts)
    size = np.minimum(n[of], window)
    grid = np.full((len(at), window), -1, np.int64)
    for o in range(window):
        has = size > o
        grid[has, o] = number[at[has] + o]
    grid, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
    pairs = np.unique(np.stack([back.reshape(-1), of], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
    count = np.bincount(pairs[:, 0], minlength=len(grid)).astype(np.int64)
    return Query(terms, (grid >= 0).sum(1), grid, np.cumsum(count) - count, count, pairs[:, 1])


def build_index(docs: DataFrame, terms: np.ndarray, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row per block of documents (rid, key, text): its documents with their word counts, and each term's places there.

    Places count words, with a gap after each document that no window can bridge; they are stored as differences.
    """
    kind = docs.schema["key"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(np.asarray(terms))
    gap = window + 2 * slop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, 2):
                w = words(part.column(2), PUNCTUATION, LOWER)
                at = np.flatnonzero(maybe[(w.hash & np.uint64((1 << 20) - 1)).astype(np.int64)])
                number = np.searchsorted(vocabulary, w.hash[at])
                real = vocabulary[np.minimum(number, max(len(vocabulary) - 1, 0))] == w.hash[at] if len(vocabulary) else np.zeros(0, bool)
                at, number = at[real], number[real]
                place = at + w.text_of_word()[at] * gap
                order = np.argsort(number.astype(np.uint16) if len(vocabulary) < 1 << 16 else number, kind="stable")
                count = np.bincount(number, minlength=len(vocabulary))
                used = np.flatnonzero(count)
                place, count = place[order].astype(np.int32), count[used].astype(np.int32)
                step = np.diff(place, prepend=0).astype(np.int32)
                lists = lambda column, n: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column)
                yield pa.RecordBatch.from_arrays(
                    [
                        lists(part.column(0), part.num_rows),
                        lists(part.column(1), part.num_rows),
                        lists(pa.array(w.counts), part.num_rows),
                        lists(pa.array(vocabulary[used].view(np.int64)), len(used)),
                        lists(pa.array(count), len(used)),
                        pa.array([step.tobytes()], pa.binary()),
                    ],
                    ["rid", "keys", "n_words", "terms", "counts", "places"],
                )

    return docs.select("rid", "key", "text").mapInArrow(run, INDEX.format(kind))


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each indexed term stands in the corpus."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


def intersect(q: Query, rank: np.ndarray, terms: np.ndarray, counts: np.ndarray, place: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of all matches in one block. rank: of each query term, rarest first."""
    number = np.searchsorted(q.terms, terms)
    have = np.zeros(len(q.terms), np.int64)
    have[number] = counts
    begin = np.zeros(len(q.terms), np.int64)
    begin[number] = np.cumsum(counts) - counts
    far = int(place.max()) + 4 * (q.term.shape[1] + slop) + 1 if len(place) else 1
    joint = np.repeat(number, counts) * far + place  # sorted, as terms and each list are
    by_rarity = np.argsort(np.where(q.term >= 0, rank[q.term], len(rank) + 1), axis=1, kind="stable")
    lead = np.take_along_axis(q.term, by_rarity[:, :1], 1)[:, 0]
    win = np.repeat(np.arange(len(lead)), have[lead])
    start = place[spread(begin[lead], have[lead])] - by_rarity[win, 0]
    for step in range(1, q.term.shape[1]):
        offset = by_rarity[win, step]
        term = q.term[win, offset]
        wanted = start + offset
        low = np.searchsorted(joint, term * far + np.maximum(wanted - slop, 0))
        found = joint[np.minimum(low, len(joint) - 1)] <= term * far + wanted + slop if len(joint) else np.zeros(0, bool)
        # beyond the last list, or in a list of a later term, the bound above fails by itself
        inside = (term < 0) | ((low < len(joint)) & found)
        win, start = win[inside], start[inside]
    return win, start


def _hits(index: DataFrame, q: Query, rank: np.ndarray, item_ids: list, id_kind: str, window: int, slop: int) -> DataFrame:
    """One row per document: rid, key, n_words, hits and near."""
    kind = index.schema["keys"].dataType.elementType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast((q, rank, item_ids))
    gap = window + 2 * slop

    def per_document(win, start, q, first, n):
        """Runs of touching or overlapping windows, by document and item; start counts words of the document."""
        doc = np.searchsorted(first, start, side="right") - 1
        of = spread(q.first[win], q.count[win])
        again = np.repeat(np.arange(len(win)), q.count[win])
        item, doc, a = q.item[of], doc[again], start[again]
        b = a + q.size[win[again]]
        order = np.lexsort((a, item, doc))
        item, doc, a, b = item[order], doc[order], a[order], b[order]
        new = np.ones(len(a), bool)
        if len(a):
            same = (item[1:] == item[:-1]) & (doc[1:] == doc[:-1])
            group = np.cumsum(np.concatenate([[True], ~same]))
            reach = np.maximum.accumulate(b + group * (int(b.max()) + 1)) - group * (int(b.max()) + 1)
            new[1:] = ~same | (a[1:] > reach[:-1])
            heads = np.flatnonzero(new)
            item, doc, a, b = item[heads], doc[heads], a[heads], np.maximum.reduceat(b, heads)
        return doc, item, a - first[doc] if len(a) else a, b - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, rank, ids = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                rid, keys = batch.column(0)[i].values, batch.column(1)[i].values
                n_words = batch.column(2)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                terms = batch.column(3)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                counts = batch.column(4)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                place = np.cumsum(np.frombuffer(batch.column(5)[i].as_py(), np.int32), dtype=np.int64)
                first = np.cumsum(n_words) - n_words + np.arange(len(n_words)) * gap
                columns = [rid, keys, pa.array(n_words)]
                for spare in (0, slop) if slop else (0,):
                    win, start = intersect(q, rank, terms, counts, place, spare)
                    if not spare:
                        edge = np.zeros(int(first[-1] + n_words[-1]) + gap + 1 if len(first) else 1, np.int32)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + q.size[win], -1)
                        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
                        columns.append(pa.array(covered[first + n_words] - covered[first]))
                    else:
                        start = np.maximum(start, first[np.searchsorted(first - slop, start, side="right") - 1])
                    doc, item, a, length = per_document(win, start, q, first, len(n_words))
                    cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n_words)))]).astype(np.int32)
                    named = pa.array([ids[x] for x in item.tolist()], id_kind_arrow)
                    cells = pa.StructArray.from_arrays([named, pa.array(a), pa.array(length)], ["item_id", "start", "length"])
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), cells))
                if not slop:
                    columns.append(columns[-1])
                yield pa.RecordBatch.from_arrays(columns, ["rid", "key", "n_words", "n_hit", "hits", "near"])

    id_kind_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_kind]
    cell = f"array<struct<item_id:{id_kind},start:bigint,length:bigint>>"
    return index.mapInArrow(run, f"rid long, key {kind}, n_words long, n_hit long, hits {cell}, near {cell}")


def _covered(hits):
    """Words in the union of (start, length) runs, sorted by start."""
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(acc["to"], h["start"]))).alias("n"),
        F.greatest(acc["to"], h["start"] + h["length"]).alias("to"),
    )
    runs = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(runs, zero, step)["n"]


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", item_words: int = ITEM_WORDS
) -> DataFrame:
    """(key, n_words, n_hit, hits, near) of every document row.

    hits: for each item the runs of document words inside occurrences of its windows (word start, length); n_hit: the words in
    any of them. near: the same with each word at most slop words off its place. Null and empty texts have no words. Items
    without words or id match nothing; an id that occurs twice is one item with both texts. Repeated document rows each give a
    row; null keys stay; other columns are not read. More items than item_words words are searched in several passes.
    """
    rows = numbered(docs, key=F.col(key), text=F.col(text))
    return _found(rows, items, window, slop, item_key, item_text, item_words).select(F.col("key").alias(key), "n_words", "n_hit", "hits", "near")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item."""
    rows = numbered(docs, **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    found = _found(rows.select("rid", F.col("rid").alias("key"), at[text].alias("text")), items, window, 0, "item_id", "text", ITEM_WORDS)
    gone = keep(found.filter(F.col("n_hit") > 0).select("rid"), "contaminated")
    return rows.join(small(gone), "rid", "left_anti").select(*[c.alias(n) for n, c in at.items()])


def _found(rows: DataFrame, items: DataFrame, window: int, slop: int, item_key: str, item_text: str, item_words: int) -> DataFrame:
    bound_batches(rows.sparkSession)
    id_kind = items.schema[item_key].dataType.simpleString()
    if id_kind not in ("bigint", "int", "string"):
        items, id_kind = items.withColumn(item_key, F.col(item_key).cast("string")), "string"
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.select(F.sum(F.length("text") / 2)).first()[0] or 0  # a word and its separator take two characters at least
    passes = max(1, -(-int(size) // item_words))
    parts = []
    for p in range(passes):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        ids = sorted({r["item_id"] for r in some})
        number = {x: i for i, x in enumerate(ids)}
        q = make_query([r["text"] for r in some], window)
        q.item = np.array([number[some[i]["item_id"]] for i in q.item], np.int64)
        index = keep(build_index(rows, q.terms, window, slop), "postings")
        seen = {r["term"]: r["n"] for r in term_counts(index).collect()}  # at most the terms of item_words words
        often = np.array([seen.get(t, 0) for t in q.terms.view(np.int64).tolist()], np.int64)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        parts.append(_hits(index, q, rank, ids, id_kind, window, slop))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if passes > 1:
        found = found.groupBy("rid").agg(
            F.any_value("key").alias("key"), F.any_value("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("near")).alias("near")
        )
        found = found.withColumn("n_hit", _covered(F.col("hits")))
    return found

