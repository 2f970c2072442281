"""Which hashes of a text's set another text also has, found with a few bytes per hash.

Tasks send each hash once per slice of texts, so one that very many texts hold arrives once per slice and not once per text.
Hashes are dealt out by value to buckets whose number follows the hashes counted, so a bucket has about BUCKET of them at any
size of the input; within a bucket 32 more bits tell them apart. A task takes the buckets of its partition one after another,
sorted by the shuffle, and passes on in bounded portions what it finds, so its memory follows the bucket and not the partition.
A rare mix-up only reports a hash too many, never one too few, so what follows has to check exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.words import mix, slices

KNOWN = np.uint16(1 << 15)
#: Hashes in a bucket, and findings that a task gathers before it passes them on.
BUCKET, PORTION = 1 << 20, 1 << 20
NONE = np.zeros(0, np.uint64)


def buckets_for(hashes: int | None) -> int:
    """Buckets for so many hashes."""
    return max(1, -(-int(hashes or 0) // BUCKET))


def code(h: np.ndarray, parts: int) -> np.ndarray:
    """What a hash is known by: its bucket and 32 of its bits."""
    return (((h >> np.uint64(8)) % np.uint64(parts)) << np.uint64(32) | ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF))).astype(np.int64)


def signature(s: np.ndarray) -> int:
    """Of a sorted set of hashes: equal sets have equal ones."""
    total = mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total])).view(np.int64)[0])


def _send(sets: list[np.ndarray], names: list[int], rid: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blocks of hashes by bucket, each with the texts that hold them, as distances from the first row number."""
    base = int(rid[0])
    seen, own = set(), np.ones(len(sets), bool)
    for i, name in enumerate(names):
        own[i] = name not in seen
        seen.add(name)
    h = np.concatenate([s for s, o in zip(sets, own, strict=True) if o] or [NONE])
    of = np.repeat((rid[own] - base).astype(np.uint16), [len(s) for s, o in zip(sets, own, strict=True) if o])
    order = np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    of[new & np.concatenate([~new[1:], [False]])[: len(h)]] |= KNOWN
    ids = code(h, parts)
    columns = [[], [], [], [], []]
    for asks, pick in ((True, new), (False, ~new)):  # the first of equal hashes asks; all of them are known to be shared
        c, o = ids[pick], of[pick]
        order = np.argsort(c >> 32, kind="stable")
        c, o = c[order], o[order]
        p = c >> 32
        cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            for column, x in zip(columns, (int(p[i]), base, asks, (c[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes(), o[i:j].tobytes()), strict=True):
                column.append(x)
    kinds = pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["p", "base", "asks", "h", "of"])


def _met(asked: list[np.ndarray], asking: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, texts) of a bucket's hashes that more than one slice asked for; -1 marks those whose text knows already."""
    ids, who = np.concatenate([np.zeros(0, np.int64), *asked]), np.concatenate([np.zeros(0, np.int64), *asking])
    order = np.argsort(ids, kind="stable")
    ids, who = ids[order], who[order]
    pair = ids[1:] == ids[:-1]
    found = np.zeros(len(ids), bool)
    found[1:] |= pair
    found[:-1] |= pair
    found &= who >= 0
    return ids[found], who[found]


class Findings:
    """Shared hashes by text, passed on a portion at a time: how many, or which."""

    def __init__(self, counted: bool):
        self.counted, self.held, self.size = counted, [], 0

    def add(self, ids: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(who):
            self.held.append((who, np.ones(len(who), np.int64) if self.counted else ids))
            self.size += len(who)
        if self.size >= PORTION:
            if self.counted:  # counts of one text are added up before anything leaves
                self.held = [self._summed()]
                self.size = len(self.held[0][0])
            if self.size >= PORTION // 2:
                yield from self.flush()

    def _summed(self) -> tuple[np.ndarray, np.ndarray]:
        who, n = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        rid, back = np.unique(who, return_inverse=True)
        return rid, np.bincount(back, n, len(rid)).astype(np.int64)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        if self.counted:
            rid, n = self._summed()
            told = pa.array(n)
        else:
            who, ids = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
            order = np.argsort(who, kind="stable")
            rid, n = np.unique(who, return_counts=True)
            told = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids[order]))
        self.held, self.size = [], 0
        for a in range(0, len(rid), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(rid[a : a + (1 << 16)]), told[a : a + (1 << 16)]], ["rid", "shared"])


def shared_hashes(rows: DataFrame, sets_of: Callable[[pa.Array], tuple[list[np.ndarray], list[int]]], parts: int, counted: bool) -> DataFrame:
    """(rid, shared) of rows (rid, text) that share any: shared is the list of codes or, counted, how many there are.

    Rows of a partition have to come with ascending rid. sets_of gives sorted distinct hashes of each text, and names of the texts or
    none: texts with one name speak as one, so of those in a slice only the first asks. parts: buckets, see `buckets_for`.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rid = part.column(0).to_numpy()
                sets, names = sets_of(part.column(1))
                a = 0
                while a < len(sets):
                    b = int(np.searchsorted(rid, rid[a] + int(KNOWN)))
                    yield _send(sets[a:b], names[a:b], rid[a:b], parts)
                    a = b

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Findings(counted)
        asked, asking, bucket = [], [], None
        for batch in batches:
            for p, base, asks, h, of in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if p != bucket:
                    yield from out.add(*_met(asked, asking))
                    asked, asking, bucket = [], [], p
                ids = np.frombuffer(h, np.uint32).astype(np.int64) | (p << 32)
                of = np.frombuffer(of, np.uint16)
                who = base + (of & (KNOWN - np.uint16(1))).astype(np.int64)
                known = (of & KNOWN) > 0 if asks else np.ones(len(of), bool)
                yield from out.add(ids[known], who[known])
                if asks:
                    asked.append(ids)
                    asking.append(np.where(known, -1, who))
        yield from out.add(*_met(asked, asking))
        yield from out.flush()

    sent = rows.mapInArrow(send, "p long, base long, asks boolean, h binary, of binary").select("p", "base", "asks", "h", "of")
    # a text's findings leave once from each task, so a quarter of the session's tasks do: memory follows the bucket, not the task
    tasks = min(parts, max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    met = sent.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(meet, "rid long, shared " + ("long" if counted else "array<long>"))
    if counted:
        return met.groupBy("rid").agg(F.sum("shared").alias("shared"))
    return met.groupBy("rid").agg(F.flatten(F.collect_list("shared")).alias("shared"))  # at most a text's own hashes
