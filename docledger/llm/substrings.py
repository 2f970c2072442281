"""Repeated passages found with Aho-Corasick automata.

A window is a run of SIZE words. A window is taken out of a document when it also starts in one with a smaller key.

1. Every document is reduced to anchors: the least hash of the short phrases in each window. Equal windows have equal anchors,
   so only windows whose anchor another text shares can recur; one in about five words makes an anchor.
2. Recurring passages are confirmed: windows with shared anchors are grouped by a hash of their words, and one that stands
   under two keys belongs to the smallest, its owner. The owner's text gives the passages: runs of windows that it owns.
3. Passages are compiled into sharded automata over word numbers, one pattern per window, by owner, so a shard has a bounded
   size. A document streams through the shards whose owners it shares a window with, from the first to the last such window; a
   shard that very many documents go to is copied for parts of them. The automata compare words, not hashes, and report every occurrence.

A text whose words all equal those of a text with a smaller key is recognised as a whole, by its number of words, a hash and the
sha256 of its words, and neither sends anchors nor streams: of a group of copies one text does, for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import small
from docledger.llm.rows import keep_by, numbered, without
from docledger.llm.shared import NONE, buckets_for, code, shared_hashes
from docledger.llm.words import Words, mix, phrases, slices, words
from docledger.session import keep

SIZE = 13
PHRASE = 6
#: Windows in one automaton, about 50 MB, and in one piece of a passage.
SHARD_WINDOWS = 12_000
PIECE_WINDOWS = 4_000
#: Documents that stream through one copy of a shard.
COPY_DOCUMENTS = 4_000
#: About so many bytes of text in one bucket of the texts that go on.
PART_BYTES = 64 << 20


def _anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start that stays within its text: the start and the window's anchor."""
    short = min(PHRASE, size)
    a, _ = phrases(w, short)
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), NONE
    span, done = size - short + 1, 1
    while done < span:  # running minimum over span places
        step = min(done, span - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    whole = np.ones(n, bool)
    for back in range(1, size):
        cut = w.first[1:-1] - back
        whole[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(whole)
    return at, a[at]


def _anchor_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    w = words(column)
    at, a = _anchors(w, size)
    cuts = np.searchsorted(at, w.first)
    return [np.unique(a[i:j]) if j > i else NONE for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _sequence(h: np.ndarray) -> int:
    """A hash of a word sequence: a sum over mixed pairs of word and place."""
    place = np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([mix(h ^ mix(place)).sum(dtype=np.uint64) + np.uint64(len(h))])).view(np.int64)[0])


def _joined(w: Words, i: int, kept: np.ndarray | None = None) -> bytes:
    """The words of text i, or those flagged, joined by one space."""
    a, b = int(w.first[i]), int(w.first[i + 1])
    data = w.data
    at = zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)
    if kept is None:
        return b" ".join([data[s:e].tobytes() for s, e in at])
    return b" ".join([data[s:e].tobytes() for (s, e), k in zip(at, kept.tolist(), strict=True) if k])


def _all_texts(rows: DataFrame, kind: str) -> DataFrame:
    """(rid, key, n_words, sequence, sha) of every row; sha is of all words joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = words(part.column(2))
                n = part.num_rows
                sequence = [_sequence(w.hash[w.first[i] : w.first[i + 1]]) for i in range(n)]
                sha = [hashlib.sha256(_joined(w, i)).hexdigest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.counts), pa.array(sequence, pa.int64()), pa.array(sha, pa.string())], ["rid", "key", "n_words", "sequence", "sha"]
                )

    return rows.mapInArrow(run, f"rid long, key {kind}, n_words long, sequence long, sha string")


def _windows(texts: DataFrame, kind: str, size: int, parts: int) -> DataFrame:
    """(rid, key, window, lo, hi) of the windows with shared anchors in texts (rid, key, text, shared), once per text, with the
    places of their first and last word runs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = words(part.column(2))
                at, a = _anchors(w, size)
                h, _ = phrases(w, size)
                cuts = np.searchsorted(at, w.first)
                codes = code(a, parts)
                of, found, lo, hi = [], [], [], []
                for i in range(part.num_rows):
                    own = slice(cuts[i], cuts[i + 1])
                    places = at[own][np.isin(codes[own], part.column(3)[i].values.to_numpy(zero_copy_only=False))]
                    got, first = np.unique(h[places], return_index=True)
                    _, last = np.unique(h[places[::-1]], return_index=True)
                    of.append(np.full(len(got), i))
                    found.append(got)
                    lo.append((places[first] - w.first[i]).astype(np.int32))
                    hi.append((places[::-1][last] - w.first[i]).astype(np.int32))
                of = pa.array(np.concatenate(of))
                numbers = pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *numbers], ["rid", "key", "window", "lo", "hi"])

    return texts.mapInArrow(run, f"rid long, key {kind}, window long, lo int, hi int")


def _stretches(visits: DataFrame, kind: str, size: int) -> DataFrame:
    """Rows (shard, copy, rid, key, text, lo, hi) as documents for `_stream`: the words from the first window at lo to the end of
    the one at hi, between which all that the shard can find lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                w = words(part.column(4))
                first = w.start[w.first[:-1] + part.column(5).to_numpy()]
                last = w.end[w.first[:-1] + part.column(6).to_numpy() + size - 1]
                body = pa.array([w.data[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())
                ones = pa.array(np.ones(part.num_rows, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ones, part.column(2), part.column(3), body, part.column(5)], ["shard", "copy", "part", "rid", "key", "body", "lo"])

    return visits.mapInArrow(run, f"shard long, copy int, part int, rid long, key {kind}, body binary, lo int")


def _passages(owners: DataFrame, kind: str, size: int) -> DataFrame:
    """(owner_rid, owner, piece, passage, windows) of rows (owner_rid, owner, text, owned window hashes): runs of owned windows, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                w = words(part.column(2))
                h, whole = phrases(w, size)
                out = [], [], [], []
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), max(int(w.first[i]), int(w.first[i + 1]) - size + 1)
                    _, first = np.unique(h[a:b], return_index=True)  # a window that the text repeats is one pattern
                    once = np.zeros(b - a, bool)
                    once[first] = True
                    own = once & np.isin(h[a:b].view(np.int64), part.column(3)[i].values.to_numpy(zero_copy_only=False))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        for p in range(s, e, PIECE_WINDOWS):
                            q = min(p + PIECE_WINDOWS, e)
                            x, y = w.start[a + p], w.end[a + q + size - 2]
                            for column, value in zip(out, (i, len(out[0]), w.data[x:y].tobytes(), q - p), strict=True):
                                column.append(value)
                of = pa.array(out[0], pa.int64())
                told = pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *told], ["owner_rid", "owner", "piece", "passage", "windows"])

    return owners.mapInArrow(run, f"owner_rid long, owner {kind}, piece long, passage binary, windows long")


class Shard:
    """An automaton over the words of its passages.

    A word is three letters, the digits of its number, each from its own alphabet: a node then has few children, which the
    automaton searches one by one, and a match can only begin at a word. A word of no passage is three letters of no alphabet.
    """

    def __init__(self, size: int):
        self.size, self.passages, self.automaton = size, [], None

    def add(self, owner, passage: bytes) -> None:
        self.passages.append((owner, passage.split()))

    def make(self) -> None:
        import ahocorasick

        number: dict[bytes, int] = {}
        for _, words_of in self.passages:
            for x in words_of:
                number.setdefault(x, len(number))
        base = max(2, int(np.ceil(len(number) ** (1 / 3))) + 1)
        first, second, third = ([chr(256 + base * place + digit) for digit in range(base)] for place in range(3))
        self.letters = {x: first[n // base // base] + second[n // base % base] + third[n % base] for x, n in number.items()}
        self.automaton, width = ahocorasick.Automaton(ahocorasick.STORE_INTS), 3 * self.size
        for i, (_, words_of) in enumerate(self.passages):
            told = "".join([self.letters[x] for x in words_of])
            for at in range(0, len(told) - width + 1, 3):
                self.automaton.add_word(told[at : at + width], i)
        self.automaton.make_automaton()
        self.owners = [owner for owner, _ in self.passages]
        self.passages = []

    def occurrences(self, key, text: bytes) -> list[int]:
        """Starts of windows of owners with smaller keys, counted in words."""
        if self.automaton is None:
            self.make()
        told = "".join(map(self.letters.get, text.split(), repeat("\x01\x01\x01")))
        owners, back = self.owners, self.size - 1
        return [end // 3 - back for end, owner in self.automaton.iter(told) if owners[owner] < key]


def _runs(starts: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Merged (start, length) of the words that windows at sorted starts cover."""
    if not len(starts):
        return [], []
    head = np.concatenate([[True], np.diff(starts) > size])
    first = starts[head]
    last = starts[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(starts) - 1]])]
    return first.tolist(), (last + size - first).tolist()


def _stream(mixed: DataFrame, kind: str, size: int) -> DataFrame:
    """(rid, spans) of sorted rows (shard, copy, part, rid, key, body, lo): passages (part 0), then documents from word lo on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            rid, spans = [], []
            for s, c, part, r, key, body, lo in zip(*(batch.column(i) for i in range(7)), strict=True):
                if (s, c) != at:
                    at, shard = (s, c), Shard(size)
                body = body.as_py()
                if part.as_py() == 0:
                    shard.add(key.as_py(), body)
                else:
                    starts = np.array(shard.occurrences(key.as_py(), body), np.int64) + lo.as_py()
                    if len(starts):
                        rid.append(r.as_py())
                        spans.append([{"start": x, "length": y} for x, y in zip(*_runs(starts, size), strict=True)])
            cell = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(spans, cell)], ["rid", "spans"])

    return mixed.mapInArrow(run, "rid long, spans array<struct<start:bigint,length:bigint>>")


def _cut(texts: DataFrame) -> DataFrame:
    """(rid, n_removed, sha, spans, kept) of rows (rid, text, spans): the text without the words of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                w = words(part.column(1))
                removed, sha, texts = [], [], []
                for i, n in enumerate(w.counts.tolist()):
                    edge = np.zeros(n + 1, np.int64)
                    for span in part.column(2)[i].as_py():
                        edge[span["start"]] += 1
                        edge[span["start"] + span["length"]] -= 1
                    left = np.cumsum(edge[:-1]) == 0
                    text = _joined(w, i, left)
                    removed.append(n - int(left.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), part.column(2), pa.array(texts, pa.string())], ["rid", "n_removed", "sha", "spans", "kept"])

    return texts.mapInArrow(run, "rid long, n_removed long, sha string, spans array<struct<start:bigint,length:bigint>>, kept string")


def find_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, spans) of every row.

    spans: the words to take out, as (start, length) runs; kept_sha256: of the other words joined by one space. Null and empty
    texts have no words. Rows that share a key do not repeat each other. A row without a key owns nothing and loses nothing.
    Other columns are not read. `without_repeats` gives the texts.
    """
    return _repeats(docs, size, key, text, False)


def without_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every row after its repeated passages are taken out; texts that lose nothing stay as they are."""
    return _repeats(docs, size, key, text, True)


def _repeats(docs: DataFrame, size: int, key: str, text: str, texts: bool) -> DataFrame:
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs, key=F.col(key), text=F.col(text))
    every = keep(_all_texts(rows, kind), "texts")

    alike = ["sequence", "n_words", "sha"]
    long = every.filter(F.col("n_words") >= size)
    first = keep(long.groupBy(*alike).agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last"), "first")
    copies = keep(long.join(first, alike).filter(F.col("key") > F.col("first")).select("rid"), "copies")

    sent = without(rows.select("rid", "text"), copies)  # one text of each group of copies, or those of one key, speaks for all
    words_of = long.agg(F.sum("n_words"), F.sum(F.col("n_words") * 8)).first()
    buckets, parts = buckets_for((words_of[0] or 0) // 5), max(parts, -(-(words_of[1] or 0) // PART_BYTES))
    shared = keep(shared_hashes(sent, lambda column: (_anchor_sets(column, size), []), buckets, counted=False), "shared")
    some = rows.filter(F.col("key").isNotNull()).join(small(shared.select("rid")), "rid", "left_semi")
    some = some.repartition(parts, "rid").join(shared.repartition(parts, "rid"), "rid").select("rid", "key", "text", "shared")
    some = keep_by(some, "rid", "some", parts)

    windows = _windows(some, kind, size, buckets)
    owners = windows.groupBy("window").agg(F.min(F.struct("key", "rid")).alias("owner"), F.max("key").alias("last")).filter("owner.key < last")
    owners = keep(owners.select("window", F.col("owner.key").alias("owner"), F.col("owner.rid").alias("owner_rid")), "owners")
    routes = windows.join(owners, "window").filter(F.col("key") > F.col("owner")).groupBy("rid", "owner_rid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    routes = keep(routes, "routes")
    owned = owners.groupBy(F.col("owner_rid").alias("rid")).agg(F.collect_list("window").alias("owned"))  # at most one text's own windows
    passages = keep(_passages(some.join(owned, "rid").select(F.col("rid").alias("owner_rid"), F.col("key").alias("owner"), "text", "owned"), kind, size), "passages")

    total = passages.agg(F.sum("windows")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WINDOWS))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("owner_rid", "piece"), F.lit(shards)).cast("long"))
    visits = routes.join(passages.select("owner_rid", "shard").distinct(), "owner_rid").groupBy("rid", "shard").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    visits = keep(visits, "visits")
    copies_of = keep(visits.groupBy("shard").agg(F.ceil(F.count("*") / COPY_DOCUMENTS).cast("int").alias("copies")), "shards")
    visits = keep(visits.join(copies_of, "shard").withColumn("copy", F.pmod(F.xxhash64("rid"), F.col("copies")).cast("int")), "visits")
    streamed = some.select("rid", "key", "text").join(visits, "rid").select("shard", "copy", "rid", "key", "text", "lo", "hi")
    compiled = passages.join(copies_of, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    compiled = compiled.select("shard", "copy", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("rid"), F.col("owner").alias("key"), F.col("passage").alias("body"), F.lit(0).alias("lo"))
    mixed = compiled.unionByName(_stretches(streamed, kind, size)).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "part")
    spans = keep(_stream(mixed, kind, size).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")

    cut = _cut(some.select("rid", "text").join(spans, "rid").select("rid", "text", "spans"))
    if texts:
        cut = keep(cut.select("rid", "kept"), "kept").withColumn("hit", F.lit(True))
        gone = copies.withColumn("copy", F.lit(True))
        out = rows.join(cut, "rid", "left").join(gone, "rid", "left")
        return out.select(F.col("key").alias(key), F.when(F.col("copy"), "").when(F.col("hit"), F.col("kept")).otherwise(F.col("text")).alias(text))
    cut = keep(cut.select("rid", "n_removed", F.col("sha").alias("cut_sha"), "spans"), "cut")
    gone = copies.withColumn("copy", F.lit(True))
    out = every.join(cut, "rid", "left").join(gone, "rid", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
    )
