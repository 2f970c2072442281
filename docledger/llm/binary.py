"""Token ids in Arrow files of equal-length sequences.

A part is two files. `part-….arrow` is Arrow's stream of record batches in its file form, with the footer that tells where each
batch starts: columns `ids` and `mask`, fixed-size lists of `length` numbers or bits, BATCH rows a batch. Sequence i is row i % BATCH of
batch i // BATCH, so a memory-mapped file gives any sequence as a numpy view and any mask as an Arrow view, without reading or
copying the rest. Ids take 16 bits where the vocabulary allows.
`part-….index.arrow` has a row per document: its key, where its ids start in the part and how many there are. Only the last
sequence of a part is padded, with mask 0.

Documents are dealt out by key ranges, so parts follow each other in key order. A task writes under a name of its own and
returns it; the manifest names the parts of the attempts that Spark took, so what a lost or repeated attempt left is never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.llm.units import Ids, tokenizer_at
from docledger.llm.words import slices, spread

#: Sequences in a record batch.
BATCH = 256
#: Bytes of text for one part.
PART_BYTES = 64 << 20


_encoders: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    if path not in _encoders:
        _encoders[path] = Ids(path)
    return _encoders[path]


def store(folder: str):
    """(file system, path) of a folder; without a scheme it is a path that all machines mount."""
    from pyarrow import fs

    local = re.fullmatch(r"file:/+(.*)", folder)
    if local or "://" not in folder:
        return fs.LocalFileSystem(), "/" + local[1] if local else folder
    return fs.FileSystem.from_uri(folder)


class SequenceWriter:
    """Appends documents to one part; memory stays at a batch of sequences and one document."""

    def __init__(self, fs, path: str, key: pa.DataType, length: int, kind: np.dtype):
        self.length, self.rows, self.kind = length, BATCH * length, kind
        cell = pa.list_(pa.from_numpy_dtype(kind), length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", cell[0]), ("mask", cell[1])])
        self.index_schema = pa.schema([("key", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink, self.index_sink = fs.open_output_stream(f"{path}.arrow"), fs.open_output_stream(f"{path}.index.arrow")
        self.file, self.index = pa.ipc.new_file(self.sink, self.schema), pa.ipc.new_file(self.index_sink, self.index_schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = self.documents = self.sequences = 0

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += len(lists[0])

    def add(self, keys: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        ends = np.cumsum(count)
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(self.tokens + ends - count), pa.array(count)], schema=self.index_schema))
        self.tokens += len(ids)
        self.documents += len(count)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.rows:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.rows * self.rows
            for a in range(0, whole, self.rows):
                self._write(flat[a : a + self.rows], np.ones(self.rows, bool))
            self.held = [flat[whole:].copy()]
            self.waiting = len(flat) - whole

    def close(self) -> None:
        if self.waiting:
            size = -(-self.waiting // self.length) * self.length
            ids, mask = np.zeros(size, self.kind), np.zeros(size, bool)
            ids[: self.waiting] = np.concatenate(self.held)
            mask[: self.waiting] = True
            self._write(ids, mask)
        for x in (self.file, self.index, self.sink, self.index_sink):
            x.close()


class SequenceFile:
    """Random access to a part: len(), [i] gives (ids, mask) of sequence i as views, `pieces` the ids of a range in views."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs as pafs

        fs, path = store(folder)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.file, self.index = pa.ipc.open_file(opened(f"{path}/{name}.arrow")), pa.ipc.open_file(opened(f"{path}/{name}.index.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        batches = self.file.num_record_batches
        self.sequences = (batches - 1) * BATCH + self.file.get_batch(batches - 1).num_rows if batches else 0
        self._at, self._views = -1, None

    def _batch(self, b: int) -> tuple[np.ndarray, pa.FixedSizeListArray]:
        if self._at != b:
            got = self.file.get_batch(b)
            self._views = got.column(0).flatten().to_numpy().reshape(-1, self.length), got.column(1)
            self._at = b
        return self._views

    def __len__(self) -> int:
        return self.sequences

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not -self.sequences <= i < self.sequences:
            raise IndexError(i)
        i %= self.sequences
        ids, mask = self._batch(i // BATCH)
        return ids[i % BATCH], mask[i % BATCH].values

    def pieces(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from token start on, one view for each batch they touch."""
        size = BATCH * self.length
        while count > 0:
            b, at = divmod(start, size)
            got = self._batch(b)[0].reshape(-1)[at : at + count]
            yield got
            start, count = start + len(got), count - len(got)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for b in range(self.index.num_record_batches):
            yield self.index.get_batch(b)


def write_sequences(
    docs: DataFrame, tokenizer_path: str, folder: str, length: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Write all documents in ascending key order below `folder`; the manifest (part, name, documents, tokens, sequences, start)
    comes back, and is stored as `folder`/run=<id>/manifest. start: tokens of all parts before.

    Each text's ids are closed by end_id; a null or empty text is end_id alone. Null keys come first; rows with one key are
    ordered by a hash of their text, and equal rows are written each. Other columns are not read. An empty table gives an empty
    manifest. The number of parts follows the bytes of text; a key that very many rows share is spread over parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    parts = max(1, -(-size // part_bytes))
    order = F.col("key").asc_nulls_first(), F.xxhash64("text").asc()
    folder = f"{folder.rstrip('/')}/run={uuid.uuid4().hex}"
    known = tokenizer_at(tokenizer_path).get_vocab(with_added_tokens=True)
    kind_of_id = np.dtype(np.uint16 if max(end_id, *known.values()) < 1 << 16 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        task, ids_of, out, name = TaskContext.get().partitionId(), encoder(tokenizer_path), None, ""
        for batch in batches:
            for piece in slices(batch, 1):
                if out is None:
                    name = f"part-{task:06d}-{uuid.uuid4().hex[:12]}"
                    fs.create_dir(root, recursive=True)
                    out = SequenceWriter(fs, f"{root}/{name}", batch.schema.field(0).type, length, kind_of_id)
                ids, count = ids_of.encode(piece.column(1))
                ends = np.cumsum(count + 1)
                closed = np.full(int(ends[-1]), end_id, kind_of_id)
                closed[spread(ends - count - 1, count)] = ids
                out.add(piece.column(0), closed, count + 1)
        if out is not None:
            out.close()
            told = [[task], [name], [out.documents], [out.tokens], [out.sequences]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], ["part", "name", "documents", "tokens", "sequences"])

    ordered = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(run, "part long, name string, documents long, tokens long, sequences long")
    made.write.parquet(f"{folder}/written")
    made = spark.read.schema(made.schema).parquet(f"{folder}/written")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part, not for each document
    manifest = made.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).withColumns({"folder": F.lit(folder), "key_type": F.lit(kind)})
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a run folder."""
    schema = "part long, name string, documents long, tokens long, sequences long, start long, folder string, key_type string"
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from the files that the manifest names: ids of all documents
    before it, its own with the end id, and the CRC of those as little-endian 32-bit numbers. One part is one task; an empty
    manifest has no rows."""
    known = manifest.select("key_type").first()
    kind = known["key_type"] if known else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in batch.to_pylist():
                part = SequenceFile(told["folder"], told["name"])
                for index in part.documents():
                    crc = []
                    for start, count in zip(index.column(1).to_pylist(), index.column(2).to_pylist(), strict=True):
                        value = 0
                        for ids in part.pieces(start, count):
                            value = zlib.crc32(ids.astype("<u4"), value)
                        crc.append(value)
                    start = index.column(1).to_numpy() + told["start"]
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array(start), index.column(2), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    parts = max(1, manifest.count())
    out = manifest.select("folder", "name", "start").repartition(parts).mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)
