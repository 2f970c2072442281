"""Byte-exact CSV sinks. Spark's own CSV writer cannot put a byte-order mark before the first quote or write cp932, so the
finished lines are encoded by the tasks that hold them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators.exports import DIALECTS, export_lines

WRITTEN = "path string, client_id string, row_count bigint"


def _writer(base: str, heads: list[str], encoding: str, max_rows: int, errors: str):
    def run(batches):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), base)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        done, state = [], {}
        bom = b"\xef\xbb\xbf" if encoding == "utf-8-sig" else b""
        codec = "utf-8" if encoding == "utf-8-sig" else encoding

        def close():
            if state:
                state["stream"].close()
                fs.move(state["tmp"], state["path"])
                done.append((state["path"], state["client"], state["rows"]))
                state.clear()

        def open_for(client, seq):
            folder = f"{root}/client={client}"
            fs.create_dir(folder, recursive=True)
            path = f"{folder}/part-{part:05d}-{seq:04d}.csv"
            tmp = f"{folder}/.part-{part:05d}-{seq:04d}.{attempt}"
            state.update(client=client, path=path, tmp=tmp, rows=0, seq=seq, stream=fs.open_output_stream(tmp))
            state["stream"].write(bom + "".join(h + "\r\n" for h in heads).encode(codec, errors))

        for pdf in batches:
            for client, lines in pdf.groupby("client_id", sort=False)["line"]:
                for at in range(0, len(lines), max_rows):
                    piece = lines.iloc[at:at + max_rows]
                    same = state and state["client"] == client
                    if not same or state["rows"] + len(piece) > max_rows:
                        seq = state["seq"] + 1 if same else 0
                        close()
                        open_for(client, seq)
                    state["stream"].write("".join(x + "\r\n" for x in piece).encode(codec, errors))
                    state["rows"] += len(piece)
        close()
        yield pd.DataFrame(done, columns=["path", "client_id", "row_count"])

    return run


def _on_default_store(df: DataFrame, path: str) -> str:
    """A path without a scheme belongs to the session's default file system, not to each executor's disk."""
    if "://" in path:
        return path
    default = df.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if default.startswith("file:") else f"{default.rstrip('/')}/{path.lstrip('/')}"


def write_export(
    docs: DataFrame, extracted: DataFrame, fmt: str, path: str, *, max_rows: int = 1_000_000, files: int | None = None, errors: str = "strict",
) -> DataFrame:
    """Write one format below ``path`` as ``run=<new id>/client=<id>/part-*.csv`` and return the files with their row counts. Each
    call has a run folder of its own, so files of an earlier run are never mixed in.

    Rows are range partitioned by (client, date, id), so a very large client becomes several complete files, each with its
    own header, and small clients share a task. A retried task replaces its own files. Counting the result runs the job.
    """
    lines = export_lines(docs, extracted, fmt).withColumn("client_id", F.coalesce("client_id", F.lit("none")))
    keys = ["client_id", "transaction_date", "id"]
    ranged = lines.repartitionByRange(files, *keys) if files else lines.repartitionByRange(*keys)
    _, heads, encoding = DIALECTS[fmt]
    path = f"{_on_default_store(docs, path).rstrip('/')}/run={uuid.uuid4().hex}"
    return ranged.sortWithinPartitions(*keys).select("client_id", "line").mapInPandas(_writer(path, heads, encoding, max_rows, errors), WRITTEN)


def write_deals(deals: DataFrame, path: str) -> None:
    """Deal payloads as JSON lines."""
    deals.select(F.col("payload").alias("value")).write.mode("append").text(path)
