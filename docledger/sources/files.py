"""Binary document intake from storage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import lookup
from docledger.session import gather_small_files

BASE64 = r"^[A-Za-z0-9+/\r\n]*={0,2}\s*$"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/\\]+)$", 1))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and time of the files below ``path``; the bytes are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(
        "path", "length", "modificationTime")


def scan_files(spark: SparkSession, path: str, *, client_id: str | None = None, job_id: str | None = None) -> DataFrame:
    """Documents from files, with content and hash. The id is derived from path and bytes, so a rerun adds nothing new."""
    gather_small_files(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return as_documents(raw, client_id=client_id, job_id=job_id)


def as_documents(raw: DataFrame, *, client_id: str | None = None, job_id: str | None = None) -> DataFrame:
    name = file_name(F.col("path"))
    digest = F.sha2(F.col("content"), 256)
    return raw.withColumn("content_hash", digest).select(
        F.sha2(F.concat_ws("|", "path", "content_hash"), 256).alias("id"),
        F.lit(client_id).cast("string").alias("client_id"), F.lit(job_id).cast("string").alias("batch_job_id"),
        name.alias("original_filename"), F.concat(F.substring("content_hash", 1, 16), extension(name)).alias("stored_filename"),
        F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), mime_type(name).alias("mime_type"),
        F.lit("uploaded").alias("status"), F.col("modificationTime").alias("uploaded_at"), "content_hash", "content")


def mime_type(name: Column) -> Column:
    return lookup(extension(name), C.MIME_BY_EXTENSION, F.lit("application/octet-stream"))


def scan_batch(spark: SparkSession, path: str, job_id: str, *, client_id: str | None = None, max_files: int | None = None) -> DataFrame:
    """A whole folder under one job id; ``max_files`` refuses larger folders, looking only at the listing."""
    if max_files is not None and list_files(spark, path).limit(max_files + 1).count() > max_files:
        raise ValueError(f"at most {max_files} files at a time")
    return scan_files(spark, path, client_id=client_id, job_id=job_id)


def filter_supported(df: DataFrame, name_col: str, size_col: str | None = None, max_mb: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) by file suffix and, when asked, by size."""
    ok = extension(F.col(name_col)).isin(C.SUPPORTED_EXTENSIONS)
    reason = F.when(~F.coalesce(ok, F.lit(False)), "unsupported_extension")
    if size_col and max_mb:
        reason = reason.when(F.col(size_col) > max_mb * 1024 * 1024, "too_large")
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def originals_key(doc_id: Column, path: Column, name: Column, mime: Column) -> Column:
    """File name of the stored original: the id with the suffix of the path, of the name, or one implied by the mime type."""
    suffix = F.coalesce(
        F.nullif(F.regexp_extract(path, r"(\.[^./\\]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(\.[^./\\]+)$", 1), F.lit("")),
        F.when(F.contains(F.coalesce(mime, F.lit("")), F.lit("pdf")), ".pdf").otherwise(".png"))
    return F.concat(doc_id, suffix)


def _inline(content: Column) -> Column:
    return F.when(content.rlike(BASE64) & (content != ""), F.expr("try_to_binary(regexp_replace(file_content, '\\\\s', ''), 'base64')"))


def resolve_sources(docs: DataFrame, upload_list: DataFrame, original_list: DataFrame) -> DataFrame:
    """Adds content_source (inline, upload, original or NULL) and content_path, the file that holds the bytes.

    ``upload_list`` (file_path, path) and ``original_list`` (file_key, path) are listings; no bytes are read. Only ids and keys
    of documents without usable inline content meet the listings; ids are unique. Inline text that is no base64 falls through.
    """
    inline = _inline(F.col("file_content")).isNotNull()
    key = originals_key(F.col("id"), F.col("file_path"), F.col("original_filename"), F.col("mime_type"))
    asked = F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("upload").alias("source"), F.col("file_path").alias("key")), F.struct(F.lit(2).alias("rank"), F.lit("original").alias("source"), key.alias("key"))))
    open_ = docs.filter(~F.coalesce(inline, F.lit(False))).select("id", asked.alias("a")).select("id", "a.*").filter("key is not null")
    listed = upload_list.select(F.lit("upload").alias("source"), F.col("file_path").alias("key"), "path").unionByName(
        original_list.select(F.lit("original").alias("source"), F.col("file_key").alias("key"), "path"))
    chosen = open_.join(listed, ["source", "key"]).groupBy("id").agg(F.min(F.struct("rank", "source", "path")).alias("_chosen"))
    return docs.join(chosen, "id", "left").withColumns({
        "content_source": F.when(inline, "inline").otherwise(F.col("_chosen.source")), "content_path": F.col("_chosen.path")}).drop("_chosen")


def _open_store(path: str):
    from pyarrow import fs as pafs

    local = re.fullmatch(r"file:/+(.*)", path)
    return (pafs.LocalFileSystem(), "/" + local[1] if local else path) if local or "://" not in path else pafs.FileSystem.from_uri(path)


def read_contents(df: DataFrame, path_col: str, out: str, batch_bytes: int = 32 << 20) -> DataFrame:
    """Adds the bytes of the file that each row names, read by the task that holds the row and passed on in batches of bounded
    size; NULL for no path or a file that is gone."""
    at = df.columns.index(path_col)
    ddl = df.select("*", F.lit(None).cast("binary").alias(out)).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            held, size, first = [], 0, 0
            for i, path in enumerate(batch.column(at).to_pylist()):
                content = None
                if path is not None:
                    fs, name = _open_store(path)
                    try:
                        with fs.open_input_file(name) as f:
                            content = f.read()
                    except FileNotFoundError:
                        content = None
                held.append(content)
                size += len(content or b"")
                if size >= batch_bytes or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*batch.schema.names, out])
                    held, size, first = [], 0, i + 1

    return df.mapInArrow(run, ddl)


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files below ``folder`` and return (name, path). A file appears under its name only when it is
    complete, so a task that runs again leaves the same files; counting the result runs the job."""

    def run(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            fs, root = _open_store(folder)
            fs.create_dir(root, recursive=True)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{folder}/{n}" for n in batch.column(0).to_pylist()])], ["name", "path"])

    return df.select("name", "content").mapInArrow(run, "name string, path string")


def resolve_bytes(docs: DataFrame, upload_list: DataFrame, original_list: DataFrame) -> DataFrame:
    """Bytes of each document and where they came from: inline base64, the upload folder, or the originals folder. Keys decide
    first, see `resolve_sources`; the bytes of the chosen files are read last and never cross a shuffle. An empty file counts as none."""
    found = read_contents(resolve_sources(docs, upload_list, original_list), "content_path", "_bytes")
    inline = F.when(F.col("content_source") == "inline", _inline(F.col("file_content")))
    return found.withColumn("content", F.coalesce(inline, "_bytes")).drop("_bytes", "content_path")


def has_original_file(docs: DataFrame, upload_list: DataFrame, original_list: DataFrame) -> DataFrame:
    """Adds has_original_file from inline content or the file listings (paths and keys only)."""
    key = originals_key(F.col("id"), F.col("file_path"), F.col("original_filename"), F.col("mime_type"))
    yes = F.lit(True)
    joined = docs.withColumn("_key", key).join(upload_list.select("file_path", yes.alias("_up")), "file_path", "left").join(
        original_list.select(F.col("file_key").alias("_key"), yes.alias("_orig")), "_key", "left")
    inline = F.coalesce(F.col("file_content") != "", F.lit(False))
    return joined.withColumn("has_original_file", inline | F.coalesce("_up", "_orig", F.lit(False))).drop("_key", "_up", "_orig")


def backfill_content(resolved: DataFrame) -> DataFrame:
    """Fill a missing inline base64 text from the resolved bytes."""
    return resolved.withColumn("file_content", F.coalesce(F.nullif("file_content", F.lit("")), F.base64("content")))
