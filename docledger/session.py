"""Session helpers: a local session for tests and benches, and a checkpoint folder that is only set when absent."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Partitions that an exchange starts with, at least.
SHUFFLE_PARTITIONS = 1000
#: Compressed bytes up to which they are joined.
SHUFFLE_BYTES = "16m"
#: Bytes that opening a small file counts for when files are dealt to tasks.
OPEN_BYTES = "256k"
#: Bytes of rows that Python is given at a time.
BATCH_BYTES = "4m"


def local_session(app: str = "docledger", cores: str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Let the JVM compile what Spark generates: HotSpot never compiles methods above 8000 bytes of code, so wide text
    projections are better split up than fused. Left alone when the session has its own value."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def bound_partitions(spark: SparkSession) -> None:
    """Start every exchange with many partitions and let adaptive execution join them up to a small size. A session's number of shuffle
    partitions does not follow the input, so the sorts, joins and aggregates of one task would grow with it. A setting that the session has
    its own value for is left alone; without adaptive execution there is no effect."""
    wanted = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(SHUFFLE_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES}
    defaults = None, "64MB", "67108864b"
    for name, value in wanted.items():
        if spark.conf.get(name, None) in defaults:
            spark.conf.set(name, value)


def gather_small_files(spark: SparkSession) -> None:
    """Let a task read some hundreds of small files. By Spark's own reckoning it reads 32, so a folder of millions of files makes more tasks
    than the driver can hand out in time. Left alone when the session has its own value; large files are not concerned."""
    if spark.conf.get("spark.sql.files.openCostInBytes", None) in (None, "4MB", "4194304", "4194304b"):
        spark.conf.set("spark.sql.files.openCostInBytes", OPEN_BYTES)


def bound_batches(spark: SparkSession) -> None:
    """Give Python a few megabytes of rows at a time. By Spark's own reckoning a batch has 10,000 rows, and a task and its Python worker
    hold several copies of it, so their memory would follow the length of the texts. Left alone when the session has its own value."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names. Only a local session without one gets a scratch folder: executors elsewhere would
    not see it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docledger-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a frame once and read it back. Unlike a checkpoint it is computed a single time, and later steps read only the
    columns they need; a lost executor costs its own tasks and not the whole lineage. ``compression`` replaces the session's codec."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
