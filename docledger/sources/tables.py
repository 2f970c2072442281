"""Parquet tables with fixed schemas, and the current state of append-only ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.schemas import schema_of


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the tables below ``base``, in folders by some of its columns or not; the schema is declared, so no file is opened to infer it."""
    schema = schema_of(name)
    return spark.read.schema(schema).parquet(f"{base}/{name}").select(*schema.names)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Exactly the declared columns, cast to the declared types; absent ones are NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name).fields])


def write_table(df: DataFrame, base: str, name: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """Write rows of a table. With ``by`` the table is laid out in folders by these columns, rows of a folder meet in a range of
    tasks, and mode "overwrite" replaces only the folders that the rows fall into. Readers that filter on a column of ``by``
    list and read only its folders."""
    rows = conform(df, name)
    if not by:
        rows.write.mode(mode).parquet(f"{base}/{name}")
        return
    rest = [c for c in rows.columns if c not in by]
    ranged = rows.repartitionByRange(*by, *rest[:1])  # a very large folder is spread over several tasks
    ranged.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{base}/{name}")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task in heavy text work, about.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Spread an input before heavy text work, so that a task has some ten thousand rows: as many tasks as cores at least, and more with
    more rows. An input that is dealt out finely enough passes through without a shuffle. The count reads the footers of the files."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
