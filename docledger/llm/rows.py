"""Row numbers that are the same each time a frame is read, and frames kept in buckets."""

from __future__ import annotations

import contextlib
import io
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import BROADCAST_ROWS
from docledger.session import keep, scratch_folder


def numbered(frame: DataFrame, **columns: Column) -> DataFrame:
    """The columns named, behind rid. A frame that is more than a scan is written first, as its rows may come in another order
    or split when it is worked out again."""
    chosen = frame.select(*[c.alias(n) for n, c in columns.items()])
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        chosen.explain()
    if re.search("Exchange|Aggregate|Join|Sample|Limit|MapIn|RDD|Generate|Union", told.getvalue()):
        chosen = keep(chosen, "rows")
    return chosen.withColumn("rid", F.monotonically_increasing_id()).select("rid", *columns)


def keep_by(df: DataFrame, key: str, name: str, parts: int) -> DataFrame:
    """Like `session.keep`, in buckets of a key: later joins on it move the other side only. A frame that is already dealt out by
    the key in so many parts is written as it lies. The table has a path of its own and a name in the session's catalog."""
    table = f"kept_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).sortBy(key).option("path", scratch_folder(df.sparkSession, name)).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose rid is not among those gone, a kept frame; they stay in ascending order of rid within partitions."""
    if gone.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), "rid", "left_anti")
    return rows.join(gone, "rid", "left_anti").repartitionByRange("rid").sortWithinPartitions("rid")
