"""Registry of runnable queries. Each takes (spark, sf_dir); most have an equal SQL text for another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.session import bound_partitions

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            bound_partitions(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def day(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def num(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")
