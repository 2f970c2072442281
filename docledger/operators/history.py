"""Learned posting history: upsert from approvals, ranking, newest-rule views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.vendor import vendor_key

GLOBAL_CLIENT = "_global"


def client_key(col: Column) -> Column:
    """Documents without a client share one key."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(GLOBAL_CLIENT))


def amount_range(total: Column) -> Column:
    return F.when(total <= 1000, "0-1000").when(total <= 10000, "1001-10000").when(total.isNotNull(), "10001+")


def learn_history(history: DataFrame, approvals: DataFrame) -> DataFrame:
    """Fold approvals into the history keyed by (client, vendor, account).

    Both sides carry client_id, document_id, vendor_name, account_title, tax_category, payment_method, use_count,
    last_used_at, created_at. One hash aggregation with map-side combine; a hot key shrinks before it is shuffled.
    The first-created row supplies document, tax and payment; an empty tax becomes the default.
    """
    usable = approvals.filter((F.col("vendor_name") != "") & (F.col("account_title") != ""))
    both = history.unionByName(usable.withColumn(
        "tax_category", F.coalesce(F.nullif("tax_category", F.lit("")), F.lit(C.DEFAULT_TAX))))
    first = F.min(F.struct("created_at", "document_id", "tax_category", "payment_method"))
    folded = both.groupBy("client_id", "vendor_name", "account_title").agg(
        first.alias("_first"),
        F.sum("use_count").cast("bigint").alias("use_count"),
        F.max("last_used_at").alias("last_used_at"),
    )
    return folded.select(
        "client_id", F.col("_first.document_id").alias("document_id"), "vendor_name", "account_title",
        F.col("_first.tax_category").alias("tax_category"), F.col("_first.payment_method").alias("payment_method"),
        "use_count", "last_used_at", F.col("_first.created_at").alias("created_at"),
    )


def as_approvals(approved: DataFrame, at: Column) -> DataFrame:
    """Approved documents (document_id, client_id, vendor_name, …) as history increments of one use each."""
    return approved.select(
        "client_id", "document_id", "vendor_name", "account_title", "tax_category", "payment_method",
        F.lit(1).cast("bigint").alias("use_count"), at.alias("last_used_at"), at.alias("created_at"),
    )


def newest_rules(history: DataFrame, cap: int | None = None) -> DataFrame:
    """Newest rule per (client, vendor key); with ``cap`` the newest so many of each client, with their rank.

    The newest row per key is a max_by style aggregate (combines map-side); the cap is a row_number limit, which Spark
    applies within each input partition before the shuffle.
    """
    keyed = history.withColumns({"client_key": client_key(F.col("client_id")), "vendor_key": vendor_key(F.col("vendor_name"))})
    newest = keyed.groupBy("client_key", "vendor_key").agg(
        F.max(F.struct("last_used_at", "use_count", "vendor_name", "account_title", "tax_category")).alias("_r"))
    rows = newest.select("client_key", "vendor_key", "_r.*")
    return rows if cap is None else _cap(rows, cap, "client_key", [F.desc("last_used_at"), F.desc("use_count"), F.asc("vendor_key")])


def newest_rules_global(history: DataFrame, cap: int | None = None) -> DataFrame:
    """Newest rule per vendor key over all clients; with ``cap`` the newest so many (a top-k, kept by each task first)."""
    keyed = history.withColumn("vendor_key", vendor_key(F.col("vendor_name")))
    rows = keyed.groupBy("vendor_key").agg(
        F.max(F.struct("last_used_at", "use_count", "vendor_name", "account_title", "tax_category")).alias("_r")
    ).select("vendor_key", "_r.*")
    return rows if cap is None else rows.orderBy(F.desc("last_used_at"), F.desc("use_count"), F.asc("vendor_key")).limit(cap)


def top_per_client(history: DataFrame, n: int) -> DataFrame:
    """The ``n`` most used history rows of every client, with a fixed tie order; adds ``rank``."""
    return _cap(history, n, "client_id", [F.desc("use_count"), F.desc("last_used_at"), F.asc("vendor_name"), F.asc("account_title")])


def top_history(history: DataFrame, client_id: str, limit: int = 50) -> DataFrame:
    """Most used rows of one client; ``limit`` may not exceed 200."""
    if limit > 200:
        raise ValueError("limit must be 200 or less")
    return history.filter(F.col("client_id") == client_id).orderBy(
        F.desc("use_count"), F.desc("last_used_at"), F.asc("vendor_name")).limit(limit).select(
        "vendor_name", "account_title", "tax_category", "use_count", "last_used_at")


def _cap(rows: DataFrame, cap: int, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
