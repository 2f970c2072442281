"""Audit events, record diffs and change history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import blank_to_null
from docledger.schemas import schema_of
from docledger.sources.commits import commit_run, is_committed, read_committed, run_path

CHANGE = "struct<before:string,after:string>"


def diff_maps(before: Column, after: Column) -> Column:
    """Only the fields that differ, NULL-safe, as map<string,struct<before,after>>."""
    empty = F.create_map().cast("map<string,string>")
    pairs = F.map_zip_with(F.coalesce(before, empty), F.coalesce(after, empty), lambda k, b, a: F.struct(b.alias("before"), a.alias("after")))
    return F.map_filter(pairs, lambda k, p: ~p["before"].eqNullSafe(p["after"]))


def diff_frames(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row versions of two tables compared by key: (key, change, changes)."""
    cols = [c for c in before.columns if c != key]
    as_map = lambda df: F.create_map(*[c for n in cols for c in (F.lit(n), F.col(n).cast("string"))])
    b = before.select(key, as_map(before).alias("_b"))
    a = after.select(key, as_map(after).alias("_a"))
    joined = b.join(a, key, "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    out = joined.select(key, kind.alias("change"), diff_maps(F.col("_b"), F.col("_a")).alias("changes"))
    return out.filter((F.size("changes") > 0) | (F.col("change") != "changed"))


def version_history(log: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """Each version with what changed since the one before, whatever numbers lie between them."""
    state = F.create_map(*[c for n in fields for c in (F.lit(n), F.col(n).cast("string"))])
    order = Window.partitionBy(key).orderBy(version)
    cur = log.select(key, version, state.alias("_a")).withColumn("_b", F.lag("_a").over(order))
    return cur.select(key, version, F.col("_b").isNull().alias("is_first"), diff_maps(F.col("_b"), F.col("_a")).alias("changes"))


def audit_events(df: DataFrame, *, event_id: Column, at: Column, event_type: Column, user: Column, resource_type: Column,
                 resource_id: Column, status: Column | None = None, ip: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Audit rows; an absent user reads as anonymous and an absent detail as an empty map."""
    none = F.lit(None).cast("string")
    return df.select(
        event_id.alias("id"), at.alias("timestamp"), event_type.alias("event_type"),
        F.coalesce(blank_to_null(user), F.lit("anonymous")).alias("user_id"), resource_type.alias("resource_type"),
        resource_id.alias("resource_id"), (status if status is not None else F.lit("success")).alias("status"),
        (ip if ip is not None else none).alias("ip_address"),
        F.coalesce(detail if detail is not None else F.lit(None).cast(f"map<string,{CHANGE}>"),
                   F.create_map().cast(f"map<string,{CHANGE}>")).alias("detail"))


def change_events(pairs: DataFrame, **columns) -> DataFrame:
    """Audit rows of data changes from (before, after) maps."""
    return audit_events(pairs, detail=diff_maps(F.col("before"), F.col("after")), **columns)


def unknown_events(events: DataFrame) -> DataFrame:
    """Audit rows whose event type is none of the fixed ones."""
    return events.filter(~F.coalesce(F.col("event_type").isin(C.AUDIT_EVENTS), F.lit(False)))


LOG = "audit"


def write_jsonl(events: DataFrame, base: str, run: str, number: int = 0) -> bool:
    """Add the events of a run as JSON lines, in folders by day, and mark the run as complete. A run that failed halfway may be
    written again under its name; one that is complete is left as it is. Tells whether anything was written."""
    spark = events.sparkSession
    if is_committed(spark, base, run, number):
        return False
    dated = events.withColumn("day", F.to_date("timestamp"))
    dated.write.mode("overwrite").partitionBy("day").option("ignoreNullFields", "false").json(run_path(base, LOG, run, number))
    commit_run(spark, base, run, number)
    return True


def read_jsonl(spark: SparkSession, base: str) -> DataFrame:
    """Events of all complete runs, with the day of their folder."""
    schema = schema_of("audit_logs")
    rows = read_committed(spark, base, LOG, schema.add("day", "date"), "json")
    return rows.select(*schema_of("audit_logs").names, "day")


def audit_report(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("timestamp").alias("day"), "event_type", "status").agg(F.count("*").alias("events"))


def events_by_user(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "failure").alias("failures"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
