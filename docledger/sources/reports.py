"""Test report files (JUnit XML)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.session import keep

_ATTRS = "_name string, _tests string, _errors string, _failures string, _skipped string, _time string"
CASE = "_name string, _classname string, failure struct<_VALUE:string,_message:string>, error struct<_VALUE:string,_message:string>"
CASES = f"testcase array<struct<{CASE}>>"
SUITE = f"{_ATTRS}, {CASES}, testsuite array<struct<{_ATTRS}, {CASES}>>"


def same_path(col: Column) -> Column:
    """One spelling for ``file:/x`` and ``file:///x``."""
    return F.regexp_replace(col, r"^([a-z0-9]+:)/+", "$1/")


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """One row per <testsuite>, and per suite directly inside one, with its file name and its failed or broken cases. Reports are
    read once; a suite and its cases are one element of a file."""
    outer = spark.read.format("xml").option("rowTag", "testsuite").option("mode", "PERMISSIVE").schema(SUITE).load(path)
    cols = [*[c.split()[0] for c in _ATTRS.split(", ")], "testcase"]
    own = F.array(F.struct(*[F.col(c) for c in cols]))
    inner = F.coalesce(F.col("testsuite"), F.array().cast(f"array<struct<{_ATTRS}, {CASES}>>"))
    raw = outer.withColumn("file", same_path(F.input_file_name())).select("file", F.inline(F.concat(own, inner)))
    n = lambda c, t: F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t))
    cases = F.coalesce("testcase", F.array().cast(f"array<struct<{CASE}>>"))
    failed = F.filter(cases, lambda c: c["failure"].isNotNull() | c["error"].isNotNull())
    return raw.select(
        "file", F.col("_name").alias("name"), n("_tests", "int").alias("tests"), n("_errors", "int").alias("errors"),
        n("_failures", "int").alias("failures"), n("_skipped", "int").alias("skipped"), n("_time", "double").alias("time"), failed.alias("failed_cases"))


def test_totals(suites: DataFrame) -> DataFrame:
    """Totals per report file. Wrapper suites without tests are left out when a file has several suites, unless all are
    empty; then everything but the time still counts."""
    per = suites.groupBy("file").agg(
        F.count("*").alias("n"), F.sum("tests").alias("total"),
        *[F.sum(c).alias(f"all_{c}") for c in ("errors", "failures", "skipped", "time")],
        *[F.sum(F.when(F.col("tests") > 0, F.col(c)).otherwise(0)).alias(f"real_{c}") for c in ("errors", "failures", "skipped", "time")])
    whole = (F.col("n") == 1) | (F.col("total") == 0)
    pick = lambda c: F.when(whole, F.col(f"all_{c}")).otherwise(F.col(f"real_{c}"))
    seconds = F.when(F.col("n") == 1, F.col("all_time")).otherwise(F.col("real_time"))
    base = per.select("file", "total", pick("failures").alias("failed"), pick("errors").alias("errors"), pick("skipped").alias("skipped"),
                      F.round(seconds, 2).alias("time_seconds"))
    passed = F.greatest(F.lit(0).cast("bigint"), F.col("total") - F.col("errors") - F.col("failed") - F.col("skipped"))
    return base.withColumn("passed", passed).withColumn(
        "pass_rate", F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total") * 100, 1)).otherwise(F.lit(0.0)))


def failed_cases(suites: DataFrame, message_length: int | None = None) -> DataFrame:
    """Every failed or broken case of the suites with its report file; ``message_length`` cuts the message where it is given."""
    case = F.col("case")
    message = F.coalesce(case["failure"]["_message"], case["error"]["_message"], F.lit(""))
    return suites.select("file", F.explode("failed_cases").alias("case")).select(
        "file", F.coalesce(case["_name"], F.lit("")).alias("name"), F.coalesce(case["_classname"], F.lit("")).alias("classname"),
        (message if message_length is None else F.substring(message, 1, message_length)).alias("message"))


def read_test_report(spark: SparkSession, path: str, message_length: int | None = None) -> DataFrame:
    """Totals and failed cases of every report below ``path``; a file without a readable suite gives a row of zeros. Failed cases
    are in the order of name, class and message."""
    files = spark.read.format("binaryFile").load(path).select(same_path(F.col("path")).alias("file"))  # the listing alone
    suites = keep(read_suites(spark, path), "suites")
    failed = failed_cases(suites, message_length).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("name", "classname", "message"))).alias("failed_cases"))
    joined = files.join(test_totals(suites), "file", "left").join(failed, "file", "left")
    filled = joined.na.fill(0, ["total", "failed", "errors", "skipped", "passed"]).na.fill(0.0, ["time_seconds", "pass_rate"])
    none = F.array().cast("array<struct<name:string,classname:string,message:string>>")
    return filled.withColumn("failed_cases", F.coalesce("failed_cases", none))
