"""Sinks read back: tables in folders, audit files, test reports, page images, folders of files, streams with restarts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.catalog.base import day, num, query, stamp
from docledger.operators import audit as AU
from docledger.plans import fixtures as fx
from docledger.session import scratch_folder
from docledger.sources import files as FI
from docledger.sources import images as IM
from docledger.sources import reports as RE
from docledger.sources.tables import raw, read_table, write_table
from docledger.streaming import streams as STR

K = fx.K


# --- folders of files -----------------------------------------------------------------------------
@query("scan_batch", "SELECT 'p' || page_id || '.pdf' AS original_filename, 'application/pdf' AS mime_type, strlen(html)::bigint AS file_size_bytes, sha256(html) AS content_hash, 'job7' AS batch_job_id, 'c1' AS client_id, 'uploaded' AS status FROM pages")
def scan_batch(spark, sf):
    """Pages stored as files, taken in as one job."""
    folder = scratch_folder(spark, "batch")
    named = raw(spark, sf, "pages").select(F.format_string("p%d.pdf", "page_id").alias("name"), F.encode("html", "UTF-8").alias("content"))
    FI.write_files(named, folder).write.format("noop").mode("overwrite").save()
    docs = FI.scan_batch(spark, folder, "job7", client_id="c1")
    return docs.select("original_filename", "mime_type", "file_size_bytes", "content_hash", "batch_job_id", "client_id", "status")


# --- tables in folders ----------------------------------------------------------------------------
_RANGE = f"CASE WHEN {fx.TOTAL} < 50000 THEN 'small' WHEN {fx.TOTAL} < 200000 THEN 'medium' ELSE 'large' END"
_JOURNAL = [f"{fx.CLIENT} AS client_id", f"{fx.ID} AS document_id", f"{fx.VENDOR} AS vendor_name", f"{_RANGE} AS amount_range", "cast(1 as bigint) AS use_count", "cast(o_orderdate as timestamp) AS last_used_at"]


@query("table_round_trip", f"""
SELECT {fx.CLIENT} AS client_id, {fx.ID} AS document_id, {fx.VENDOR} AS vendor_name, {_RANGE} AS amount_range, CASE {_RANGE} WHEN 'medium' THEN -1 ELSE 1 END::bigint AS use_count,
  strftime(o_orderdate, '%Y-%m-%d') AS last_used FROM orders""")
def table_round_trip(spark, sf):
    """History in folders by amount range; one range is then written anew and the others stay."""
    base = scratch_folder(spark, "tables")
    rows = raw(spark, sf, "orders").selectExpr(*_JOURNAL)
    write_table(rows, base, "journal_history", by=("amount_range",))
    write_table(rows.filter("amount_range = 'medium'").withColumn("use_count", F.lit(-1)), base, "journal_history", "overwrite", by=("amount_range",))
    return read_table(spark, base, "journal_history").select("client_id", "document_id", "vendor_name", "amount_range", "use_count", day("last_used_at").alias("last_used"))


# --- audit files ----------------------------------------------------------------------------------
_TYPE = "CASE event_type WHEN 'error' THEN 'document.reject' WHEN 'purchase' THEN 'document.approve' WHEN 'view' THEN 'document.view' ELSE event_type END"


def _audit_rows(spark, sf):
    e = raw(spark, sf, "events").withColumn("type", F.expr(_TYPE))
    before = F.create_map(F.lit("value"), F.lit(None).cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    after = F.create_map(F.lit("value"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return AU.change_events(
        e.withColumns({"before": before, "after": after}), event_id=F.col("event_id").cast("string"), at=F.col("ts"), event_type=F.col("type"),
        user=F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")), resource_type=F.lit("document"), resource_id=F.col("user_id").cast("string"),
        status=F.when(F.col("event_type") == "error", "failure").otherwise("success"))


@query("audit_files", f"""
SELECT event_id::varchar AS id, strftime(ts, '%Y-%m-%d') AS day, {_TYPE} AS event_type, CASE WHEN user_id % 5 <> 0 THEN user_id::varchar ELSE 'anonymous' END AS user_id,
  CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status, event_type AS value_after, 1::bigint AS n_changes FROM events""")
def audit_files(spark, sf):
    """Audit events written in two runs, one of them tried a second time, and read back."""
    base, rows = scratch_folder(spark, "audit"), _audit_rows(spark, sf)
    half = F.col("id").cast("bigint") % 2 == 0
    for run, part in (("even", half), ("odd", ~half), ("odd", ~half)):
        AU.write_jsonl(rows.filter(part), base, run)
    back = AU.read_jsonl(spark, base)
    return back.select(
        "id", day("day").alias("day"), "event_type", "user_id", "status", F.col("detail")["value"]["after"].alias("value_after"), F.size("detail").cast("bigint").alias("n_changes"))


@query("unknown_events", f"SELECT event_id::varchar AS id, event_type FROM (SELECT event_id, {_TYPE} AS event_type FROM events) WHERE event_type IN ('click', 'signup')")
def unknown_events(spark, sf):
    """Events of types that are none of the fixed ones."""
    return AU.unknown_events(_audit_rows(spark, sf)).select("id", "event_type")


# --- test reports ---------------------------------------------------------------------------------
def _write_reports(spark, sf):
    """A report per user: a suite per kind of event, whose errors are broken cases and whose values above 50 failed ones."""
    e = raw(spark, sf, "events").withColumns({"bad": F.expr("event_type = 'error'"), "off": F.expr("event_type <> 'error' AND value > 50")})
    told = F.when(F.col("bad"), F.format_string('<error message="code %d"/>', "event_id")).when(F.col("off"), F.format_string('<failure message="above %d"/>', "event_id")).otherwise("")
    case = F.format_string('<testcase name="t%d" classname="k.%s">%s</testcase>', "event_id", "event_type", told)
    suites = e.groupBy("user_id", "event_type").agg(
        F.count("*").alias("tests"), F.count_if("bad").alias("errors"), F.count_if("off").alias("failures"), F.array_join(F.array_sort(F.collect_list(case)), "").alias("cases"))
    suite = F.format_string('<testsuite name="%s" tests="%d" errors="%d" failures="%d" skipped="0" time="0.25">%s</testsuite>', "event_type", "tests", "errors", "failures", "cases")
    files = suites.groupBy("user_id").agg(F.array_join(F.collect_list(suite), "").alias("body"))
    folder = scratch_folder(spark, "reports")
    content = F.encode(F.concat(F.lit("<testsuites>"), "body", F.lit("</testsuites>")), "UTF-8")
    FI.write_files(files.select(F.format_string("u%d.xml", "user_id").alias("name"), content.alias("content")), folder).write.format("noop").mode("overwrite").save()
    return folder


def _file(c):
    return F.regexp_extract(c, r"([^/]+)$", 1)


@query("read_test_report", """
SELECT 'u' || user_id || '.xml' AS file, count(*)::bigint AS total, count(*) FILTER (event_type <> 'error' AND value > 50)::bigint AS failed, count(*) FILTER (event_type = 'error')::bigint AS errors,
  count(*) FILTER (event_type <> 'error' AND value <= 50 OR event_type <> 'error' AND value IS NULL)::bigint AS passed, (count(DISTINCT event_type) * 0.25)::double AS time_seconds FROM events GROUP BY user_id""")
def read_test_report(spark, sf):
    """Totals of the reports written from the events."""
    return RE.read_test_report(spark, _write_reports(spark, sf)).select(_file("file").alias("file"), "total", "failed", "errors", "passed", "time_seconds")


@query("failed_cases", """
SELECT 'u' || user_id || '.xml' AS file, 't' || event_id AS name, 'k.' || event_type AS classname, CASE WHEN event_type = 'error' THEN 'code ' ELSE 'above ' END || event_id AS message
FROM events WHERE event_type = 'error' OR value > 50""")
def failed_cases(spark, sf):
    """Their failed and broken cases."""
    return RE.failed_cases(RE.read_suites(spark, _write_reports(spark, sf))).withColumn("file", _file("file"))


# --- page images ----------------------------------------------------------------------------------
_PALE = "vec_id % 3 = 0"
_LEVEL = "(cast(floor(coalesce(x, 0) * 256) as bigint) % 128 + 256) % 256"


def _bitmaps(spark, sf):
    """A bitmap of two lines per vector: bright grey ones for every third vector, coloured ones for the others."""
    v = raw(spark, sf, "embeddings").filter("embedding IS NOT NULL AND size(embedding) % 4 = 0 AND size(embedding) > 0")
    byte = lambda c: f"lpad(hex({c}), 2, '0')"
    pixel = f"CASE WHEN {_PALE} THEN repeat({byte(f'220 + ({_LEVEL}) % 20')}, 3) ELSE concat({byte(_LEVEL)}, {byte(f'({_LEVEL}) * 3 % 256')}, {byte(f'({_LEVEL}) * 7 % 256')}) END"
    line = f"array_join(transform(embedding, x -> {pixel}), '')"
    little = lambda c: f"concat({byte(f'({c}) % 256')}, {byte(f'(({c}) div 256) % 256')}, {byte(f'(({c}) div 65536) % 256')}, '00')"
    size = "6 * size(embedding)"
    head = f"concat('424D', {little(f'54 + {size}')}, '00000000', '36000000', '28000000', {little('size(embedding)')}, '02000000', '01001800', '00000000', {little(size)}, repeat('00', 16))"
    return v.selectExpr("format_string('v%d.bmp', vec_id) AS name", f"unhex(concat({head}, {line}, {line})) AS content")


@query("image_features", f"""
WITH px AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 4 = 0),
lv AS (SELECT vec_id, {_LEVEL} AS l FROM px),
gray AS (SELECT vec_id, CASE WHEN {_PALE} THEN 220 + l % 20 ELSE (l * 7 % 256 * 19595 + l * 3 % 256 * 38470 + l * 7471 + 32768) // 65536 END AS g FROM lv),
f AS (SELECT vec_id, count(*) AS n, avg(g) AS m, stddev_pop(g) AS s, count(*) FILTER (g > 128) / count(*) AS white FROM gray GROUP BY vec_id)
SELECT 'v' || vec_id || '.bmp' AS name, 2 AS height, n::integer AS width, 3 AS channels, m > 180 AND s < 60 AS is_thermal, round(greatest(0.0, least(1.0, 1.0 - abs(white - 0.7) * 2)), 9)::double AS quality FROM f""")
def image_features(spark, sf):
    """Bitmaps made from the vectors, stored, decoded and measured."""
    folder = scratch_folder(spark, "images")
    FI.write_files(_bitmaps(spark, sf), folder).write.format("noop").mode("overwrite").save()
    told = IM.image_features(IM.load_images(spark, folder))
    return told.select(_file("origin").alias("name"), "height", "width", "channels", "is_thermal", F.round(num("quality"), 9).alias("quality"))


# --- streams with restarts ------------------------------------------------------------------------
@query("stream_dedupe_restarts", """
SELECT event_id::varchar AS id, 'first' AS sent, strftime(ts, '%Y-%m-%d %H:%M:%S') AS uploaded_at FROM events
UNION ALL SELECT event_id::varchar, 'expired', strftime(ts + INTERVAL 80 DAY, '%Y-%m-%d %H:%M:%S') FROM events
UNION ALL SELECT 'tick', 'tick', strftime(max(ts) + INTERVAL 66 DAY, '%Y-%m-%d %H:%M:%S') FROM events""")
def stream_dedupe_restarts(spark, sf):
    """Four runs of one stream over one checkpoint: all documents, each twice; the same again within the span; a single later one, which moves
    the watermark; and the same once more after the span, when they count as new."""
    base = scratch_folder(spark, "dedupe")
    e = raw(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("uploaded_at"))
    later = lambda df, days: df.withColumn("uploaded_at", F.col("uploaded_at") + F.make_dt_interval(F.lit(days)))
    tick = later(e.agg(F.lit("tick").alias("id"), F.max("uploaded_at").alias("uploaded_at")), 66)
    batches = {"first": e.unionByName(e), "repeat": later(e, 1), "tick": tick, "expired": later(e, 80)}
    for sent, df in batches.items():
        told = df.select("id", "uploaded_at", F.sha2("id", 256).alias("content_hash"), F.lit(sent).alias("sent"))
        told.write.mode("append").parquet(f"{base}/in")
        s = STR.stream_dedupe(spark.readStream.schema(told.schema).parquet(f"{base}/in"), "32 days")
        s.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, uploaded_at timestamp, sent string").parquet(f"{base}/rows").select("id", "sent", stamp("uploaded_at").alias("uploaded_at"))
