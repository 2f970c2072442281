"""Lists, details, dashboards and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import lookup
from docledger.functions.vendor import vendor_key
from docledger.session import keep

UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
LIST_COLUMNS = [
    "id", "original_filename", "doc_type", "status", "ocr_confidence", "uploaded_at", "processed_at", "approved_at",
    "total_amount", "vendor_name", "transaction_date", "confidence_tier", "confidence_score", "arithmetic_check_ok",
    "review_flags", "has_original_file",
]


def filter_documents(docs: DataFrame, status=None, doc_type=None, confidence_tier=None, client_id=None) -> DataFrame:
    """Equality filters; an empty one is left out, and so is a client id that is no UUID."""
    import re

    for column, value in (("status", status), ("doc_type", doc_type), ("confidence_tier", confidence_tier)):
        if value:
            docs = docs.filter(F.col(column) == value)
    if client_id and re.match(UUID, client_id):
        docs = docs.filter(F.col("client_id") == client_id)
    return docs


def list_documents(docs: DataFrame, extracted: DataFrame, **filters) -> DataFrame:
    """The list view: documents with their extracted row, zero totals and scores shown as NULL."""
    left = filter_documents(docs, **filters)
    if "has_original_file" not in left.columns:
        left = left.withColumn("has_original_file", F.lit(False))
    right = extracted.select(
        F.col("document_id").alias("id"), F.nullif("total_amount", F.lit(0)).alias("total_amount"), "vendor_name", "transaction_date")
    return left.withColumns({
        "confidence_score": F.nullif("confidence_score", F.lit(0)),
        "review_flags": F.coalesce("review_flags", F.array().cast("array<string>")),
    }).join(right, "id", "left").select(*LIST_COLUMNS)


def page(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Newest first, one page; a top-k that every task pre-selects. For deep pages use `page_after`."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size 1..200")
    return df.orderBy(F.desc("uploaded_at"), F.asc("id")).offset((number - 1) * size).limit(size)


def list_page(docs: DataFrame, extracted: DataFrame, number: int = 1, size: int = 50, **filters) -> tuple[DataFrame, DataFrame]:
    """(the page of the list view, its total as one row `total`). Documents alone decide the page, a top-k that every task pre-selects;
    only its rows, 200 at most, are then joined with what was extracted from them, which is read once and not shuffled."""
    chosen = filter_documents(docs, **filters)
    found = keep(page(chosen, number, size), "page")
    wanted = F.broadcast(found.select(F.col("id").alias("document_id")))  # a page
    rows = list_documents(found, F.broadcast(extracted.join(wanted, "document_id", "left_semi")))
    return rows.orderBy(F.desc("uploaded_at"), F.asc("id")), chosen.agg(F.count("*").alias("total"))


def page_after(df: DataFrame, uploaded_at, last_id: str, size: int = 50) -> DataFrame:
    """The page that follows a known last row; costs the same at any depth."""
    at = F.lit(uploaded_at).cast("timestamp")
    after = (F.col("uploaded_at") < at) | ((F.col("uploaded_at") == at) & (F.col("id") > last_id))
    return df.filter(after).orderBy(F.desc("uploaded_at"), F.asc("id")).limit(size)


def recent(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("uploaded_at"), F.asc("id")).limit(n)


def with_children(docs: DataFrame, items: DataFrame, logs: DataFrame) -> DataFrame:
    """Documents with item and export-log arrays; the many side is aggregated before it is joined."""
    line = F.struct("sort_order", "description", "quantity", "unit_price", "amount", "tax_rate", "account_title")
    log = F.struct("exported_at", "export_format", "row_count")
    lines = items.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("line_items"))
    history = logs.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(log)).alias("export_logs"))
    return docs.join(lines, "id", "left").join(history, "id", "left").withColumns({
        "line_items": F.coalesce("line_items", F.array().cast(lines.schema["line_items"].dataType)),
        "export_logs": F.coalesce("export_logs", F.array().cast(history.schema["export_logs"].dataType)),
    })


def document_detail(docs: DataFrame, extracted: DataFrame, items: DataFrame, logs: DataFrame) -> DataFrame:
    """Nested record per document, in bulk; zero amounts inside read as NULL."""
    amounts = {"total_amount", "subtotal_amount", "tax_amount_10", "tax_amount_8"}
    cols = [(F.nullif(c, F.lit(0)) if c in amounts else F.col(c)).alias(c) for c in extracted.columns if c != "document_id"]
    nested = extracted.select(F.col("document_id").alias("id"), F.struct(*cols).alias("extracted"))
    return with_children(docs, items, logs).join(nested, "id", "left")


def needs_review_view(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("confidence_tier").isin("needs_review", "manual_input"))


def review_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count_if(F.col("confidence_tier") == "auto_confirmed").alias("auto"),
        F.count_if(F.col("confidence_tier").isin("needs_review", "manual_input")).alias("review"))


def exportable(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    approved = docs.filter(F.col("status") == "approved")
    return approved if ids is None else approved.join(ids.select("id"), "id", "left_semi")


def active_clients(clients: DataFrame) -> DataFrame:
    return clients.filter("is_active").select("id", "name", "code", "accounting_software", "fiscal_year_end")


def ledger_search(extracted: DataFrame, date_from=None, date_to=None, amount_from=None, amount_to=None, vendor=None) -> DataFrame:
    """Search by date range, amount range and part of the vendor name; ranges reach the scan as pushed filters."""
    import re
    import unicodedata

    for column, low, high in (("transaction_date", date_from, date_to), ("total_amount", amount_from, amount_to)):
        if low is not None:
            extracted = extracted.filter(F.col(column) >= F.lit(low))
        if high is not None:
            extracted = extracted.filter(F.col(column) <= F.lit(high))
    if vendor:
        needle = re.sub(r"\s+", "", unicodedata.normalize("NFKC", vendor)).lower()
        extracted = extracted.filter(F.contains(vendor_key(F.col("vendor_name")), F.lit(needle)))
    return extracted


def force_review(col: Column) -> Column:
    return F.coalesce(col.isin(C.FORCE_REVIEW_TYPES), F.lit(False))


def label_doc_type(col: Column) -> Column:
    return lookup(col, C.DOC_TYPE_LABELS, col)


def label_status(col: Column) -> Column:
    return lookup(col, C.STATUS_LABELS, col)


def label_tier(col: Column) -> Column:
    return lookup(col, C.TIER_MESSAGES, F.lit(C.TIER_MESSAGE_DEFAULT))


def format_currency(col: Column) -> Column:
    """Whole yen with thousands separators, '—' for nothing."""
    digits = F.format_number(F.abs(F.round(col.cast("decimal(20,2)"), 0)), 0)
    signed = F.concat(F.when(F.round(col.cast("decimal(20,2)"), 0) < 0, F.lit("-")).otherwise(F.lit("")), F.lit("￥"), digits)
    return F.coalesce(signed, F.lit("—"))


def format_date(col: Column) -> Column:
    return F.coalesce(F.date_format(col, "yyyy/MM/dd"), F.lit("—"))


def status_breakdown(docs: DataFrame) -> DataFrame:
    return docs.groupBy("status").agg(F.count("*").alias("documents"))


def doc_type_breakdown(docs: DataFrame) -> DataFrame:
    """Count and share per type; the total is one number, added up from the few group rows."""
    counts = docs.groupBy("doc_type").agg(F.count("*").alias("documents"))
    total = F.sum("documents").over(Window.partitionBy())
    return counts.select(
        "doc_type", label_doc_type(F.col("doc_type")).alias("label"), "documents",
        (F.col("documents") / total * 100).alias("share_percent"))


def dashboard(docs: DataFrame, extracted: DataFrame, as_of: Column) -> DataFrame:
    """Monthly uploads and approved amount in one row."""
    monthly = docs.agg(monthly_uploads(as_of).alias("monthly_upload_count"))
    return monthly.select("*", approved_amount(docs, extracted).scalar().alias("total_approved_amount"))


def monthly_uploads(as_of: Column) -> Column:
    return F.count_if(F.col("uploaded_at") >= F.date_trunc("month", as_of))


def approved_amount(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    approved = docs.filter(F.col("status") == "approved").select(F.col("id").alias("document_id"))
    return extracted.select("document_id", "total_amount").join(approved, "document_id").agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_approved_amount"))


def client_stats(clients: DataFrame, docs: DataFrame) -> DataFrame:
    """Tier counts and automatic share per client, all clients in one pass; clients without documents show zeros."""
    per = docs.groupBy("client_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("confidence_tier") == "auto_confirmed").alias("auto_confirmed"),
        F.count_if(F.col("confidence_tier") == "needs_review").alias("needs_review"))
    zero = F.lit(0).cast("bigint")
    n = lambda c: F.coalesce(F.col(c), zero)
    return clients.select(F.col("id").alias("client_id")).join(per, "client_id", "left").select(
        "client_id", n("total_documents").alias("total_documents"), n("auto_confirmed").alias("auto_confirmed"),
        n("needs_review").alias("needs_review"),
        (n("total_documents") - n("auto_confirmed") - n("needs_review")).alias("manual_input"),
        F.round(n("auto_confirmed") / F.greatest(n("total_documents"), F.lit(1)) * 100, 1).alias("auto_rate"))


def batch_progress(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Progress per job from its documents' status; a document with an error text counts as failed."""
    failed = F.col("processing_error").isNotNull() & (F.col("status") == "uploaded")
    done = F.col("status").isin("pending", "approved", "rejected", "exported")
    per = docs.filter("batch_job_id is not null").groupBy("batch_job_id").agg(
        F.count("*").alias("n"), F.count_if(done).alias("d"), F.count_if(failed).alias("f"))
    zero = F.lit(0).cast("bigint")
    j = jobs.join(per, jobs["id"] == per["batch_job_id"], "left")
    total, processed, bad = (F.coalesce(F.col(c), zero) for c in "ndf")
    return j.select(
        F.col("id").alias("job_id"), "job_name", total.alias("total_files"), processed.alias("processed_files"), bad.alias("failed_files"),
        F.floor(processed / F.greatest(total, F.lit(1)) * 100).alias("progress_percent"),
        F.when(total == 0, "pending").when(processed + bad >= total, "completed").otherwise("running").alias("status"))


def selection_total(extracted: DataFrame, ids: DataFrame) -> DataFrame:
    chosen = extracted.select("document_id", "total_amount").join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return chosen.agg(F.count("*").alias("documents"), F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_amount"))


def monthly_volume(docs: DataFrame, target: int = C.MONTHLY_DOC_TARGET) -> DataFrame:
    month = F.trunc("uploaded_at", "month")
    return docs.groupBy(month.alias("month")).agg(F.count("*").alias("documents")).withColumns({
        "is_peak": is_peak(F.col("month")), "over_target": F.col("documents") > target})


def is_peak(date: Column) -> Column:
    return F.month(date).isin(C.PEAK_MONTHS)


def tag_job_name(name: Column, date: Column) -> Column:
    return F.when(is_peak(date), F.concat(F.coalesce(name, F.lit("")), F.lit(" [繁忙期]"))).otherwise(name)
