"""Document state: corrections, approvals, rejections, deletion, re-runs, client master data, current versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import blank_to_null

PATCHABLE = [
    "transaction_date", "vendor_name", "vendor_address", "vendor_phone", "vendor_registration_no", "total_amount",
    "subtotal_amount", "tax_amount_10", "tax_amount_8", "invoice_number", "payment_method", "account_title", "tax_category",
    "cost_center", "note",
]


def apply_corrections(docs: DataFrame, extracted: DataFrame, patches: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, extracted) after manual corrections; NULL means unchanged. Several patches of a document are folded: each
    field takes its last value by the column ``order``, or its greatest when there is none.

    A document without extracted data gets a row; patches for unknown documents are ignored. Approved documents go back
    to pending.
    """
    known = patches.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    fields = [c for c in PATCHABLE if c in patches.columns]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
    known = known.groupBy("document_id").agg(F.lit(1).alias("_n"), *[last(c).alias(c) for c in fields])
    renamed = known.select("document_id", F.lit(True).alias("_patched"), *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = extracted.join(renamed, "document_id", "full_outer")
    patched = F.coalesce(F.col("_patched"), F.lit(False))
    out = []
    for c in extracted.columns:
        if c in fields:
            out.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
        elif c == "is_manually_corrected":
            out.append((patched | F.coalesce(F.col(c), F.lit(False))).alias(c))
        elif c == "is_approved":
            out.append(F.coalesce(F.col(c), F.lit(False)).alias(c))
        else:
            out.append(F.col(c))
    touched = known.select(F.col("document_id").alias("id"), F.lit(True).alias("_touched"))
    new_docs = docs.join(touched, "id", "left").withColumn(
        "status", F.when(F.col("_touched") & (F.col("status") == "approved"), "pending").otherwise(F.col("status"))).drop("_touched")
    return new_docs, joined.select(*out)


def approve(docs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, rejected requests with a reason). ``requests``: id, approved_by, approved_at. Of several requests for
    one document the earliest counts, then the first name; the others are refused as repeated."""
    first = requests.groupBy("id").agg(F.min(F.struct(F.col("approved_at").isNull(), "approved_at", "approved_by")).alias("_r"), F.count("*").alias("_n"))
    joined = first.select("id", F.col("_r.approved_by").alias("_by"), F.col("_r.approved_at").alias("_at"), "_n").join(docs, "id", "left")
    again = first.filter("_n > 1").select("id", F.explode(F.array_repeat(F.lit("repeated"), F.expr("int(_n - 1)"))).alias("reason"))
    open_ = F.coalesce(F.col("status").isin("pending", "uploaded"), F.lit(False))
    accepted = joined.filter(open_).withColumns({
        "status": F.lit("approved"), "approved_by": F.col("_by"), "approved_at": F.col("_at")}).select(*docs.columns)
    refused = joined.filter(~open_).select("id", F.when(F.col("status").isNull(), "not_found").otherwise(
        F.concat(F.lit("not_approvable:"), F.col("status"))).alias("reason"))
    return accepted, refused.unionByName(again)


def mark_extracted_approved(extracted: DataFrame, accepted: DataFrame) -> DataFrame:
    """Set is_approved on the extracted rows of accepted documents."""
    ids = accepted.select(F.col("id").alias("document_id"), F.lit(True).alias("_ok")).distinct()
    return extracted.join(ids, "document_id", "left").withColumn(
        "is_approved", F.coalesce(F.col("_ok"), F.col("is_approved"), F.lit(False))).drop("_ok")


def auto_approve(df: DataFrame, at: Column) -> DataFrame:
    auto = F.col("confidence_tier") == "auto_confirmed"
    return df.withColumns({
        "status": F.when(auto, "approved").otherwise("pending"),
        "approved_at": F.when(auto, at),
        "approved_by": F.when(auto, F.lit("AUTO")),
    })


def reject(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Send back the requested documents. ``requests``: id, reason; without a reason the old error text stays. Several reasons for
    one document are joined in alphabetical order."""
    why = F.array_sort(F.collect_set(blank_to_null(F.col("reason"))))
    r = requests.groupBy("id").agg(F.lit(True).alias("_r"), F.nullif(F.array_join(why, "; "), F.lit("")).alias("_why"))
    return docs.join(r, "id", "left").withColumns({
        "status": F.when(F.col("_r"), "rejected").otherwise(F.col("status")),
        "processing_error": F.coalesce(F.concat(F.lit("差し戻し: "), F.col("_why")), F.col("processing_error")),
    }).drop("_r", "_why")


def reprocess(docs: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(documents to run again, child tables without their old results). ``children``: extracted, items, scans."""
    again = docs.join(ids, "id", "left_semi").withColumns({
        "status": F.lit("processing"), "processing_error": F.lit(None).cast("string"),
        "review_flags": F.lit(None).cast("array<string>"), "approved_at": F.lit(None).cast("timestamp"),
        "approved_by": F.lit(None).cast("string")})
    gone = ids.select(F.col("id").alias("document_id"))
    return again, {name: t.join(gone, "document_id", "left_anti") for name, t in children.items()}


def delete_documents(docs: DataFrame, children: dict[str, DataFrame], history: DataFrame, ids: DataFrame):
    """(documents, children, history) without the given ids; learned history stays, its document link is cleared."""
    gone = ids.select("id").distinct()
    by_doc = gone.select(F.col("id").alias("document_id"))
    kept = {name: t.join(by_doc, "document_id", "left_anti") for name, t in children.items()}
    cleared = history.join(by_doc.withColumn("_gone", F.lit(True)), "document_id", "left").withColumn(
        "document_id", F.when(F.col("_gone").isNull(), F.col("document_id"))).drop("_gone").select(*history.columns)
    return docs.join(gone, "id", "left_anti"), kept, cleared


def split_found(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids present, ids absent), each requested id once."""
    wanted, present = ids.select("id").distinct(), docs.select("id")
    return wanted.join(present, "id", "left_semi"), wanted.join(present, "id", "left_anti")


def check_bulk_size(ids: DataFrame, limit: int = 200) -> None:
    """Refuse an empty request or one above ``limit``; looks at no more than limit + 1 rows."""
    n = ids.limit(limit + 1).count()
    if n == 0:
        raise ValueError("no document ids given")
    if n > limit:
        raise ValueError(f"at most {limit} documents at a time")


def mark_exported(docs: DataFrame, fmt: str, by: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(documents now exported, their export log rows); row_count is the size of the run."""
    n = docs.agg(F.count("*")).scalar()
    log = docs.select(
        F.col("id").alias("document_id"), F.lit(fmt).alias("export_format"), F.lit(by).alias("exported_by"),
        at.alias("exported_at"), n.alias("row_count"))
    return docs.withColumn("status", F.lit("exported")), log


def upsert_clients(clients: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clients after create and update, refused requests). One request row per id; NULL means unchanged.

    A name or code that would then occur twice refuses the requests that introduced it.
    """
    fields = [c for c in clients.columns if c != "id"]
    r = requests.select("id", F.lit(True).alias("_req"), *[F.col(c).alias(f"_r_{c}") for c in fields if c in requests.columns])
    joined = clients.withColumn("_old", F.lit(True)).join(r, "id", "full_outer")
    merged = joined.select("id", F.coalesce("_req", F.lit(False)).alias("_req"), F.coalesce("_old", F.lit(False)).alias("_old"), *[
        (F.coalesce(F.col(f"_r_{c}"), F.col(c)) if c in requests.columns else F.col(c)).alias(c) for c in fields],
        *[F.col(c).alias(f"_o_{c}") for c in fields])
    clash = None
    for key in ("name", "code"):
        twice = merged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(True).alias(f"_dup_{key}"))
        merged = merged.join(twice, key, "left")
        flag = F.coalesce(F.col(f"_dup_{key}"), F.lit(False))
        clash = flag if clash is None else clash | flag
    refused = F.col("_req") & clash
    out = merged.withColumn("_refused", refused)
    kept = out.filter(~F.col("_refused") | F.col("_old")).select("id", *[
        F.when(F.col("_refused"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    return kept, out.filter("_refused").select("id", "name", "code", F.lit("duplicate_name_or_code").alias("reason"))


def current_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per key of an append-only log, as a max over a struct: it combines before the shuffle, and a key with
    very many versions never sits in one task."""
    rest = [c for c in log.columns if c not in order and c != key]
    latest = F.max_by(F.struct(*[F.col(c) for c in order + rest]), F.struct(*[F.col(c) for c in order]))
    return log.groupBy(key).agg(latest.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in log.columns if c != key])


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows). A failed row goes back to 'uploaded' with the text of its first failing check."""
    error = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks.items()])
    marked = df.withColumn("processing_error", error)
    good = marked.filter("processing_error is null")
    failed = marked.filter("processing_error is not null").withColumn("status", F.lit("uploaded"))
    return good, failed
