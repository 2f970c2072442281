"""From recognised text and engine replies to stored, scored documents, as one declared plan with two written stages.

A document that cannot be read is no reason to stop: `processing_error` is a column that every stage carries and adds to. Stages
hold back their work from rows with an error, and the finished rows are split once, at the end. The first error of a row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import registration
from docledger.functions.classify import classify_documents, final_confidence, final_doc_type
from docledger.functions.pii import mask_when_required
from docledger.functions.scoring import score_documents
from docledger.operators.extract import FIELD_NAMES, extract_fields, item_rows, prefer_source
from docledger.operators.retention import scan_timestamp_rows
from docledger.operators.rules import apply_suggestion, suggest_accounts
from docledger.operators.state import auto_approve
from docledger.session import keep
from docledger.sources.engines import read_model_json

NO_ORIGINAL = "原本ファイルが見つかりません"
UNREADABLE_REPLY = "モデルの応答を読み取れません"
#: Columns of a document that an error leaves empty.
RESULTS = ("doc_type", "doc_type_confidence", "confidence_tier", "confidence_score", "arithmetic_check_ok", "arithmetic_diff", "review_flags", "approved_at", "approved_by", "processed_at")


def failing(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds the text of the first check that holds to ``processing_error``, where there is none yet."""
    if "processing_error" not in df.columns:
        df = df.withColumn("processing_error", F.lit(None).cast("string"))
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in checks.items()]
    return df.withColumn("processing_error", F.coalesce(F.col("processing_error"), *found))


def read_replies(replies: DataFrame) -> DataFrame:
    """Raw replies (id, refined_json, mapped, mapped_conf, model_json) as typed sources, one row per id: refined, mapped and
    fallback are field structs, NULL when an engine gave nothing readable; reply_error marks a model answer that is no JSON.
    An unreadable refinement is as good as none, as the mapped fields or the model are asked next."""
    df = replies
    for raw, out in (("refined_json", "refined"), ("model_json", "fallback")):
        readable = F.try_parse_json(F.nullif(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), F.lit(""))).isNotNull()
        df = read_model_json(df, raw, out).withColumn(f"{out}_ok", F.coalesce(readable, F.lit(False)))
        df = df.withColumns({out: F.when(F.col(f"{out}_ok"), F.col(out)), f"{out}_conf": F.when(F.col(f"{out}_ok"), F.col(f"{out}_confidence"))})
    r, f = F.col("refined").isNotNull(), F.col("fallback").isNotNull()
    pick = lambda name: F.when(r, F.col(f"refined_{name}")).when(f & F.col("mapped").isNull(), F.col(f"fallback_{name}"))
    asked = F.coalesce(F.col("model_json") != "", F.lit(False)) & ~r & F.col("mapped").isNull()
    return df.select(
        "id", "refined", "refined_conf", "mapped", "mapped_conf", "fallback", "fallback_conf", pick("doc_type").alias("reply_doc_type"),
        pick("tax_category").alias("reply_tax_category"), (asked & ~F.col("fallback_ok")).alias("reply_error"))


def with_replies(docs: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Documents with their replies and their first errors: no text and no reply, or a reply that cannot be read."""
    if replies is None:
        return failing(docs, {NO_ORIGINAL: F.col("ocr_raw_text").isNull()})
    df = docs.join(replies, "id", "left")
    answered = F.col("refined").isNotNull() | F.col("mapped").isNotNull() | F.col("fallback").isNotNull()
    df = failing(df, {UNREADABLE_REPLY: F.col("reply_error"), NO_ORIGINAL: F.col("ocr_raw_text").isNull() & ~answered})
    return df.withColumn("_answered", answered)


def read_fields(docs: DataFrame, as_of, mask: Column | None = None) -> DataFrame:
    """Per-document columns only, no shuffle: fields, masked text, text class, registration check.

    ``docs``: id, client_id, ocr_raw_text, and optionally model_doc_type, model_confidence, model_tax_category.
    """
    for name, kind in (("model_doc_type", "string"), ("model_confidence", "double"), ("model_tax_category", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    answered = "_answered" in docs.columns
    docs = failing(docs, {}).withColumn("ocr_raw_text", F.when(F.col("processing_error").isNull(), F.col("ocr_raw_text")))
    df = extract_fields(docs, "ocr_raw_text", as_of)
    if answered:
        df = df.withColumnRenamed("fields", "_text")
        df = prefer_source(df, "refined", "mapped", "_text", "fallback").withColumns({
            "fields": F.when(F.col("_answered"), F.col("fields")).otherwise(F.col("_text")),
            "source": F.when(F.col("_answered"), F.col("source")).otherwise("text"),
            "model_confidence": F.coalesce(F.when(F.col("_answered"), F.col("confidence_hint")), F.col("model_confidence")),
            "model_doc_type": F.coalesce("reply_doc_type", "model_doc_type"),
            "model_tax_category": F.coalesce("reply_tax_category", "model_tax_category"),
        }).drop("_text", "_answered", "confidence_hint", "pipeline_steps", "reply_doc_type", "reply_tax_category", "reply_error", *[
            f"{n}{c}" for n in ("refined", "mapped", "fallback") for c in ("", "_conf")])
    else:
        df = df.withColumn("source", F.lit("text"))
    if mask is not None:
        df = mask_when_required(df, "ocr_raw_text", mask).withColumn("ocr_raw_text", F.col("masked_text")).drop("masked_text", "mask_count", "restored_values")
    df = classify_documents(df, "ocr_raw_text")
    good = F.col("processing_error").isNull()
    df = df.withColumns({f: F.when(good, F.col(f"fields.{f}")) for f in FIELD_NAMES} | {"line_items": F.when(good, F.col("fields.line_items"))}).drop("fields")
    df = registration.apply_registration(df, "ocr_raw_text", flags_col="registration_flags")
    return df.withColumns({
        "doc_type": final_doc_type(F.col("model_doc_type"), F.col("text_doc_type")),
        "doc_type_confidence": final_confidence(F.coalesce("model_confidence", F.lit(0.0)), F.col("text_confidence")).cast("decimal(5,3)"),
        "tax_category": F.col("model_tax_category"),
    }).drop("text_doc_type", "text_confidence", "text_scores", "model_tax_category")


def score(fields: DataFrame, history: DataFrame, at: Column) -> DataFrame:
    """Rules, scoring, tier and automatic approval on the result of `read_fields`. A row with an error has no vendor and so takes
    no part in the rules; its results are emptied and it goes back to 'uploaded'."""
    df = apply_suggestion(suggest_accounts(fields, history))
    df = score_documents(
        df, doc_type="doc_type", model_conf=F.col("model_confidence"), rule_conf=F.col("suggestion.confidence"))
    df = df.withColumn("review_flags", F.concat("registration_flags", "review_flags")).drop("registration_flags")
    df = auto_approve(df, at).withColumn("processed_at", at)
    good = F.col("processing_error").isNull()
    return df.withColumns({c: F.when(good, F.col(c)) for c in RESULTS if c in df.columns} | {"status": F.when(good, F.col("status")).otherwise("uploaded")})


def split_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The rows for documents, extracted_data and line_items, and the failed documents. Failed ones keep their row among the
    documents, with status and error, and have no extracted row and no items."""
    good = scored.filter("processing_error is null")
    extracted = good.select(
        F.col("id").alias("document_id"), *FIELD_NAMES, "tax_category", "confidence_scores", F.lit(False).alias("is_manually_corrected"),
        (F.col("status") == "approved").alias("is_approved"))
    documents = scored.drop(*FIELD_NAMES, "line_items", "tax_category", "confidence_scores", "suggestion", "model_doc_type", "model_confidence")
    failed = scored.filter("processing_error is not null").select("id", "client_id", "status", "processing_error")
    return {"documents": documents, "extracted_data": extracted, "line_items": item_rows(good, "id", "line_items"), "failed": failed}


def process(
    docs: DataFrame, history: DataFrame, as_of, at: Column, mask: Column | None = None, stage: bool = True, *,
    replies: DataFrame | None = None, processed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole run: tables documents, extracted_data, line_items and failed, and scan_timestamps when ``docs`` has a
    ``compliance`` struct (see `retention.scan_compliance`) with content_hash and file_size_bytes.

    ``replies`` as from `read_replies`; ``processed`` (id, content_hash) leaves documents out that have not changed since.
    Extraction feeds both the vendor list and the final join, and four tables read the scores, so both results are written once
    to the checkpoint folder; nothing is extracted twice and a lost executor costs only its own tasks.
    """
    if processed is not None:
        docs = new_or_changed(docs, processed)
    fields = read_fields(with_replies(docs, replies), as_of, mask)
    if stage:
        fields = keep(fields, "fields", "zstd")
    scored = score(fields, history, at)
    scored = keep(scored, "scored", "zstd") if stage else scored
    scans = {}
    if "compliance" in scored.columns:
        stored = scored.filter(F.col("content_hash").isNotNull())  # recorded for every stored original, readable or not
        scans["scan_timestamps"] = scan_timestamp_rows(stored, "compliance", at, at)
        scored = scored.drop("compliance")
    return split_tables(scored) | scans


def new_or_changed(incoming: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose (id, content_hash) has not been processed yet. The hashes of an id meet its documents by id alone, so that a join by
    id that follows finds the documents, texts and all, where they are."""
    seen = processed.groupBy("id").agg(F.collect_set("content_hash").alias("_seen"))
    known = F.coalesce(F.array_contains("_seen", F.col("content_hash")), F.lit(False))
    rest = [c for c in incoming.columns if c not in ("id", "content_hash")]
    return incoming.join(seen, "id", "left").filter(~known).select("id", "content_hash", *rest)
