"""Intake from files and engine replies, and the streaming operators run over stored data."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from docledger.catalog.base import day, num, query, stamp
from docledger.plans import fixtures as fx
from docledger.operators import retention as RT
from docledger.plans.process import NO_ORIGINAL, UNREADABLE_REPLY, process, read_fields, read_replies
from docledger.session import scratch_folder
from docledger.sources import engines as EN
from docledger.sources import files as FI
from docledger.sources.tables import raw
from docledger.streaming import streams as STR

K = fx.K


# --- files ----------------------------------------------------------------------------------------
def page_files(spark, sf):
    """The pages table in the shape of a binary file listing."""
    name = "'file:/scans/p' || cast(page_id as string) || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.html' ELSE '' END"
    return raw(spark, sf, "pages").selectExpr(
        f"{name} AS path", "timestamp'2024-01-01 00:00:00' AS modificationTime", "cast(octet_length(html) as bigint) AS length", "encode(html, 'UTF-8') AS content")


_PAGE_NAME = "'p' || cast(page_id as string) || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.html' ELSE '' END"


@query("scan_files", f"""
SELECT sha256('file:/scans/' || {_PAGE_NAME} || '|' || sha256(html)) AS id, {_PAGE_NAME} AS original_filename, strlen(html)::bigint AS file_size_bytes,
  CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type, sha256(html) AS content_hash, 'job1' AS batch_job_id FROM pages""")
def scan_files(spark, sf):
    return FI.as_documents(page_files(spark, sf), job_id="job1").select("id", "original_filename", "file_size_bytes", "mime_type", "content_hash", "batch_job_id")


_STORED_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("list_files", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, true AS has_bytes, count(*) AS n_rows FROM {t}" for t in _STORED_TABLES))
def list_files(spark, sf):
    """Every stored table with its files' bytes and the rows it holds; names come from the listing, and a table may be a folder."""
    table = F.regexp_extract(F.url_decode("path"), r"/([^/]+\.parquet)(/[^/]*)?$", 1)
    listed = FI.list_files(spark, sf, "*.parquet").groupBy(table.alias("name")).agg(F.sum("length").alias("length"))
    names = [r["name"] for r in listed.select("name").collect()]  # one row per table
    counts = [spark.read.parquet(f"{sf}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    rows = reduce(lambda a, b: a.unionByName(b), counts)
    return listed.join(rows, "name").select("name", (F.col("length") > 0).alias("has_bytes"), "n_rows")


@query("filter_supported", f"SELECT {_PAGE_NAME} AS name, CASE WHEN page_id % 4 IN (2, 3) THEN 'unsupported_extension' WHEN strlen(html) > 1048576 THEN 'too_large' END AS reject_reason FROM pages")
def filter_supported(spark, sf):
    df = page_files(spark, sf).select(FI.file_name(F.col("path")).alias("name"), "length")
    ok, bad = FI.filter_supported(df, "name", "length", 1)
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("name", "reject_reason")


def _stored(spark, sf):
    """Documents with inline content, content only in the upload folder, only among the originals, broken, or nowhere; the files
    are written from the pages first and then listed."""
    p = raw(spark, sf, "pages").selectExpr("cast(page_id as string) AS id", "page_id % 5 AS form", "encode(html, 'UTF-8') AS bytes")
    folder, suffix = scratch_folder(spark, "stored"), F.lit(".png")
    for name, wanted in (("up", "form IN (1, 2)"), ("originals", "form = 3")):
        FI.write_files(p.filter(wanted).select(F.concat("id", suffix).alias("name"), F.col("bytes").alias("content")), f"{folder}/{name}").write.format("noop").mode("overwrite").save()
    docs = p.select("id", F.when(F.col("form") == 0, F.base64("bytes")).when(F.col("form") == 1, F.lit("*broken*")).alias("file_content"),
                    F.concat(F.lit("/up/"), "id", suffix).alias("file_path"), F.lit("x.png").alias("original_filename"), F.lit("image/png").alias("mime_type"))
    uploads = FI.list_files(spark, f"{folder}/up").select(F.concat(F.lit("/up/"), FI.file_name(F.col("path"))).alias("file_path"), "path")
    originals = FI.list_files(spark, f"{folder}/originals").select(FI.file_name(F.col("path")).alias("file_key"), "path")
    return docs, uploads, originals


_FORM = "CASE page_id % 5 WHEN 0 THEN 'inline' WHEN 1 THEN 'upload' WHEN 2 THEN 'upload' WHEN 3 THEN 'original' END"


@query("resolve_bytes", f"SELECT cast(page_id as string) AS id, {_FORM} AS content_source, CASE WHEN page_id % 5 < 4 THEN sha256(html) END AS hash FROM pages")
def resolve_bytes(spark, sf):
    return FI.resolve_bytes(*_stored(spark, sf)).select("id", "content_source", F.sha2("content", 256).alias("hash"))


@query("has_original_file", "SELECT cast(page_id as string) AS id, page_id % 5 < 4 AS has_original_file FROM pages")
def has_original_file(spark, sf):
    docs, up, orig = _stored(spark, sf)
    return FI.has_original_file(docs, up.select("file_path"), orig.select("file_key")).select("id", "has_original_file")


@query("backfill_content", """SELECT cast(page_id as string) AS id, CASE WHEN page_id % 5 = 1 THEN '*broken*' WHEN page_id % 5 < 4 THEN to_base64(encode(html)) END AS file_content FROM pages""")
def backfill_content(spark, sf):
    filled = FI.backfill_content(FI.resolve_bytes(*_stored(spark, sf)))
    return filled.select("id", F.regexp_replace("file_content", r"[\r\n]", "").alias("file_content"))


# --- engine replies -------------------------------------------------------------------------------
_C = lambda k: f"(({k} % 60) + 40) / 100.0"


def _lines_json(spark, sf):
    """Line-based replies: vendor, total and an even confidence per line; every eleventh document came back empty."""
    one = lambda text, conf: f"struct({text} AS text, cast({conf} as double) AS confidence, array(array(1.0D, 2.0D), array(3.0D, 4.0D)) AS bbox)"
    arr = f"array({one(fx.VENDOR, _C(K))}, {one(f'cast({fx.TOTAL} as string)', '0.5D')})"
    return raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"CASE WHEN {K} % 11 = 0 THEN '[]' ELSE to_json({arr}) END AS reply")


@query("read_ocr_words", f"""SELECT {K} AS doc_id, CASE WHEN {K} % 11 = 0 THEN '' ELSE {fx.VENDOR} || chr(10) || cast({fx.TOTAL} as string) END AS full_text,
  round(CASE WHEN {K} % 11 = 0 THEN 0 ELSE ({_C(K)}::double + 0.5) / 2 END, 6)::double AS confidence, CASE WHEN {K} % 11 = 0 THEN 0 ELSE 2 END::bigint AS words FROM orders""")
def read_ocr_words(spark, sf):
    out = EN.read_ocr_words(_lines_json(spark, sf), "reply")
    return out.select("doc_id", "ocr.full_text", F.round("ocr.confidence", 6).alias("confidence"), F.size("ocr.words").cast("bigint").alias("words"))


def _pages_json(spark, sf):
    """Page trees with one word per page block; a zero confidence stands for an unknown one."""
    word = lambda text, conf: (
        f"struct(array(struct({text} AS text), struct('!' AS text)) AS symbols, cast({conf} as double) AS confidence, struct(array(struct(1 AS x, 2 AS y)) AS vertices) AS bounding_box)")
    para = lambda words: f"struct(array({words}) AS words)"
    page = lambda words: f"struct(array(struct(array({para(words)}) AS paragraphs)) AS blocks)"
    tree = f"struct({fx.VENDOR} AS text, array({page(word(fx.VENDOR_BASE, _C(K)))}, {page(word(q_('x'), '0'))}) AS pages)"
    return raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"CASE WHEN {K} % 11 = 0 THEN '{{\"text\":\"\",\"pages\":[]}}' ELSE to_json({tree}) END AS reply")


q_ = fx.q


@query("read_ocr_pages", f"""SELECT {K} AS doc_id, CASE WHEN {K} % 11 = 0 THEN '' ELSE {fx.VENDOR} END AS full_text,
  round(CASE WHEN {K} % 11 = 0 THEN 0.8 ELSE ({_C(K)}::double + 0.8) / 2 END, 6)::double AS confidence, CASE WHEN {K} % 11 = 0 THEN '' ELSE {fx.VENDOR_BASE} || '!,x!' END AS words FROM orders""")
def read_ocr_pages(spark, sf):
    out = EN.read_ocr_pages(_pages_json(spark, sf), "reply")
    return out.select("doc_id", "ocr.full_text", F.round("ocr.confidence", 6).alias("confidence"), F.array_join(F.transform("ocr.words", lambda w: w["text"]), ",").alias("words"))


@query("pick_ocr_engine", f"""
WITH c AS (SELECT {K} AS doc_id, round(CASE WHEN {K} % 11 = 0 THEN 0 ELSE ({_C(K)}::double + 0.5) / 2 END, 6) AS c1, round(CASE WHEN {K} % 11 = 0 THEN 0.8 ELSE ({_C(K)}::double + 0.8) / 2 END, 6) AS c2 FROM orders)
SELECT doc_id, CASE WHEN c1 < 0.7 AND c2 > c1 THEN 'google' ELSE 'paddle' END AS engine, (CASE WHEN c1 < 0.7 AND c2 > c1 THEN c2 ELSE c1 END)::double AS confidence FROM c""")
def pick_ocr_engine(spark, sf):
    a = EN.read_ocr_words(_lines_json(spark, sf), "reply", "first").select("doc_id", "first")
    b = EN.read_ocr_pages(_pages_json(spark, sf), "reply", "second").select("doc_id", "second")
    p = a.join(b, "doc_id").withColumn("p", EN.pick_ocr_engine(F.col("first"), F.col("second")))
    return p.select("doc_id", "p.engine", F.round("p.confidence", 6).alias("confidence"))


def _cloud_json(spark, sf):
    """Tagged-union replies in two spellings of the field names."""
    s = lambda v, c: f"named_struct('type', 'string', 'valueString', {v}, 'confidence', {c})"
    cur = lambda v: f"named_struct('type', 'currency', 'valueCurrency', named_struct('amount', {v}), 'confidence', 0.9D)"
    date = "named_struct('type', 'date', 'valueDate', date_format(o_orderdate, 'yyyy-MM-dd'))"
    item = (f"named_struct('type', 'object', 'valueObject', named_struct('Description', {s(q_('作業'), '0.5D')}, 'Quantity', named_struct('type', 'number', 'valueNumber', 2), "
            f"'UnitPrice', {cur('50.5D')}, 'Amount', {cur('101.0D')}))")
    items = f"named_struct('type', 'array', 'valueArray', array({item}))"
    inv = f"named_struct('VendorName', {s(fx.VENDOR, '0.8D')}, 'InvoiceTotal', {cur(fx.TOTAL)}, 'TotalTax', {cur(fx.TAX)}, 'InvoiceDate', {date}, 'VendorTaxId', {s(fx.REG_NO, '0.7D')}, 'Items', {items})"
    rec = f"named_struct('VendorName', {s(q_(''), '0.1D')}, 'MerchantName', {s(fx.VENDOR, '0.8D')}, 'InvoiceTotal', named_struct('type', 'number', 'valueNumber', 0), 'Total', named_struct('type', 'number', 'valueNumber', {fx.TOTAL}), 'Tax', {cur(fx.TAX)})"
    reply = lambda f, content: f"to_json(named_struct('content', {content}, 'documents', array(named_struct('fields', {f})), 'paragraphs', array(named_struct('content', '領収'), named_struct('content', '書')), 'pages', array(1, 2)))"
    return raw(spark, sf, "orders").selectExpr(
        f"{K} AS doc_id", f"CASE {K} % 3 WHEN 0 THEN {reply(inv, q_('請求 明細'))} WHEN 1 THEN {reply(rec, q_(''))} ELSE '{{}}' END AS reply")


@query("read_cloud_ocr", f"""SELECT {K} AS doc_id, CASE {K} % 3 WHEN 0 THEN '請求 明細' WHEN 1 THEN '領収' || chr(10) || '書' ELSE '' END AS content,
  round(CASE {K} % 3 WHEN 0 THEN (0.8 + 0.9 + 0.9 + 0.7) / 4 WHEN 1 THEN (0.1 + 0.8 + 0.9) / 3 ELSE 0.75 END, 6)::double AS confidence, CASE WHEN {K} % 3 = 2 THEN 1 ELSE 2 END::bigint AS pages FROM orders""")
def read_cloud_ocr(spark, sf):
    out = EN.read_cloud_ocr(_cloud_json(spark, sf), "reply")
    return out.select("doc_id", F.col("cloud_content").alias("content"), F.round("cloud_confidence", 6).alias("confidence"), F.col("cloud_page_count").cast("bigint").alias("pages"))


@query("map_cloud_fields", f"""SELECT {K} AS doc_id, CASE WHEN {K} % 3 < 2 THEN {fx.VENDOR} END AS vendor_name, CASE WHEN {K} % 3 < 2 THEN {fx.TOTAL}::double END AS total_amount,
  CASE WHEN {K} % 3 < 2 AND {fx.TAX} > 0 THEN {fx.TAX}::double END AS tax_amount_10, CASE WHEN {K} % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS transaction_date,
  CASE WHEN {K} % 3 = 0 THEN {fx.REG_NO} END AS registration, CASE {K} % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' ELSE 'unknown' END AS doc_type,
  CASE WHEN {K} % 3 = 0 THEN '作業 2 50.50 101.00' END AS item FROM orders""")
def map_cloud_fields(spark, sf):
    out = EN.map_cloud_fields(EN.read_cloud_ocr(_cloud_json(spark, sf), "reply"))
    i = F.get("mapped.line_items", F.lit(0))
    return out.select("doc_id", "mapped.vendor_name", num("mapped.total_amount").alias("total_amount"), num("mapped.tax_amount_10").alias("tax_amount_10"),
                      day("mapped.transaction_date").alias("transaction_date"), F.col("mapped.vendor_registration_no").alias("registration"), F.col("mapped_doc_type").alias("doc_type"),
                      F.concat(i["description"], F.lit(" "), i["quantity"].cast("string"), F.lit(" "), i["unit_price"].cast("string"), F.lit(" "), i["amount"].cast("string")).alias("item"))


def _model_json(spark, sf):
    body = (f"to_json(named_struct('vendor_name', {fx.VENDOR}, 'total_amount', '¥' || {fx.s(fx.TOTAL)}, 'tax_amount_10', CASE WHEN {K} % 2 = 0 THEN -5 ELSE {fx.TAX} END, 'transaction_date', "
            f"date_format(o_orderdate, 'yyyy-MM-dd'), 'payment_method', 'null', 'doc_type', 'receipt', 'confidence_hint', CASE WHEN {K} % 4 = 0 THEN 0 ELSE 0.65 END, "
            f"'line_items', array(named_struct('description', '品', 'quantity', 3, 'unit_price', '1,000', 'amount', 3000, 'tax_rate', 0.1))))")
    return raw(spark, sf, "orders").selectExpr(
        f"{K} AS doc_id", f"CASE {K} % 5 WHEN 0 THEN 'はい、結果です: ' || {body} || ' 以上' WHEN 1 THEN '読めません' ELSE {body} END AS reply")


@query("read_model_json", f"""SELECT {K} AS doc_id, CASE WHEN {K} % 5 <> 1 THEN {fx.VENDOR} END AS vendor_name, CASE WHEN {K} % 5 <> 1 THEN {fx.TOTAL}::double END AS total_amount,
  CASE WHEN {K} % 5 <> 1 AND {K} % 2 <> 0 THEN {fx.TAX}::double END AS tax_amount_10, CASE WHEN {K} % 5 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS transaction_date,
  cast(NULL as varchar) AS payment_method, CASE WHEN {K} % 4 = 0 OR {K} % 5 = 1 THEN 0.8::double ELSE 0.65::double END AS confidence, CASE WHEN {K} % 5 <> 1 THEN 1000.0::double END AS unit_price FROM orders""")
def read_model_json(spark, sf):
    out = EN.read_model_json(_model_json(spark, sf), "reply")
    return out.select("doc_id", "model.vendor_name", num("model.total_amount").alias("total_amount"), num("model.tax_amount_10").alias("tax_amount_10"),
                      day("model.transaction_date").alias("transaction_date"), "model.payment_method", F.col("model_confidence").alias("confidence"),
                      num(F.get("model.line_items", F.lit(0))["unit_price"]).alias("unit_price"))


def _reader(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in recogniser: answers with the text's length as total."""
    reply = [f'{{"vendor_name": "reader", "total_amount": {len(t)}}}' for t in pdf["text"]]
    return pd.DataFrame({"doc_id": pdf["doc_id"], "reply": reply})


@query("extract_with_model", "SELECT doc_id, 'reader' AS vendor_name, length(text)::double AS total_amount FROM documents")
def extract_with_model(spark, sf):
    replies = EN.extract_with_model(fx.prose(spark, sf), _reader, "doc_id bigint, reply string")
    return EN.read_model_json(replies, "reply").select("doc_id", "model.vendor_name", num("model.total_amount").alias("total_amount"))


@query("processing_meta", f"""SELECT {K} AS doc_id, '["gray"]' AS steps, {K} % 2 = 0 AS thermal, CASE WHEN {K} % 3 = 0 THEN 'hybrid' END AS engine, CASE WHEN {K} % 3 = 0 THEN 6 ELSE 5 END::bigint AS keys FROM orders""")
def processing_meta(spark, sf):
    o = raw(spark, sf, "orders").selectExpr(
        f"{K} AS doc_id", "array('gray') AS steps", "0.5D AS skew_angle", f"{K} % 2 = 0 AS is_thermal", "0.9D AS quality_score", "false AS vlm_fallback",
        f"CASE WHEN {K} % 3 = 0 THEN 'hybrid' END AS ocr_engine")
    m = EN.processing_meta(o).withColumn("m", F.col("preprocessing_applied"))
    return m.select("doc_id", F.col("m")["steps"].alias("steps"), (F.col("m")["is_thermal"] == "true").alias("thermal"), F.col("m")["ocr_engine"].alias("engine"),
                    F.size("m").cast("bigint").alias("keys"))


# --- the whole run --------------------------------------------------------------------------------
def _texts(spark, sf):
    return fx.receipts(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "client_id", F.col("text").alias("ocr_raw_text"))


@query("process_fields", f"""SELECT {fx.s(K)} AS id, {fx.VENDOR} AS vendor_name, {fx.TOTAL}::double AS total_amount, CASE WHEN {K} % 7 <> 0 THEN {fx.REG_NO} END AS registration,
  CASE WHEN {K} % 7 <> 0 AND NOT {fx.REG_VALID} THEN 1 ELSE 0 END::bigint AS flags FROM orders""")
def process_fields(spark, sf):
    return read_fields(_texts(spark, sf), fx.AS_OF).select(
        "id", "vendor_name", num("total_amount").alias("total_amount"), F.col("vendor_registration_no").alias("registration"), F.size("registration_flags").cast("bigint").alias("flags"))


# documents with and without text, with replies of each engine, broken ones among them, and an earlier run's list
_REFINED = f"CASE WHEN {K} % 5 = 1 THEN CASE WHEN {K} % 10 = 6 THEN 'no reply' ELSE 'So: {{\"vendor_name\": \"R' || {fx.s(K)} || '\", \"total_amount\": \"' || {fx.s(f'1000 + {K} % 1000')} || '\"}}' END END"
_MODEL = f"CASE WHEN {K} % 5 = 3 THEN CASE WHEN {K} % 15 = 3 THEN 'sorry {{' ELSE '{{\"vendor_name\": \"V' || {fx.s(K)} || '\", \"total_amount\": 2000}}' END END"


def _run_inputs(spark, sf):
    docs = fx.receipts(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), "client_id", F.expr("CASE WHEN doc_id % 17 <> 0 THEN text END").alias("ocr_raw_text"),
        F.expr("md5(cast(doc_id as string))").alias("content_hash"), F.expr("cast(1000 + doc_id as bigint)").alias("file_size_bytes"),
        RT.scan_compliance(F.expr("cast(150 + doc_id % 100 as int)"), F.lit("rgb"), F.lit(2000), F.lit(3000), F.lit(100_000), F.lit(210.0), F.lit(297.0)).alias("compliance"))
    orders = raw(spark, sf, "orders")
    mapped = {n: F.lit(None).cast(t) for n, t in EN.FIELD_TYPES.items()} | {
        "vendor_name": F.expr(f"'M' || {fx.s(K)}"), "total_amount": F.expr(f"cast(CASE WHEN {K} % 4 <> 2 THEN 3000 END as decimal(14,2))")}
    replies = read_replies(orders.filter(f"{K} % 5 IN (1, 2, 3)").select(
        F.expr(fx.s(K)).alias("id"), F.expr(_REFINED).alias("refined_json"), F.expr(_MODEL).alias("model_json"),
        F.when(F.expr(f"{K} % 5 = 2"), F.struct(*[c.alias(n) for n, c in mapped.items()])).alias("mapped"), F.lit(0.9).alias("mapped_conf")))
    before = orders.filter(f"{K} % 23 < 2").selectExpr(f"{fx.s(K)} AS id", f"CASE WHEN {K} % 23 = 0 THEN md5({fx.s(K)}) ELSE 'old' END AS content_hash")
    return docs, replies, before


@query("process_documents", f"""
WITH d AS (SELECT {K} AS k, {fx.VENDOR} AS v, {fx.TOTAL}::double AS t, {K} % 17 = 0 AS no_text,
    CASE WHEN {K} % 5 = 1 AND {K} % 10 <> 6 THEN 'refined' WHEN {K} % 5 = 2 THEN 'mapped' WHEN {K} % 5 = 3 AND {K} % 15 <> 3 THEN 'fallback' ELSE 'text' END AS source FROM orders WHERE {K} % 23 <> 0),
e AS (SELECT *, CASE WHEN k % 15 = 3 THEN '{UNREADABLE_REPLY}' WHEN no_text AND source = 'text' THEN '{NO_ORIGINAL}' END AS error FROM d)
SELECT k::varchar AS id, CASE WHEN error IS NULL THEN source END AS source,
  CASE WHEN error IS NULL THEN CASE source WHEN 'refined' THEN 'R' || k::varchar WHEN 'mapped' THEN 'M' || k::varchar WHEN 'fallback' THEN 'V' || k::varchar ELSE v END END AS vendor_name,
  CASE WHEN error IS NULL THEN CASE source WHEN 'refined' THEN (1000 + k % 1000)::double WHEN 'fallback' THEN 2000::double WHEN 'text' THEN t
    ELSE CASE WHEN k % 4 <> 2 THEN 3000::double WHEN NOT no_text THEN t END END END AS total_amount,
  error AS processing_error, error IS NOT NULL AS uploaded_again, error IS NOT NULL AS failed, error IS NULL AS extracted, 150 + k % 100 >= 200 AS is_compliant FROM e""")
def process_documents(spark, sf):
    """The whole run, per document: chosen source and fields, failures, scan records; unchanged documents are left out."""
    docs, replies, before = _run_inputs(spark, sf)
    t = process(docs, fx.history(spark, sf), fx.AS_OF, F.expr(f"timestamp'{fx.AS_OF} 00:00:00'"), replies=replies, processed=before)
    has = lambda df, key, out: df.select(F.col(key).alias("id"), F.lit(True).alias(out))
    fields = t["extracted_data"].select(F.col("document_id").alias("id"), "vendor_name", num("total_amount").alias("total_amount"), F.lit(True).alias("extracted"))
    scans = t["scan_timestamps"].select(F.col("document_id").alias("id"), "is_compliant")
    out = t["documents"].join(fields, "id", "left").join(has(t["failed"], "id", "failed"), "id", "left").join(scans, "id", "left")
    no = F.lit(False)
    return out.select(
        "id", F.when(F.col("extracted"), F.col("source")).alias("source"), "vendor_name", "total_amount", "processing_error", (F.col("status") == "uploaded").alias("uploaded_again"),
        F.coalesce("failed", no).alias("failed"), F.coalesce("extracted", no).alias("extracted"), "is_compliant")


@query("process_tiers")
def process_tiers(spark, sf):
    """Text to scored documents against the learned history, counted."""
    tables = process(_texts(spark, sf), fx.history(spark, sf), fx.AS_OF, F.expr(f"timestamp'{fx.AS_OF} 00:00:00'"))
    return tables["documents"].groupBy("doc_type", "status", "confidence_tier").agg(F.count("*").alias("documents"), num(F.avg("confidence_score")).alias("score"))


# --- streams --------------------------------------------------------------------------------------
def _table_stream(spark, sf, name):
    """A driver table, one file or a folder of files, as a file stream. The path is a pattern, as a stream takes no single file by its name."""
    schema = raw(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.{{parquet}}")


def _to_parquet(df, spark, name, mode="append"):
    out = scratch_folder(spark, name)
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/ckpt").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("stream_intake", f"SELECT {_PAGE_NAME} AS original_filename, sha256(html) AS content_hash FROM pages")
def stream_intake(spark, sf):
    """Page files arriving as a stream, turned into documents."""
    src = _table_stream(spark, sf, "pages").selectExpr(
        f"'file:/scans/' || {_PAGE_NAME} AS path", "timestamp'2024-01-01 00:00:00' AS modificationTime", "cast(octet_length(html) as bigint) AS length", "encode(html, 'UTF-8') AS content")
    return _to_parquet(FI.as_documents(src).select("original_filename", "content_hash"), spark, "intake")


_UPLOADS = [
    "cast(event_id as string) AS id", "cast(ts as timestamp) AS uploaded_at", "sha2(cast(value as string), 256) AS content_hash",
    "CASE event_type WHEN 'error' THEN 'uploaded' WHEN 'purchase' THEN 'approved' ELSE 'pending' END AS status",
    "CASE WHEN event_type = 'error' THEN 'boom' END AS processing_error"]


@query("stream_throughput", """
SELECT * FROM (SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CASE event_type WHEN 'error' THEN 'uploaded' WHEN 'purchase' THEN 'approved' ELSE 'pending' END AS status,
  count(*) AS documents, count(*) FILTER (event_type = 'error') AS failures FROM events
  WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2)""")
def stream_throughput(spark, sf):
    """Windowed counts in append mode: a window is written once the watermark has passed it."""
    s = _table_stream(spark, sf, "events").selectExpr(*_UPLOADS)
    out = _to_parquet(STR.stream_throughput(s, window="1 hour", late="10 minutes"), spark, "throughput")
    return out.select(stamp("window_start").alias("window_start"), "status", "documents", "failures")


@query("window_throughput", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CASE event_type WHEN 'error' THEN 'uploaded' WHEN 'purchase' THEN 'approved' ELSE 'pending' END AS status,
  count(*) AS documents, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1, 2""")
def window_throughput(spark, sf):
    """The same operator over stored uploads: every window is complete."""
    s = raw(spark, sf, "events").selectExpr(*_UPLOADS)
    return STR.stream_throughput(s, window="1 hour").select(stamp("window_start").alias("window_start"), "status", "documents", "failures")


@query("stream_dedupe", "SELECT DISTINCT sha256(cast(value AS varchar)) AS content_hash FROM events")
def stream_dedupe(spark, sf):
    """One document per content hash; which of them is open, so hashes are compared."""
    s = _table_stream(spark, sf, "events").selectExpr(*_UPLOADS)
    return _to_parquet(STR.stream_dedupe(s, "1 hour").select("content_hash"), spark, "dedupe")


@query("stream_learn", f"""
SELECT client_id, vendor_name, account_title, count(*)::bigint AS use_count FROM (SELECT {fx.CLIENT} AS client_id, {fx.VENDOR} AS vendor_name, {fx.ACCOUNT} AS account_title FROM orders)
WHERE account_title IS NOT NULL GROUP BY client_id, vendor_name, account_title""")
def stream_learn(spark, sf):
    """Orders as a stream of approvals, folded per micro-batch and added up."""
    s = _table_stream(spark, sf, "orders").selectExpr(
        f"{fx.CLIENT} AS client_id", f"{fx.ID} AS document_id", f"{fx.VENDOR} AS vendor_name", f"{fx.ACCOUNT} AS account_title", f"{fx.TAX_CATEGORY} AS tax_category",
        f"{fx.PAYMENT} AS payment_method", "cast(1 as bigint) AS use_count", "o_orderdate AS last_used_at", "o_orderdate AS created_at")
    out = scratch_folder(spark, "learn")
    STR.stream_learn(s, out, f"{out}/ckpt").awaitTermination()
    increments = spark.read.parquet(f"{out}/journal_increments").drop("query", "batch")
    return STR.learned(increments.limit(0), increments).select("client_id", "vendor_name", "account_title", "use_count")


@query("stream_process", f"""
SELECT CASE WHEN ({K} % 8 = 5 AND month(o_orderdate) = 2 AND day(o_orderdate) = 29) THEN 'pending' ELSE 'approved' END AS status, count(*) AS documents FROM orders GROUP BY 1""")
def stream_process(spark, sf):
    """Receipt texts stored as parquet, read as a stream, run through the batch plan, stored, and counted."""
    out = scratch_folder(spark, "process")
    texts = _texts(spark, sf)
    texts.write.parquet(f"{out}/texts")
    s = spark.readStream.schema(texts.schema).parquet(f"{out}/texts")
    STR.stream_process(s, lambda session: fx.history(session, sf), out, f"{out}/ckpt", fx.AS_OF, F.expr(f"timestamp'{fx.AS_OF} 00:00:00'")).awaitTermination()
    return STR.read_batches(spark, out, "documents").groupBy("status").agg(F.count("*").alias("documents"))

