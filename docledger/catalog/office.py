"""Document lists, dashboards and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.catalog.base import day, num, query, stamp
from docledger.functions import scoring as S
from docledger.operators import extract as X
from docledger.operators import reports as RP
from docledger.operators import state as ST
from docledger.plans import fixtures as fx
from docledger.sources.tables import raw

K = fx.K
D, E, CL = f"({fx.DOCUMENTS_SQL})", f"({fx.EXTRACTED_SQL})", f"({fx.CLIENTS_SQL})"
AS_OF = "timestamp'2001-07-15 00:00:00'"


def _docs(spark, sf):
    """Documents with the columns the list view reads."""
    return fx.documents(spark, sf).withColumns({
        "processed_at": F.expr("uploaded_at + INTERVAL '1' MINUTE"), "arithmetic_check_ok": F.col("confidence_score") > 0.5,
        "review_flags": F.when(F.col("confidence_tier") == "needs_review", F.array(F.lit("要確認")))})


_LIST_SQL = f"""
SELECT d.id, original_filename, doc_type, status, ocr_confidence::double AS ocr_confidence, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at,
  nullif(total_amount, 0)::double AS total_amount, vendor_name, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, confidence_tier,
  nullif(confidence_score, 0)::double AS confidence_score, CASE WHEN confidence_tier = 'needs_review' THEN '要確認' ELSE '' END AS review_flags FROM {D} d LEFT JOIN {E} e ON d.id = e.document_id"""


def _shown(df):
    return df.select("id", "original_filename", "doc_type", "status", num("ocr_confidence").alias("ocr_confidence"), stamp("uploaded_at").alias("uploaded_at"),
                     num("total_amount").alias("total_amount"), "vendor_name", day("transaction_date").alias("transaction_date"), "confidence_tier",
                     num("confidence_score").alias("confidence_score"), F.array_join("review_flags", ",").alias("review_flags"))


@query("list_documents", f"{_LIST_SQL} WHERE status = 'pending' AND confidence_tier = 'needs_review'")
def list_documents(spark, sf):
    return _shown(RP.list_documents(_docs(spark, sf), fx.extracted(spark, sf), status="pending", confidence_tier="needs_review", client_id="not-a-uuid"))


@query("list_documents_all", _LIST_SQL)
def list_documents_all(spark, sf):
    return _shown(RP.list_documents(_docs(spark, sf), fx.extracted(spark, sf)))


@query("list_page", f"SELECT *, (SELECT count(*) FROM {D}) AS total FROM ({_LIST_SQL} ORDER BY d.uploaded_at DESC, d.id LIMIT 50 OFFSET 50)")
def list_page(spark, sf):
    rows, total = RP.list_page(_docs(spark, sf), fx.extracted(spark, sf), 2, 50)
    return _shown(rows).withColumn("total", total.scalar())


@query("list_page_after", f"""{_LIST_SQL} WHERE d.uploaded_at <= timestamp'2000-01-01 12:00:00' AND NOT (d.uploaded_at = timestamp'2000-01-01 12:00:00' AND d.id <= 'a')
ORDER BY d.uploaded_at DESC, d.id LIMIT 50""")
def list_page_after(spark, sf):
    return _shown(RP.page_after(RP.list_documents(_docs(spark, sf), fx.extracted(spark, sf)), "2000-01-01 12:00:00", "a"))


@query("recent_documents", f"SELECT id, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at FROM {D} d ORDER BY d.uploaded_at DESC, id LIMIT 10")
def recent_documents(spark, sf):
    return RP.recent(fx.documents(spark, sf)).select("id", stamp("uploaded_at").alias("uploaded_at"))


def _logs(spark, sf):
    exported = fx.documents(spark, sf).filter("status = 'exported'")
    return exported.select(F.col("id").alias("document_id"), F.lit("freee").alias("export_format"), F.col("uploaded_at").alias("exported_at"),
                           F.lit(1).cast("bigint").alias("row_count"))


@query("document_detail", f"""
SELECT d.id, d.status, (e.document_id IS NOT NULL) AS has_extracted, nullif(e.total_amount, 0)::double AS total_amount, coalesce(i.n, 0)::bigint AS items, coalesce(i.amt, 0)::double AS item_total,
  CASE WHEN d.status = 'exported' THEN 1 ELSE 0 END::bigint AS logs FROM {D} d LEFT JOIN {E} e ON e.document_id = d.id
LEFT JOIN (SELECT md5({fx.s('l_orderkey')}) AS did, count(*) AS n, sum({fx.ITEM_COLUMNS['amount']}) AS amt FROM lineitem GROUP BY 1) i ON i.did = d.id""")
def document_detail(spark, sf):
    d = RP.document_detail(_docs(spark, sf), fx.extracted(spark, sf), fx.line_items(spark, sf), _logs(spark, sf))
    total = F.reduce("line_items", F.lit(0.0), lambda a, x: a + x["amount"].cast("double"))
    return d.select("id", "status", F.col("extracted").isNotNull().alias("has_extracted"), num("extracted.total_amount").alias("total_amount"),
                    F.size("line_items").cast("bigint").alias("items"), total.alias("item_total"), F.size("export_logs").cast("bigint").alias("logs"))


@query("falsy_to_null", f"SELECT document_id, nullif(total_amount, 0)::double AS total_amount FROM {E}")
def falsy_to_null(spark, sf):
    return fx.extracted(spark, sf).select("document_id", num(F.nullif("total_amount", F.lit(0))).alias("total_amount"))


@query("needs_review_view", f"SELECT id, confidence_tier FROM {D} WHERE confidence_tier IN ('needs_review', 'manual_input')")
def needs_review_view(spark, sf):
    return RP.needs_review_view(fx.documents(spark, sf)).select("id", "confidence_tier")


@query("review_counts", f"SELECT count(*) FILTER (confidence_tier = 'auto_confirmed') AS auto, count(*) FILTER (confidence_tier IN ('needs_review', 'manual_input')) AS review FROM {D}")
def review_counts(spark, sf):
    return RP.review_counts(fx.documents(spark, sf))


_URGENT = f"SELECT {fx.ID} AS id FROM orders WHERE o_orderpriority = '1-URGENT'"


def urgent_ids(spark, sf):
    return raw(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr(f"{fx.ID} AS id")


@query("exportable", f"SELECT id FROM {D} WHERE status = 'approved' AND id IN ({_URGENT})")
def exportable(spark, sf):
    return RP.exportable(fx.documents(spark, sf), urgent_ids(spark, sf)).select("id")


@query("active_clients", f"SELECT id, name, code, accounting_software, fiscal_year_end FROM {CL} WHERE is_active")
def active_clients(spark, sf):
    return RP.active_clients(fx.clients(spark, sf))


@query("ledger_search", f"""SELECT document_id, vendor_name, total_amount::double AS total_amount FROM {E}
WHERE transaction_date BETWEEN date'1997-01-01' AND date'1998-12-31' AND total_amount BETWEEN 10000 AND 300000 AND contains(lower(replace(vendor_name, ' ', '')), '東京電力1')""")
def ledger_search(spark, sf):
    import datetime as dt

    hits = RP.ledger_search(fx.extracted(spark, sf), dt.date(1997, 1, 1), dt.date(1998, 12, 31), 10000, 300000, "東京電力 １")
    return hits.select("document_id", "vendor_name", num("total_amount").alias("total_amount"))


_LABEL = lambda col, table, default: f"CASE {col} {' '.join(f'WHEN {fx.q(k)} THEN {fx.q(v)}' for k, v in table.items())} ELSE {default} END"


@query("labels", f"""SELECT id, {_LABEL('doc_type', RP.C.DOC_TYPE_LABELS, 'doc_type')} AS type_label, {_LABEL('status', RP.C.STATUS_LABELS, 'status')} AS status_label,
  {_LABEL('confidence_tier', RP.C.TIER_MESSAGES, "'処理完了'")} AS message FROM {D}""")
def labels(spark, sf):
    return fx.documents(spark, sf).select(
        "id", RP.label_doc_type(F.col("doc_type")).alias("type_label"), RP.label_status(F.col("status")).alias("status_label"),
        RP.label_tier(F.col("confidence_tier")).alias("message"))


@query("display_strings", f"""SELECT document_id, coalesce('￥' || format('{{:,}}', round(total_amount, 0)::bigint), '—') AS amount, coalesce(strftime(transaction_date, '%Y/%m/%d'), '—') AS day FROM {E}""")
def display_strings(spark, sf):
    return fx.extracted(spark, sf).select(
        "document_id", RP.format_currency(F.col("total_amount")).alias("amount"), RP.format_date(F.col("transaction_date")).alias("day"))


# --- joins ----------------------------------------------------------------------------------------
@query("join_extracted", f"SELECT id, status, vendor_name FROM {D} d LEFT JOIN {E} e ON d.id = e.document_id")
def join_extracted(spark, sf):
    return fx.documents(spark, sf).join(fx.extracted(spark, sf).withColumnRenamed("document_id", "id"), "id", "left").select("id", "status", "vendor_name")


@query("join_items", f"""SELECT d.id, count(i.did)::bigint AS items FROM {D} d LEFT JOIN (SELECT md5({fx.s('l_orderkey')}) AS did FROM lineitem) i ON i.did = d.id GROUP BY d.id""")
def join_items(spark, sf):
    out = RP.with_children(fx.documents(spark, sf), fx.line_items(spark, sf), _logs(spark, sf))
    return out.select("id", F.size("line_items").cast("bigint").alias("items"))


# --- dashboards -----------------------------------------------------------------------------------
@query("status_breakdown", f"SELECT status, count(*) AS documents FROM {D} GROUP BY status")
def status_breakdown(spark, sf):
    return RP.status_breakdown(fx.documents(spark, sf))


@query("doc_type_breakdown", f"""SELECT doc_type, {_LABEL('doc_type', RP.C.DOC_TYPE_LABELS, 'doc_type')} AS label, count(*) AS documents,
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 6) AS share_percent FROM {D} GROUP BY doc_type""")
def doc_type_breakdown(spark, sf):
    return RP.doc_type_breakdown(fx.documents(spark, sf)).withColumn("share_percent", F.round("share_percent", 6))


@query("monthly_uploads", f"SELECT count(*) FILTER (uploaded_at >= date_trunc('month', {AS_OF})) AS monthly_upload_count FROM {D}")
def monthly_uploads(spark, sf):
    return fx.documents(spark, sf).agg(RP.monthly_uploads(F.expr(AS_OF)).alias("monthly_upload_count"))


_APPROVED_SUM = f"SELECT coalesce(sum(total_amount), 0)::double AS total_approved_amount FROM {E} e JOIN {D} d ON d.id = e.document_id WHERE d.status = 'approved'"


@query("approved_amount", _APPROVED_SUM)
def approved_amount(spark, sf):
    return RP.approved_amount(fx.documents(spark, sf), fx.extracted(spark, sf)).select(num("total_approved_amount").alias("total_approved_amount"))


@query("dashboard", f"""SELECT (SELECT count(*) FILTER (uploaded_at >= date_trunc('month', {AS_OF})) FROM {D}) AS monthly_upload_count, ({_APPROVED_SUM}) AS total_approved_amount""")
def dashboard(spark, sf):
    return RP.dashboard(fx.documents(spark, sf), fx.extracted(spark, sf), F.expr(AS_OF)).withColumn("total_approved_amount", num("total_approved_amount"))


def _stats_sql(docs: str) -> str:
    return f"""
SELECT c.id AS client_id, count(d.client_id) AS total_documents, count(*) FILTER (confidence_tier = 'auto_confirmed') AS auto_confirmed,
  count(*) FILTER (confidence_tier = 'needs_review') AS needs_review,
  count(d.client_id) - count(*) FILTER (confidence_tier = 'auto_confirmed') - count(*) FILTER (confidence_tier = 'needs_review') AS manual_input,
  round(count(*) FILTER (confidence_tier = 'auto_confirmed')::double / greatest(count(d.client_id), 1) * 100, 1) AS auto_rate
FROM {CL} c LEFT JOIN {docs} d ON d.client_id = c.id GROUP BY c.id"""


@query("client_stats", _stats_sql(D))
def client_stats(spark, sf):
    return RP.client_stats(fx.clients(spark, sf), fx.documents(spark, sf))


_NO_DATE = f"({K} % 8 = 5 AND month(o_orderdate) = 2 AND day(o_orderdate) = 29)"
_TEXT_TIER = f"""(SELECT {fx.CLIENT} AS client_id, CASE WHEN {_NO_DATE} THEN 'needs_review' ELSE 'auto_confirmed' END AS confidence_tier FROM orders)"""


@query("client_stats_from_text", _stats_sql(_TEXT_TIER))
def client_stats_from_text(spark, sf):
    """Receipts as text, read back, scored, counted per client."""
    f = X.extract_fields(fx.receipts(spark, sf), "text", fx.AS_OF).select("doc_id", "client_id", "fields.*")
    return RP.client_stats(fx.clients(spark, sf), S.score_documents(f, model_conf=F.lit(0.8)))


@query("batch_progress", f"""
WITH j AS (SELECT DISTINCT 'job' || {fx.s('c_custkey % 50')} AS id FROM customer),
p AS (SELECT batch_job_id, count(*) AS n, count(*) FILTER (status IN ('pending', 'approved', 'rejected', 'exported')) AS d,
  count(*) FILTER (processing_error IS NOT NULL AND status = 'uploaded') AS f FROM {D} WHERE batch_job_id IS NOT NULL GROUP BY 1)
SELECT id AS job_id, '一括OCR ' || id AS job_name, coalesce(n, 0) AS total_files, coalesce(d, 0) AS processed_files, coalesce(f, 0) AS failed_files,
  floor(coalesce(d, 0)::double / greatest(coalesce(n, 0), 1) * 100)::bigint AS progress_percent,
  CASE WHEN coalesce(n, 0) = 0 THEN 'pending' WHEN coalesce(d, 0) + coalesce(f, 0) >= n THEN 'completed' ELSE 'running' END AS status FROM j LEFT JOIN p ON p.batch_job_id = j.id""")
def batch_progress(spark, sf):
    jobs = raw(spark, sf, "customer").selectExpr("'job' || cast(c_custkey % 50 as string) AS id").distinct().withColumn("job_name", F.concat(F.lit("一括OCR "), "id"))
    return RP.batch_progress(jobs, fx.documents(spark, sf))


@query("selection_total", f"SELECT count(*) AS documents, coalesce(sum(total_amount), 0)::double AS total_amount FROM {E} WHERE document_id IN ({_URGENT})")
def selection_total(spark, sf):
    return RP.selection_total(fx.extracted(spark, sf), urgent_ids(spark, sf)).withColumn("total_amount", num("total_amount"))


@query("monthly_volume", f"""SELECT strftime(date_trunc('month', uploaded_at), '%Y-%m-%d') AS month, count(*) AS documents, month(date_trunc('month', uploaded_at)) IN (2, 3) AS is_peak,
  count(*) > 500 AS over_target FROM {D} GROUP BY date_trunc('month', uploaded_at)""")
def monthly_volume(spark, sf):
    return RP.monthly_volume(fx.documents(spark, sf)).withColumn("month", day("month"))


@query("tag_job_names", f"SELECT DISTINCT strftime(uploaded_at, '%m') AS m, CASE WHEN month(uploaded_at) IN (2, 3) THEN 'job [繁忙期]' ELSE 'job' END AS name FROM {D}")
def tag_job_names(spark, sf):
    d = fx.documents(spark, sf)
    return d.select(F.date_format("uploaded_at", "MM").alias("m"), RP.tag_job_name(F.lit("job"), F.col("uploaded_at")).alias("name")).distinct()


# --- state ----------------------------------------------------------------------------------------
_PATCH_SQL = f"""SELECT {fx.ID} AS document_id, '訂正商店' AS vendor_name, CASE WHEN o_orderstatus = 'F' THEN 999 END AS total_amount FROM orders WHERE o_orderpriority = '1-URGENT'"""


def _patches(spark, sf):
    o = raw(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.selectExpr(f"{fx.ID} AS document_id", "'訂正商店' AS vendor_name", "cast(CASE WHEN o_orderstatus = 'F' THEN 999 END as decimal(14,2)) AS total_amount")


@query("apply_corrections", f"""
WITH p AS ({_PATCH_SQL})
SELECT d.id, CASE WHEN p.document_id IS NOT NULL AND d.status = 'approved' THEN 'pending' ELSE d.status END AS status, coalesce(p.vendor_name, e.vendor_name) AS vendor_name,
  coalesce(p.total_amount, e.total_amount)::double AS total_amount, p.document_id IS NOT NULL AS corrected FROM {D} d
JOIN (SELECT * FROM {E} WHERE vendor_name IS NOT NULL UNION ALL BY NAME SELECT document_id FROM p WHERE document_id IN (SELECT document_id FROM {E} WHERE vendor_name IS NULL)) e ON e.document_id = d.id
LEFT JOIN p ON p.document_id = d.id""")
def apply_corrections(spark, sf):
    docs, extracted = ST.apply_corrections(fx.documents(spark, sf), fx.extracted(spark, sf).filter("vendor_name is not null"), _patches(spark, sf))
    return docs.select("id", "status").join(extracted.withColumnRenamed("document_id", "id"), "id").select(
        "id", "status", "vendor_name", num("total_amount").alias("total_amount"), F.col("is_manually_corrected").alias("corrected"))


def _approval_requests(spark, sf):
    ghosts = raw(spark, sf, "customer").selectExpr("md5('missing' || cast(c_custkey as string)) AS id")
    ids = fx.documents(spark, sf).select("id").unionByName(ghosts)
    return ids.withColumns({"approved_by": F.lit("tanaka"), "approved_at": F.expr("timestamp'2001-08-02 09:00:00'")})


@query("approve_accepted", f"SELECT id, 'approved' AS status, 'tanaka' AS approved_by FROM {D} WHERE status IN ('pending', 'uploaded')")
def approve_accepted(spark, sf):
    return ST.approve(fx.documents(spark, sf), _approval_requests(spark, sf))[0].select("id", "status", "approved_by")


@query("approve_refused", f"""SELECT id, 'not_approvable:' || status AS reason FROM {D} WHERE status NOT IN ('pending', 'uploaded')
UNION ALL SELECT md5('missing' || {fx.s('c_custkey')}), 'not_found' FROM customer""")
def approve_refused(spark, sf):
    return ST.approve(fx.documents(spark, sf), _approval_requests(spark, sf))[1]


@query("mark_extracted_approved", f"SELECT document_id, d.status IN ('pending', 'uploaded') AS is_approved FROM {E} e JOIN {D} d ON d.id = e.document_id")
def mark_extracted_approved(spark, sf):
    accepted, _ = ST.approve(fx.documents(spark, sf), _approval_requests(spark, sf))
    return ST.mark_extracted_approved(fx.extracted(spark, sf), accepted).select("document_id", "is_approved")


@query("auto_approve", f"""SELECT id, CASE WHEN confidence_tier = 'auto_confirmed' THEN 'approved' ELSE 'pending' END AS status,
  CASE WHEN confidence_tier = 'auto_confirmed' THEN 'AUTO' END AS approved_by FROM {D}""")
def auto_approve(spark, sf):
    return ST.auto_approve(fx.documents(spark, sf), F.expr(AS_OF)).select("id", "status", "approved_by")


@query("reject", f"""
WITH r AS (SELECT {fx.ID} AS id, CASE WHEN o_orderstatus = 'F' THEN '不鮮明' ELSE '' END AS reason FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT d.id, CASE WHEN r.id IS NOT NULL THEN 'rejected' ELSE status END AS status, coalesce('差し戻し: ' || nullif(reason, ''), processing_error) AS processing_error FROM {D} d LEFT JOIN r USING (id)""")
def reject(spark, sf):
    r = raw(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr(f"{fx.ID} AS id", "CASE WHEN o_orderstatus = 'F' THEN '不鮮明' ELSE '' END AS reason")
    return ST.reject(fx.documents(spark, sf), r).select("id", "status", "processing_error")


@query("reprocess", f"""SELECT 'document' AS kind, id, 'processing' AS status FROM {D} WHERE id IN ({_URGENT})
UNION ALL SELECT 'extracted', document_id, NULL FROM {E} WHERE document_id NOT IN ({_URGENT})""")
def reprocess(spark, sf):
    again, kept = ST.reprocess(fx.documents(spark, sf), {"extracted": fx.extracted(spark, sf), "items": fx.line_items(spark, sf)}, urgent_ids(spark, sf))
    return again.select(F.lit("document").alias("kind"), "id", "status").unionByName(
        kept["extracted"].select(F.lit("extracted").alias("kind"), F.col("document_id").alias("id"), F.lit(None).cast("string").alias("status")))


def _delete_ids(spark, sf):
    ghosts = raw(spark, sf, "customer").selectExpr("md5('missing' || cast(c_custkey as string)) AS id")
    u = urgent_ids(spark, sf)
    return u.unionByName(u).unionByName(ghosts)


@query("delete_cascade", f"""
SELECT 'documents' AS name, count(*) AS kept, 0::bigint AS cleared FROM {D} WHERE id NOT IN ({_URGENT})
UNION ALL SELECT 'extracted', count(*), 0 FROM {E} WHERE document_id NOT IN ({_URGENT})
UNION ALL SELECT 'items', count(*), 0 FROM lineitem WHERE md5({fx.s('l_orderkey')}) NOT IN ({_URGENT})
UNION ALL SELECT 'history', count(*), count(*) FILTER (document_id IN ({_URGENT})) FROM ({fx.HISTORY_SQL})""")
def delete_cascade(spark, sf):
    docs, children, history = ST.delete_documents(
        fx.documents(spark, sf), {"extracted": fx.extracted(spark, sf), "items": fx.line_items(spark, sf)}, fx.history(spark, sf), _delete_ids(spark, sf))
    count = lambda df, name, cleared: df.agg(F.lit(name).alias("name"), F.count("*").alias("kept"), cleared.alias("cleared"))
    none = F.lit(0).cast("bigint")
    return count(docs, "documents", none).unionByName(count(children["extracted"], "extracted", none)).unionByName(
        count(children["items"], "items", none)).unionByName(count(history, "history", F.count_if(F.col("document_id").isNull())))


@query("bulk_delete_split", f"""SELECT id, true AS found FROM ({_URGENT}) UNION ALL SELECT md5('missing' || {fx.s('c_custkey')}), false FROM customer""")
def bulk_delete_split(spark, sf):
    found, absent = ST.split_found(fx.documents(spark, sf), _delete_ids(spark, sf))
    return found.withColumn("found", F.lit(True)).unionByName(absent.withColumn("found", F.lit(False)))


@query("mark_exported", f"SELECT id AS document_id, 'freee' AS export_format, (SELECT count(*) FROM {D} WHERE status = 'approved') AS row_count FROM {D} WHERE status = 'approved'")
def mark_exported(spark, sf):
    _, log = ST.mark_exported(RP.exportable(fx.documents(spark, sf)), "freee", "staff", F.expr(AS_OF))
    return log.select("document_id", "export_format", "row_count")


_REQ_SQL = f"""SELECT md5('client' || {fx.s('c_custkey')}) AS id, CASE WHEN c_nationkey = 3 THEN 'New ' || c_name END AS name,
  CASE WHEN c_nationkey = 4 THEN 'C0' END AS code FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT md5('newclient' || {fx.s('s_suppkey')}), s_name, 'S' || {fx.s('s_suppkey')} FROM supplier"""


def _client_requests(spark, sf):
    c, s_ = raw(spark, sf, "customer"), raw(spark, sf, "supplier")
    a = c.filter("c_mktsegment = 'BUILDING'").selectExpr(
        f"md5('client' || {fx.s('c_custkey')}) AS id", "CASE WHEN c_nationkey = 3 THEN 'New ' || c_name END AS name", "CASE WHEN c_nationkey = 4 THEN 'C0' END AS code")
    return a.unionByName(s_.selectExpr(f"md5('newclient' || {fx.s('s_suppkey')}) AS id", "s_name AS name", f"'S' || {fx.s('s_suppkey')} AS code"))


_UPSERT_CTE = f"""
WITH c AS (SELECT id, name, code FROM {CL}), r AS ({_REQ_SQL}),
m AS (SELECT id, coalesce(r.name, c.name) AS name, coalesce(r.code, c.code) AS code, r.id IS NOT NULL AS req, c.id IS NOT NULL AS old, c.name AS oname, c.code AS ocode FROM c FULL JOIN r USING (id)),
x AS (SELECT *, req AND ((name IS NOT NULL AND count(*) OVER (PARTITION BY name) > 1) OR (code IS NOT NULL AND count(*) OVER (PARTITION BY code) > 1)) AS refused FROM m)""".replace(
    "SELECT id, coalesce(r.name", "SELECT coalesce(c.id, r.id) AS id, coalesce(r.name").replace("c FULL JOIN r USING (id)", "c FULL JOIN r ON c.id = r.id")


@query("upsert_clients", f"{_UPSERT_CTE} SELECT id, CASE WHEN refused THEN oname ELSE name END AS name, CASE WHEN refused THEN ocode ELSE code END AS code FROM x WHERE NOT refused OR old")
def upsert_clients(spark, sf):
    return ST.upsert_clients(fx.clients(spark, sf), _client_requests(spark, sf))[0].select("id", "name", "code")


@query("upsert_clients_refused", f"{_UPSERT_CTE} SELECT id, name, code, 'duplicate_name_or_code' AS reason FROM x WHERE refused")
def upsert_clients_refused(spark, sf):
    return ST.upsert_clients(fx.clients(spark, sf), _client_requests(spark, sf))[1]


@query("current_state", """
SELECT l_orderkey AS id, l_linenumber::bigint AS version, l_returnflag AS status, l_quantity AS quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def current_state(spark, sf):
    log = raw(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("version"), F.col("l_shipdate").alias("at"), "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("quantity"))
    return ST.current_state(log, "id", ["version", "at", "l_partkey", "l_suppkey"]).select("id", "version", "status", "quantity")


@query("quarantine", f"""SELECT id, CASE WHEN file_size_bytes < 5000 THEN 'empty file' WHEN mime_type = 'image/heic' THEN 'unsupported type' END AS processing_error,
  CASE WHEN file_size_bytes < 5000 OR mime_type = 'image/heic' THEN 'uploaded' ELSE status END AS status FROM {D}""")
def quarantine(spark, sf):
    good, failed = ST.quarantine(fx.documents(spark, sf), {"empty file": F.col("file_size_bytes") < 5000, "unsupported type": F.col("mime_type") == "image/heic"})
    return good.unionByName(failed).select("id", "processing_error", "status")


