"""Exports, audit and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger import constants as C
from docledger.catalog.base import num, query, stamp
from docledger.operators import audit as AU
from docledger.operators import exports as EX
from docledger.operators import reports as RP
from docledger.operators import retention as RT
from docledger.plans import fixtures as fx
from docledger.sources.tables import raw

K = fx.K
D, E = f"({fx.DOCUMENTS_SQL})", f"({fx.EXTRACTED_SQL})"
_AMT = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = floor({c}) THEN cast({c}::bigint as varchar) ELSE cast({c}::decimal(20,2) as varchar) END"
_QUOTE = lambda cells: " || ',' || ".join(f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in cells)
_PAIRS = f"""
WITH p AS (SELECT d.*, e.* EXCLUDE (document_id), e.document_id, substr(d.id, 1, 8) AS no, coalesce(strftime(e.transaction_date, '%Y/%m/%d'), '') AS dt,
  coalesce(nullif(account_title, ''), '消耗品費') AS dr, CASE WHEN payment_method = '現金' THEN '現金' ELSE '未払金' END AS cr,
  (coalesce(tax_amount_10, 0) + coalesce(tax_amount_8, 0))::decimal(20,2) AS tax, coalesce(tax_amount_10, 0) > 0 AS h10, coalesce(tax_amount_8, 0) > 0 AS h8, coalesce(vendor_name, '') AS vendor
  FROM {D} d LEFT JOIN {E} e ON d.id = e.document_id WHERE d.status = 'approved')"""
_TOTAL = _AMT("total_amount")
_TAXC = lambda none: f"CASE WHEN tax <> 0 THEN {_AMT('tax')} ELSE '{none}' END"
_TXT = lambda c: f"coalesce({c}, '')"


def _lines(cells: list[str], where: str = "WHERE document_id IS NOT NULL") -> str:
    return f"{_PAIRS} SELECT id, {_QUOTE(cells)} AS line FROM p {where}"


def _approved(spark, sf):
    return RP.exportable(fx.documents(spark, sf))


def _export(spark, sf, fmt):
    return EX.export_lines(_approved(spark, sf), fx.extracted(spark, sf), fmt).select("id", "line")


_e = "''"


@query("export_freee", _lines([
    "no", "dt", "dr", "CASE WHEN h10 THEN '課税仕入10%' WHEN h8 THEN '課税仕入8%軽' ELSE '課税仕入10%' END", _TOTAL, _TAXC(""), "cr", _e, _TOTAL, _e, "vendor", "original_filename", _e, _e]))
def export_freee(spark, sf):
    return _export(spark, sf, "freee")


@query("export_money_forward", _lines([
    "dt", "dr", _e, _e, "CASE WHEN h10 THEN '課税仕入10%' ELSE '課税仕入8%' END", _TOTAL, _TAXC(""), "cr", _e, _e, _e, _TOTAL, _e, "trim(vendor || ' ' || original_filename)", "no"]))
def export_money_forward(spark, sf):
    return _export(spark, sf, "money_forward")


@query("export_yayoi", _lines([
    "'2'", "lpad(cast(voucher as varchar), 6, '0')", "'0'", "dt", "dr", _e, _e, _TOTAL, _TAXC("0"), "CASE WHEN h10 THEN '10' ELSE '11' END", "'1'", "cr", _e, _e, _TOTAL, "'0'", "'0'", "'0'",
    "vendor", _e, _e, _e, _e]).replace("FROM p WHERE", "FROM (SELECT *, row_number() OVER (ORDER BY transaction_date, id) AS voucher FROM p) WHERE"))
def export_yayoi(spark, sf):
    return _export(spark, sf, "yayoi")


@query("export_generic_csv", _lines([
    "id", "original_filename", "doc_type", "dt", "vendor", _e, _e, _TXT("vendor_registration_no"), _TXT("invoice_number"), _TOTAL, _AMT("subtotal_amount"), _AMT("tax_amount_10"),
    _AMT("tax_amount_8"), _TXT("payment_method"), _TXT("account_title"), _e, "CASE WHEN ocr_confidence <> 0 THEN cast(round(ocr_confidence, 2)::decimal(10,2) as varchar) ELSE '' END", _TXT("approved_by"),
    "coalesce(strftime(approved_at, '%Y/%m/%d %H:%M'), '')"], ""))
def export_generic_csv(spark, sf):
    plain = fx.extracted(spark, sf).withColumns({"vendor_address": F.lit(None).cast("string"), "vendor_phone": F.lit(None).cast("string")})
    return EX.export_lines(_approved(spark, sf), plain, "generic_csv").select("id", "line")


@query("voucher_numbers", f"""SELECT document_id, row_number() OVER (ORDER BY transaction_date NULLS FIRST, document_id) AS voucher FROM {E}""")
def voucher_numbers(spark, sf):
    return EX.number_rows(fx.extracted(spark, sf), "transaction_date", "document_id", "voucher").select("document_id", "voucher")


@query("voucher_numbers_without_days", f"""SELECT 'same' || document_id AS document_id, row_number() OVER (ORDER BY document_id) AS voucher FROM {E}""")
def voucher_numbers_without_days(spark, sf):
    """All rows on one missing day, with ids that start alike."""
    rows = fx.extracted(spark, sf).select(F.concat(F.lit("same"), "document_id").alias("document_id"), F.lit(None).cast("date").alias("transaction_date"))
    return EX.number_rows(rows, "transaction_date", "document_id", "voucher").select("document_id", "voucher")


@query("export_formats", " UNION ALL ".join(
    f"SELECT {fx.q(i)} AS id, {fx.q(n)} AS name, {fx.q(d)} AS description, {fx.q(e)} AS encoding, (SELECT count(*) FROM {D} WHERE status = 'approved') AS ready" for i, n, d, e in C.EXPORT_FORMATS))
def export_formats(spark, sf):
    """The catalogue with the number of documents each format would export now."""
    return EX.export_formats(spark).withColumn("ready", _approved(spark, sf).agg(F.count("*")).scalar())


_DEAL_CODES = lambda col, table, default: f"CASE {col} {' '.join(f'WHEN {fx.q(k)} THEN {v}' for k, v in table.items())} ELSE {default} END"


@query("deal_payloads", f"""{_PAIRS}, v AS (SELECT *, coalesce(strftime(transaction_date, '%Y-%m-%d'), '2026-01-15') AS dd, floor(coalesce(total_amount, 0))::bigint AS amt FROM p WHERE document_id IS NOT NULL)
SELECT id, '{{"company_id":77,"issue_date":"' || dd || '","type":"expense","due_date":"' || dd || '","amount":' || amt || ',"due_amount":' || amt || ',"payment_type":"expense","details":[{{"tax_code":' ||
 {_DEAL_CODES("coalesce(nullif(tax_category, ''), '課税仕入10%')", C.DEAL_TAX_CODES, 17)} || ',"account_item_id":' || {_DEAL_CODES("coalesce(account_title, '')", C.DEAL_ACCOUNT_CODES, 1012)} ||
 ',"amount":' || amt || ',"description":"' || substr(coalesce(vendor_name, '不明') || ' ' || original_filename, 1, 255) || '","item_id":null,"section_id":null}}],"payments":[{{"amount":' || amt ||
 ',"from_walletable_type":"account_item","from_walletable_id":' || {_DEAL_CODES("coalesce(payment_method, '')", C.DEAL_WALLETS, 1)} || ',"date":"' || dd || '"}}],"receipt_ids":[]' ||
 CASE WHEN vendor_registration_no IS NOT NULL THEN ',"qualified_invoice_status":"qualified"}}' ELSE '}}' END AS payload FROM v""")
def deal_payloads(spark, sf):
    return EX.build_deals(_approved(spark, sf), fx.extracted(spark, sf), 77, F.to_date(F.lit(fx.AS_OF)))


# --- audit ----------------------------------------------------------------------------------------
_TYPES = {"view": "document.view", "signup": "client.create", "purchase": "document.approve", "error": "auth.login_failed", "click": "document.edit"}
_TYPE_SQL = f"CASE event_type {' '.join(f'WHEN {fx.q(k)} THEN {fx.q(v)}' for k, v in _TYPES.items())} ELSE event_type END"
_USER_SQL = "CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'u' || cast(user_id as string) END"
_STATUS_SQL = "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END"


def audit_log(spark, sf):
    e = raw(spark, sf, "events")
    changes = AU.diff_maps(F.create_map(F.lit("k"), F.lit("0")), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    return AU.audit_events(
        e, event_id=F.col("event_id").cast("string"), at=F.col("ts"), event_type=F.expr(_TYPE_SQL), user=F.expr(_USER_SQL), resource_type=F.lit("document"),
        resource_id=F.col("event_id").cast("string"), status=F.expr(_STATUS_SQL), detail=changes)


_AUDIT = f"""(SELECT cast(event_id as string) AS id, ts, {_TYPE_SQL} AS event_type, coalesce({_USER_SQL}, 'anonymous') AS user_id, {_STATUS_SQL} AS status, json_extract_string(props, '$.k') AS k FROM events)"""


@query("audit_events", f"SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type, user_id, status, CASE WHEN k <> '0' THEN '0>' || k ELSE '' END AS change FROM {_AUDIT}")
def audit_events(spark, sf):
    c = F.col("detail")["k"]
    return audit_log(spark, sf).select("id", stamp("timestamp").alias("at"), "event_type", "user_id", "status",
                                       F.coalesce(F.concat(c["before"], F.lit(">"), c["after"]), F.lit("")).alias("change"))


@query("audit_report", f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, status, count(*) AS events FROM {_AUDIT} GROUP BY ALL")
def audit_report(spark, sf):
    return AU.audit_report(audit_log(spark, sf)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("audit_by_user", f"SELECT user_id, count(*) AS events, count(*) FILTER (status = 'failure') AS failures, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM {_AUDIT} GROUP BY user_id")
def audit_by_user(spark, sf):
    return AU.events_by_user(audit_log(spark, sf)).select("user_id", "events", "failures", stamp("last_seen").alias("last_seen"))


_BEFORE = f"SELECT {fx.ID} AS id, {fx.STATUS} AS status, {fx.TIER} AS tier FROM orders WHERE o_orderpriority <> '5-LOW'"
_AFTER = f"SELECT {fx.ID} AS id, CASE WHEN o_orderstatus = 'F' THEN 'exported' ELSE {fx.STATUS} END AS status, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {fx.TIER} END AS tier FROM orders WHERE o_orderpriority <> '1-URGENT'"


@query("audit_diff", f"""
WITH b AS ({_BEFORE}), a AS ({_AFTER}), j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS aid, b.id AS bid, b.status AS bs, a.status AS s, b.tier AS bt, a.tier AS t FROM b FULL JOIN a ON a.id = b.id),
x AS (SELECT id, CASE WHEN bid IS NULL THEN 'added' WHEN aid IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN bs IS DISTINCT FROM s THEN 'status:' || coalesce(bs, '-') || '>' || coalesce(s, '-') ELSE '' END AS d_status, CASE WHEN bt IS DISTINCT FROM t THEN 'tier:' || coalesce(bt, '-') || '>' || coalesce(t, '-') ELSE '' END AS d_tier FROM j)
SELECT * FROM x WHERE change <> 'changed' OR d_status <> '' OR d_tier <> ''""")
def audit_diff(spark, sf):
    o = raw(spark, sf, "orders")
    b = o.filter("o_orderpriority <> '5-LOW'").selectExpr(f"{fx.ID} AS id", f"{fx.STATUS} AS status", f"{fx.TIER} AS tier")
    a = o.filter("o_orderpriority <> '1-URGENT'").selectExpr(
        f"{fx.ID} AS id", f"CASE WHEN o_orderstatus = 'F' THEN 'exported' ELSE {fx.STATUS} END AS status", f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {fx.TIER} END AS tier")
    d = AU.diff_frames(b, a, "id")
    show = lambda f: F.when(F.map_contains_key("changes", f), F.concat(
        F.lit(f + ":"), F.coalesce(F.col("changes")[f]["before"], F.lit("-")), F.lit(">"), F.coalesce(F.col("changes")[f]["after"], F.lit("-")))).otherwise("")
    return d.select("id", "change", show("status").alias("d_status"), show("tier").alias("d_tier"))


_VERSIONS = """SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * (1 + o_custkey % 3) AS version, o_orderstatus AS status, o_orderpriority AS priority FROM orders"""


@query("version_history", f"""
WITH v AS ({_VERSIONS}) SELECT id, version, p IS NULL AS is_first, ((CASE WHEN ps IS DISTINCT FROM status THEN 1 ELSE 0 END) + (CASE WHEN pp IS DISTINCT FROM priority THEN 1 ELSE 0 END))::bigint AS changed
FROM (SELECT *, lag(id) OVER w AS p, lag(status) OVER w AS ps, lag(priority) OVER w AS pp FROM v WINDOW w AS (PARTITION BY id ORDER BY version))""")
def version_history(spark, sf):
    log = spark.sql(_VERSIONS.replace("FROM orders", "FROM {orders}"), orders=raw(spark, sf, "orders")).withColumn("version", F.col("version").cast("bigint"))
    h = AU.version_history(log, "id", "version", ["status", "priority"])
    return h.select("id", "version", "is_first", F.size("changes").cast("bigint").alias("changed"))


# --- retention ------------------------------------------------------------------------------------
# page images stand in for scans: equal html means equal bytes
_SCANS = "SELECT cast(page_id as string) AS document_id, sha256(html) AS image_hash FROM pages"


def scans(spark, sf):
    p = raw(spark, sf, "pages")
    return p.select(F.col("page_id").cast("string").alias("document_id"), RT.content_hash(F.encode("html", "UTF-8")).alias("image_hash"))


@query("content_hash", _SCANS)
def content_hash(spark, sf):
    return scans(spark, sf)


@query("verify_integrity", """
SELECT cast(page_id as string) AS document_id, CASE WHEN contains(url, '.net') THEN 'missing' WHEN contains(url, '.org') THEN 'altered' ELSE 'ok' END AS verdict FROM pages""")
def verify_integrity(spark, sf):
    now = raw(spark, sf, "pages").filter("NOT contains(url, '.net')").select(
        F.col("page_id").cast("string").alias("document_id"),
        RT.content_hash(F.encode(F.expr("CASE WHEN contains(url, '.org') THEN html || '!' ELSE html END"), "UTF-8")).alias("content_hash"))
    return RT.verify_integrity(scans(spark, sf), now).select("document_id", "verdict")


@query("save_originals", """
SELECT cast(page_id as string) AS document_id, CASE WHEN contains(url, '.net') THEN 'fresh' WHEN contains(url, '.org') THEN 'conflict' ELSE 'repeat' END AS outcome FROM pages""")
def save_originals(spark, sf):
    p = raw(spark, sf, "pages").select(F.col("page_id").cast("string").alias("document_id"), "url", F.col("html"))
    digest = lambda c: RT.content_hash(F.encode(c, "UTF-8"))
    store = p.filter("NOT contains(url, '.net')").select("document_id", digest(F.col("html")).alias("content_hash"))
    incoming = p.select("document_id", digest(F.expr("CASE WHEN contains(url, '.org') THEN html || '!' ELSE html END")).alias("content_hash"))
    parts = zip(("fresh", "repeat", "conflict"), RT.save_originals(store, incoming))
    out = None
    for name, df in parts:
        one = df.select("document_id", F.lit(name).alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


_TWINS = f"(SELECT * FROM ({_SCANS}) UNION ALL SELECT 'm' || document_id, image_hash FROM ({_SCANS}))"


@query("duplicate_originals", f"SELECT image_hash, count(*) AS copies, min(document_id) AS first_id, max(document_id) AS last_id FROM {_TWINS} GROUP BY 1 HAVING count(*) > 1")
def duplicate_originals(spark, sf):
    return RT.duplicate_originals(_with_twins(spark, sf))


@query("duplicate_members", f"SELECT image_hash, document_id, min(document_id) OVER (PARTITION BY image_hash) AS first_id FROM {_TWINS} QUALIFY count(*) OVER (PARTITION BY image_hash) > 1")
def duplicate_members(spark, sf):
    return RT.duplicate_members(_with_twins(spark, sf))


def _with_twins(spark, sf):
    """Pages, and each page once more under the id of its mirror, so that equal bytes occur under several ids."""
    s = scans(spark, sf)
    return s.unionByName(s.withColumn("document_id", F.concat(F.lit("m"), "document_id")))



_DPI, _MODE = fx.case(f"{K} % 4", ["150", "300", None, "200"]), fx.case(f"{K} % 5", ["'rgb'", "'grayscale'", "'binary'", None, "'rgb'"])
_PW = f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE 210.0 END"
_COMPLIANCE_SQL = f"""
WITH x AS (SELECT {fx.ID} AS id, {_DPI} AS dpi, {_MODE} AS mode, 1000 + {K} % 1500 AS w, 1500 + {K} % 2000 AS h, ({K} * 7919) % 200000 AS size, CASE WHEN {K} % 3 <> 0 THEN 210.0::double END AS pw, 297.0::double AS ph FROM orders),
y AS (SELECT *, CASE WHEN mode IS NULL THEN NULL WHEN dpi IS NOT NULL THEN dpi WHEN pw IS NOT NULL THEN floor(least(w / (pw / 25.4), h / (ph / 25.4)))::int END AS est FROM x)
SELECT id, est::bigint AS estimated_dpi, coalesce(mode, 'unknown') AS color_mode, mode IS NOT NULL AND coalesce(est >= 200, true) AND mode <> 'binary' AS is_compliant,
 (CASE WHEN mode IS NULL THEN 1 ELSE (CASE WHEN est < 200 THEN 1 ELSE 0 END) + (CASE WHEN mode = 'binary' THEN 1 ELSE 0 END) END)::bigint AS violations,
 (CASE WHEN mode IS NULL THEN 0 ELSE (CASE WHEN dpi IS NULL AND pw IS NULL THEN 1 ELSE 0 END) + (CASE WHEN size < 5000 THEN 1 ELSE 0 END) + (CASE WHEN pw IS NULL THEN 1 ELSE 0 END) END)::bigint AS warnings FROM y"""


def _measured(spark, sf):
    o = raw(spark, sf, "orders").selectExpr(
        f"{fx.ID} AS id", f"{_DPI} AS dpi", f"{_MODE} AS mode", f"1000 + {K} % 1500 AS w", f"1500 + {K} % 2000 AS h", f"({K} * 7919) % 200000 AS size",
        f"cast({_PW} as double) AS pw", "cast(297.0 as double) AS ph", f"{fx.CLIENT} AS client_id", f"{fx.UPLOADED} AS scanned")
    return o.withColumn("c", RT.scan_compliance(*[F.col(c) for c in ("dpi", "mode", "w", "h", "size", "pw", "ph")]))


@query("scan_compliance", _COMPLIANCE_SQL)
def scan_compliance(spark, sf):
    return _measured(spark, sf).select(
        "id", F.col("c.estimated_dpi").cast("bigint").alias("estimated_dpi"), "c.color_mode", "c.is_compliant",
        F.size("c.violations").cast("bigint").alias("violations"), F.size("c.warnings").cast("bigint").alias("warnings"))


_DEADLINE = "CASE isodow({t}) WHEN 4 THEN {t} + INTERVAL 4 DAY WHEN 5 THEN {t} + INTERVAL 4 DAY WHEN 6 THEN {t} + INTERVAL 3 DAY ELSE {t} + INTERVAL 2 DAY END"


@query("timestamp_deadline", f"SELECT id, strftime({_DEADLINE.format(t='uploaded_at')}, '%Y-%m-%d %H:%M:%S') AS deadline FROM {D}")
def timestamp_deadline(spark, sf):
    return fx.documents(spark, sf).select("id", stamp(RT.timestamp_deadline(F.col("uploaded_at"))).alias("deadline"))


_HOLIDAYS = "SELECT DISTINCT cast(date_trunc('month', o_orderdate) as date) AS holiday FROM orders"


@query("timestamp_deadline_holidays", f"""
WITH d AS (SELECT id, uploaded_at, cast(uploaded_at as date) AS dy FROM {D}), days AS (SELECT DISTINCT dy FROM d),
a AS (SELECT dy, cast(dy + k * INTERVAL 1 DAY as date) AS nd FROM days, unnest(range(1, 45)) t(k)),
n AS (SELECT dy, nd FROM a WHERE isodow(nd) < 6 AND nd NOT IN ({_HOLIDAYS}) QUALIFY row_number() OVER (PARTITION BY dy ORDER BY nd) = 2)
SELECT id, strftime(uploaded_at + date_diff('day', dy, nd) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS deadline FROM d JOIN n USING (dy)""")
def timestamp_deadline_holidays(spark, sf):
    holidays = raw(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("holiday")).distinct()
    d = fx.documents(spark, sf).select("id", "uploaded_at")
    return RT.timestamp_deadline_with_holidays(d, "uploaded_at", holidays).select("id", stamp("deadline").alias("deadline"))


@query("scan_timestamp_rows", f"""
SELECT id AS document_id, estimated_dpi, color_mode, is_compliant, coalesce(cl, 'system') AS input_user, 'substitute' AS method FROM ({_COMPLIANCE_SQL}) c JOIN (SELECT {fx.ID} AS oid, {fx.CLIENT} AS cl FROM orders) o ON o.oid = c.id""")
def scan_timestamp_rows(spark, sf):
    df = _measured(spark, sf).withColumns({"content_hash": F.sha2("id", 256), "file_size_bytes": F.col("size")})
    return RT.scan_timestamp_rows(df, "c", F.col("scanned"), F.col("scanned")).select(
        "document_id", F.col("scan_dpi").cast("bigint").alias("estimated_dpi"), "color_mode", "is_compliant", "input_user", "method")


_VERIFIED = f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE {fx.UPLOADED} + INTERVAL '1' DAY * ({K} % 7) END"


@query("late_timestamps", f"""
WITH s AS (SELECT {fx.ID} AS document_id, {fx.UPLOADED} AS t, {_VERIFIED} AS v FROM orders), x AS (SELECT *, {_DEADLINE.format(t='t')} AS dl FROM s)
SELECT document_id, strftime(dl, '%Y-%m-%d %H:%M:%S') AS deadline FROM x WHERE coalesce(v, timestamp'2001-07-15 00:00:00') > dl""")
def late_timestamps(spark, sf):
    s = raw(spark, sf, "orders").selectExpr(f"{fx.ID} AS document_id", f"{fx.UPLOADED} AS scan_datetime", f"{_VERIFIED} AS verified_datetime")
    return RT.late_timestamps(s, F.expr("timestamp'2001-07-15 00:00:00'")).select("document_id", stamp("deadline").alias("deadline"))
