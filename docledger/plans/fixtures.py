"""Bookkeeping tables and document texts derived from the star-schema tables.

The column expressions are plain SQL text that any engine reads the same way, so a checker can derive the same inputs on
its own. Everything is a projection of the whole source table; nothing is sampled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.sources.tables import raw, spread

AS_OF = "2026-01-15"
K = "o_orderkey"


def case(expr: str, values: list[str | None], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {arms} ELSE {default} END"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s(expr: str) -> str:
    return f"cast({expr} as string)"


VENDORS = [
    "セブンマート", "東京タクシー", "スターバックス金沢", "レストラン海風", "青空書店", "NTT通信サービス", "みどり薬局", "山田商店",
    "ホテル日和", "東京電力", "Amazon Market", "サンプル工業", "コクヨ文具", "ENEOS給油所", "イオンモール", "弁当デリカ",
]
VENDOR_BASE = case(f"{K} % 16", [q(v) for v in VENDORS])
VENDOR = f"({VENDOR_BASE} || ' ' || {s(f'({K} * 31) % 200')} || '号店')"
TOTAL = "cast(floor(o_totalprice) as bigint)"
TAX = "cast(floor(floor(o_totalprice) / 11.0) as bigint)"
SUB = f"({TOTAL} - {TAX})"

# --- registration number: 12 body digits and their check digit ------------------------------------
_BODY = f"lpad({s(K)}, 12, '0')"
_WSUM = " + ".join(f"cast(substr({_BODY}, {n - 1}, 1) as int) * {2 if n % 2 == 0 else 1}" for n in range(2, 14))
CHECK_DIGIT = f"(9 - ({_WSUM}) % 9)"
REG_VALID = f"({K} % 4 <> 3)"
REG_NO = f"('T' || {s(f'CASE WHEN {REG_VALID} THEN {CHECK_DIGIT} ELSE {CHECK_DIGIT} % 9 + 1 END')} || {_BODY})"

# --- card number: 15 digits and their Luhn digit --------------------------------------------------
_CARD15 = f"('4' || lpad({s(K)}, 14, '0'))"
_LUHN = " + ".join(
    (f"(2 * cast(substr({_CARD15}, {i}, 1) as int) - CASE WHEN cast(substr({_CARD15}, {i}, 1) as int) > 4 THEN 9 ELSE 0 END)")
    if i % 2 == 1 else f"cast(substr({_CARD15}, {i}, 1) as int)" for i in range(1, 16))
LUHN_DIGIT = f"((10 - ({_LUHN}) % 10) % 10)"
CARD_VALID = f"({K} % 5 <> 0)"
CARD = f"({_CARD15} || {s(f'CASE WHEN {CARD_VALID} THEN {LUHN_DIGIT} ELSE ({LUHN_DIGIT} + 1) % 10 END')})"
MY_NUMBER = f"(lpad({s(f'{K} % 10000')}, 4, '0') || '-' || lpad({s(f'({K} * 3) % 10000')}, 4, '0') || '-' || lpad({s(f'({K} * 7) % 10000')}, 4, '0'))"
ACCOUNT_NO = f"lpad({s(f'{K} % 10000000')}, 7, '0')"
EMAIL = f"('user' || {s(K)} || '@example.co.jp')"
PHONE = f"('03-' || lpad({s(f'{K} % 10000')}, 4, '0') || '-' || lpad({s(f'({K} * 7) % 10000')}, 4, '0'))"
ADDRESS = f"('〒' || lpad({s(f'{K} % 1000')}, 3, '0') || '-' || lpad({s(f'({K} * 3) % 10000')}, 4, '0') || ' 東京都中央区銀座')"

# --- office tables --------------------------------------------------------------------------------
ID = f"md5({s(K)})"
CLIENT = f"CASE WHEN {K} % 13 = 0 THEN NULL ELSE md5('client' || {s('o_custkey')}) END"
STATUS = case(f"{K} % 9", ["'uploaded'", "'processing'", "'pending'", "'approved'", "'approved'", "'rejected'", "'exported'", "'pending'", "'approved'"])
DOC_TYPE = case(f"{K} % 7", ["'receipt'", "'handwritten'", "'invoice'", "'card_statement'", "'bank_statement'", "'unknown'", "'receipt'"])
TIER = case(f"{K} % 5", ["'auto_confirmed'", "'auto_confirmed'", "'needs_review'", "'needs_review'", "'manual_input'"])
PAYMENT = case(f"{K} % 6", ["'現金'", "'クレジットカード'", "'電子マネー'", "'銀行振込'", None, "'口座引落'"])
ACCOUNT = case(f"{K} % 8", ["'消耗品費'", "'旅費交通費'", "'会議費'", "'通信費'", "'雑費'", "'外注費'", None, "'謎の科目'"])
TAX_CATEGORY = case(f"{K} % 5", ["'課税仕入10%'", "'課税仕入8%軽減'", "'非課税'", None, "'不課税'"])
UPLOADED = f"(o_orderdate + INTERVAL '1' SECOND * ({K} % 86400))"
EXTENSION = case(f"{K} % 5", ["'.jpg'", "'.pdf'", "'.PNG'", "'.heic'", "'.tiff'"])

DOCUMENT_COLUMNS = {
    "id": ID,
    "client_id": CLIENT,
    "batch_job_id": f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE 'job' || {s('o_custkey % 40')} END",
    "original_filename": f"'scan_' || {s(K)} || {EXTENSION}",
    "file_path": f"'/uploads/' || {s(f'{K} % 100')} || '/' || {s(K)} || {EXTENSION}",
    "mime_type": case(f"{K} % 5", ["'image/jpeg'", "'application/pdf'", "'image/png'", "'image/heic'", "'image/tiff'"]),
    "file_size_bytes": f"({K} * 7919) % 200000",
    "doc_type": DOC_TYPE,
    "status": STATUS,
    "ocr_confidence": f"cast(cast({K} % 101 as double) / 100 as decimal(5,3))",
    "processing_error": f"CASE WHEN {K} % 9 = 0 AND {K} % 2 = 0 THEN '原本ファイルが見つかりません' END",
    "confidence_tier": TIER,
    "confidence_score": f"cast(cast({K} % 1000 as double) / 1000 as decimal(5,3))",
    "uploaded_at": UPLOADED,
    "approved_at": f"CASE WHEN {K} % 9 IN (3, 4, 8) THEN {UPLOADED} + INTERVAL '1' HOUR END",
    "approved_by": f"CASE WHEN {K} % 9 IN (3, 4, 8) THEN {case(f'{K} % 3', [q('AUTO'), q('staff'), q('suzuki')])} END",
}
EXTRACTED_COLUMNS = {
    "document_id": ID,
    "transaction_date": "cast(o_orderdate as date)",
    "vendor_name": f"CASE WHEN {K} % 19 = 0 THEN NULL ELSE {VENDOR} END",
    "vendor_registration_no": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE {REG_NO} END",
    "total_amount": f"cast(CASE WHEN {K} % 29 = 0 THEN NULL WHEN {K} % 31 = 0 THEN 0 ELSE o_totalprice END as decimal(14,2))",
    "subtotal_amount": f"cast(CASE WHEN {K} % 4 = 0 THEN NULL ELSE {SUB} END as decimal(14,2))",
    "tax_amount_10": f"cast(CASE WHEN {K} % 10 IN (3, 7) THEN NULL ELSE {TAX} END as decimal(14,2))",
    "tax_amount_8": f"cast(CASE WHEN {K} % 10 = 7 THEN {TAX} END as decimal(14,2))",
    "invoice_number": f"CASE WHEN {K} % 3 = 1 THEN 'INV-' || {s(K)} END",
    "payment_method": PAYMENT,
    "account_title": ACCOUNT,
    "tax_category": TAX_CATEGORY,
}
EXTRACTED_EXTRA = {
    "vendor_address": ADDRESS, "vendor_phone": PHONE, "note": "cast(NULL as string)", "cost_center": "cast(NULL as string)",
    "is_manually_corrected": "false", "is_approved": "false",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


DOCUMENTS_SQL = f"SELECT {select_list(DOCUMENT_COLUMNS)} FROM orders"
EXTRACTED_SQL = f"SELECT {select_list(EXTRACTED_COLUMNS)} FROM orders"
CLIENTS_SQL = (
    f"SELECT md5('client' || {s('c_custkey')}) AS id, c_name AS name, 'C' || {s('c_custkey')} AS code, "
    "cast(c_custkey % 12 + 1 as int) AS fiscal_year_end, "
    f"{case('c_custkey % 4', [q('freee'), q('money_forward'), q('yayoi'), q('generic_csv')])} AS accounting_software, "
    "(c_custkey % 10 <> 9) AS is_active FROM customer"
)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "orders")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in DOCUMENT_COLUMNS.items()])


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in (EXTRACTED_COLUMNS | EXTRACTED_EXTRA).items()])


def clients(spark: SparkSession, sf: str) -> DataFrame:
    c = raw(spark, sf, "customer")
    c.createOrReplaceTempView("_fx_customer")
    return spark.sql(CLIENTS_SQL.replace("FROM customer", "FROM _fx_customer"))


ITEM_COLUMNS = {
    "document_id": f"md5({s('l_orderkey')})",
    "line_no": "l_linenumber",
    "description": f"'品目' || {s('l_partkey')}",
    "quantity": "cast(l_quantity as bigint)",
    "unit_price": "cast(floor(l_extendedprice / l_quantity) as bigint)",
    "amount": "cast(floor(l_extendedprice / l_quantity) as bigint) * cast(l_quantity as bigint)",
    "l_suppkey": "l_suppkey",
}


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item rows of the office tables."""
    t = raw(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()])
    return t.select(
        "document_id", F.col("line_no").alias("sort_order"), "description", F.col("quantity").cast("decimal(10,3)").alias("quantity"),
        F.col("unit_price").cast("decimal(14,2)").alias("unit_price"), F.col("amount").cast("decimal(14,2)").alias("amount"),
        F.lit("0.10").cast("decimal(5,3)").alias("tax_rate"), F.lit(None).cast("string").alias("account_title"))


HISTORY_SQL = f"""
SELECT md5('client' || {s('o_custkey')}) AS client_id, min(md5({s('o_orderkey')})) AS document_id, s_name AS vendor_name,
  {case('s_suppkey % 5', [q('外注費'), q('消耗品費'), q('修繕費'), q('雑費'), q('通信費')])} AS account_title,
  {case('s_suppkey % 4', [q('課税10%'), q('軽減8%'), q('非課税'), q('課税仕入10%')])} AS tax_category,
  cast(NULL as string) AS payment_method, count(*) AS use_count, max(l_shipdate) AS last_used_at, min(l_shipdate) AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY o_custkey, s_suppkey, s_name
"""


def history(spark: SparkSession, sf: str, client: str = f"md5('client' || {s('o_custkey')})") -> DataFrame:
    """Learned history: one row per client and supplier, use_count from the joined order lines."""
    o = _orders(spark, sf).select("o_orderkey", "o_custkey")
    li = raw(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    su = raw(spark, sf, "supplier").select("s_suppkey", "s_name")
    counted = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_suppkey").agg(
        F.min(F.unhex(F.md5(F.col("o_orderkey").cast("string")))).alias("_document"), F.count("*").alias("use_count"),
        F.max("l_shipdate").alias("last_used_at"), F.min("l_shipdate").alias("created_at"))
    return counted.join(su, counted.l_suppkey == su.s_suppkey).selectExpr(
        f"{client} AS client_id", "lower(hex(_document)) AS document_id", "s_name AS vendor_name",
        f"{case('s_suppkey % 5', [q('外注費'), q('消耗品費'), q('修繕費'), q('雑費'), q('通信費')])} AS account_title",
        f"{case('s_suppkey % 4', [q('課税10%'), q('軽減8%'), q('非課税'), q('課税仕入10%')])} AS tax_category",
        "cast(NULL as string) AS payment_method", "use_count", "last_used_at", "created_at")


# --- document texts -------------------------------------------------------------------------------
_Y = "cast(year(o_orderdate) as int)"
_M, _DAY = s("month(o_orderdate)"), s("day(o_orderdate)")
DATE_FORM = f"({K} % 8)"
DATE_TEXT = case(DATE_FORM, [
    f"'令和' || {s(f'{_Y} + 24 - 2018')} || '年' || {_M} || '月' || {_DAY} || '日'",
    f"'平成' || {s(f'{_Y} - 1988')} || '年' || {_M} || '月' || {_DAY} || '日'",
    f"{s(f'{_Y} + 24')} || '年' || {_M} || '月' || {_DAY} || '日'",
    f"{s(f'{_Y} + 24')} || '/' || {_M} || '/' || {_DAY}",
    f"{s(f'{_Y} + 24 - 2000')} || '.' || lpad({_M}, 2, '0') || '.' || lpad({_DAY}, 2, '0')",
    f"{_M} || '月' || {_DAY} || '日'",
    f"'昭和' || {s(f'{_Y} - 40 - 1925')} || '年' || {_M} || '月' || {_DAY} || '日'",
    f"'令和6年13月40日' || chr(10) || {s(f'{_Y} + 24')} || '-' || lpad({_M}, 2, '0') || '-' || lpad({_DAY}, 2, '0')",
])
VENDOR_LINE = case(f"{K} % 3", [VENDOR, f"'発行元: ' || {VENDOR}", f"'株式会社' || {VENDOR}"])


def comma(expr: str) -> str:
    """Thousands separators with plain string functions (values below one billion)."""
    t = s(expr)
    return (
        f"CASE WHEN {expr} >= 1000000 THEN {s(f'cast(floor({expr} / 1000000) as bigint)')} || ',' || substr(lpad({t}, 9, '0'), 4, 3) || ',' || substr(lpad({t}, 9, '0'), 7, 3) "
        f"WHEN {expr} >= 1000 THEN {s(f'cast(floor({expr} / 1000) as bigint)')} || ',' || substr(lpad({t}, 9, '0'), 7, 3) ELSE {t} END")


NL = " || chr(10) || "
TAX_LINE = (
    f"CASE WHEN {K} % 10 = 7 THEN '消費税 (8%) ' || ({comma(TAX)}) || '円' WHEN {K} % 10 = 3 THEN '' "
    f"WHEN {K} % 11 = 5 THEN '消費税 ' || ({comma(TAX)}) || '円' ELSE '消費税 (10%) ' || ({comma(TAX)}) || '円' END")
TOTAL_LINE = f"CASE WHEN {K} % 9 = 4 THEN '¥' || ({comma(TOTAL)}) ELSE '合計 ' || ({comma(TOTAL)}) || '円' END"
PAY_LINE = case(f"{K} % 6", ["'現金'", "'VISA'", "'PayPay'", "'振込'", "''", "'口座振替'"])
CONTACT = f"CASE WHEN {K} % 5 = 0 THEN '' ELSE {ADDRESS} || chr(10) || 'TEL ' || {PHONE} END"
REG_LINE = f"CASE WHEN {K} % 7 = 0 THEN '' ELSE '登録番号 ' || {REG_NO} END"
RECEIPT_PLAIN_SQL = NL.join([
    f"({VENDOR_LINE})", f"('発行日 ' || {DATE_TEXT})", f"({CONTACT})", f"('小計 ' || ({comma(SUB)}) || '円')", f"({TAX_LINE})", f"({TOTAL_LINE})",
    f"({PAY_LINE})", f"({REG_LINE})"])
PII_TEXT = (
    f"'個人番号: ' || {MY_NUMBER} || chr(10) || '口座番号: ' || {ACCOUNT_NO} || ' へ' || chr(10) || 'カード ' || {CARD} || chr(10) || "
    f"CASE WHEN {K} % 4 = 0 THEN '再掲 ' || {MY_NUMBER} || chr(10) ELSE '' END || '連絡 ' || {EMAIL} || ' 電話 ' || {PHONE}")


def _check_digit(k):
    """Check digit of a key's last 12 digits, as CHECK_DIGIT has it."""
    terms = [F.expr(f"{k} div {10 ** (13 - n)} % 10") * (2 if n % 2 == 0 else 1) for n in range(2, 14)]
    return F.lit(9) - reduce(lambda x, y: x + y, terms) % 9


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipt texts (doc_id, client_id, text), one per order. Values first, then lines, then the text."""
    k = F.col("k")
    o = spread(_orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).select(
        F.col(K).alias("k"), F.expr(CLIENT).alias("client_id"), F.floor("o_totalprice").cast("bigint").alias("total"),
        F.expr(VENDOR).alias("vendor"), F.lpad(F.col(K).cast("string"), 12, "0").alias("body"),
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    o = o.withColumn("tax", F.expr("(total - pmod(total, 11)) div 11"))  # as TAX, without decimals
    yen = lambda c: F.format_number(c, 0)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    o = o.withColumns({"sub_t": yen(F.col("total") - F.col("tax")), "tax_t": yen(F.col("tax")), "total_t": yen(F.col("total")), "check": _check_digit("k")})
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    kanji = lambda era, year: F.concat(F.lit(era), year.cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))
    forms = [
        kanji("令和", y - 1994), kanji("平成", y - 1988), kanji("", y + 24), F.concat_ws("/", y + 24, m, d),
        F.concat_ws(".", y - 1976, pad(m, 2), pad(d, 2)), F.concat(m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日")),
        kanji("昭和", y - 1965), F.concat(F.lit("令和6年13月40日\n"), F.concat_ws("-", y + 24, pad(m, 2), pad(d, 2)))]
    pick = lambda n, values: reduce(lambda w, iv: w.when(k % n == iv[0], iv[1]), list(enumerate(values))[1:], F.when(k % n == 0, values[0]))
    contact = F.concat(
        F.lit("〒"), pad(k % 1000, 3), F.lit("-"), pad((k * 3) % 10000, 4), F.lit(" 東京都中央区銀座\nTEL 03-"), pad(k % 10000, 4), F.lit("-"), pad((k * 7) % 10000, 4))
    amount = lambda label, c: F.concat(F.lit(label), F.col(c), F.lit("円"))
    digit = F.when(k % 4 == 3, F.col("check") % 9 + 1).otherwise(F.col("check"))
    o = o.select(
        "k", "client_id",
        F.concat(pick(3, [F.lit(""), F.lit("発行元: "), F.lit("株式会社")]), F.col("vendor")).alias("l1"),
        F.concat(F.lit("発行日 "), pick(8, forms)).alias("l2"),
        F.when(k % 5 == 0, "").otherwise(contact).alias("l3"),
        amount("小計 ", "sub_t").alias("l4"),
        F.when(k % 10 == 7, amount("消費税 (8%) ", "tax_t")).when(k % 10 == 3, "").when(k % 11 == 5, amount("消費税 ", "tax_t"))
        .otherwise(amount("消費税 (10%) ", "tax_t")).alias("l5"),
        F.when(k % 9 == 4, F.concat(F.lit("¥"), F.col("total_t"))).otherwise(amount("合計 ", "total_t")).alias("l6"),
        pick(6, [F.lit(v) for v in ("現金", "VISA", "PayPay", "振込", "", "口座振替")]).alias("l7"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("登録番号 T"), digit.cast("string"), F.col("body"))).alias("l8"))
    o = o.select("k", "client_id", F.concat_ws("\n", *[f"l{i}" for i in range(1, 9)]).alias("t"))
    return o.select(
        F.col("k").alias("doc_id"), "client_id",
        F.when(k % 3 == 0, F.translate("t", "0123456789", "０１２３４５６７８９")).otherwise(F.col("t")).alias("text"))


def pii_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_orders(spark, sf).select(K)).selectExpr(f"{K} AS doc_id", f"{PII_TEXT} AS text")


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's own document texts (doc_id, text)."""
    return spread(raw(spark, sf, "documents").select("doc_id", "text"))


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice texts (doc_id, text) with their item lines; every fifth line number carries a wrong amount."""
    li = raw(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
        f"'品目' || {s('l_partkey')} || '  ' || {s(ITEM_COLUMNS['quantity'])} || '  ' || ({comma(ITEM_COLUMNS['unit_price'])}) || '  ' || "
        f"({comma('(CASE WHEN l_linenumber % 5 = 4 THEN 2 ELSE 1 END * ' + ITEM_COLUMNS['amount'] + ')')}) AS line) AS item")
    lines = li.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["line"]), "\n")
    head = F.concat(F.lit("請求書\n請求書番号: INV-"), F.col("doc_id").cast("string"), F.lit("\n品目  数量  単価  金額\n"))
    return lines.select("doc_id", F.concat(head, body, F.lit("\n以上\n")).alias("text"))
