"""Field extraction queries: texts are rendered from orders, the SQL side derives the answers from the order columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger import constants as C
from docledger.catalog.base import day, num, query
from docledger.functions.text import normalize_text, text_lines
from docledger.operators import extract as X
from docledger.plans import fixtures as fx
from docledger.sources.tables import raw

K = fx.K
_Y = "cast(year(o_orderdate) as int)"
_MD = "'-' || lpad(cast(month(o_orderdate) as string), 2, '0') || '-' || lpad(cast(day(o_orderdate) as string), 2, '0')"
_shift = lambda off: f"cast({_Y} + {off} as string) || {_MD}"
_no_leap = "month(o_orderdate) = 2 AND day(o_orderdate) = 29"
_this = f"'2026' || {_MD}"
_last = f"'2025' || {_MD}"
DATE_TRUTH = fx.case(fx.DATE_FORM, [
    _shift(24), _shift(0), _shift(24), _shift(24), _shift(24),
    f"CASE WHEN {_no_leap} THEN NULL WHEN {_this} > '{fx.AS_OF}' THEN {_last} ELSE {_this} END",
    _shift(-40), _shift(24)])


def _normalized(spark, sf):
    return X.with_normalized(fx.receipts(spark, sf), "text")


@query("normalize_text", f"SELECT {K} AS doc_id, {fx.RECEIPT_PLAIN_SQL} AS norm_text FROM orders")
def normalize(spark, sf):
    return _normalized(spark, sf).select("doc_id", "norm_text")


@query("normalize_documents", """
SELECT doc_id, translate(text, '！＂＃（）０１２３４５６７８９ＡＢＣＴ　￥', '!"#()0123456789ABCT ¥') AS norm_text FROM documents""")
def normalize_documents(spark, sf):
    return fx.prose(spark, sf).select("doc_id", normalize_text(F.col("text")).alias("norm_text"))


@query("extract_date", f"SELECT {K} AS doc_id, {DATE_TRUTH} AS transaction_date FROM orders")
def extract_date(spark, sf):
    return X.with_date(_normalized(spark, sf), "norm_text", fx.AS_OF).select("doc_id", day("transaction_date").alias("transaction_date"))


@query("extract_vendor", f"SELECT {K} AS doc_id, {fx.VENDOR} AS vendor_name FROM orders")
def extract_vendor(spark, sf):
    return X.with_vendor(_normalized(spark, sf), "norm_text").select("doc_id", "vendor_name")




@query("extract_vendor_documents", rf"""
WITH t AS (SELECT doc_id, list_transform(list_slice(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), 1, 5),
    lambda x: regexp_replace(x, '^[\s\v\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\v\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')) AS ls FROM documents)
SELECT doc_id, substr(list_filter(ls, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[〒0-9]') AND NOT contains(x, '年')
   AND NOT contains(x, '月') AND NOT contains(x, '合計') AND NOT contains(x, '小計') AND NOT contains(x, '¥'))[1], 1, 100) AS vendor_name FROM t""")
def extract_vendor_documents(spark, sf):
    docs = fx.prose(spark, sf)
    return X.with_vendor(X.with_normalized(docs, "text"), "norm_text").select("doc_id", "vendor_name")


_has_contact = f"{K} % 5 <> 0"


@query("extract_phone", f"SELECT {K} AS doc_id, CASE WHEN {_has_contact} THEN {fx.PHONE} END AS vendor_phone FROM orders")
def extract_phone(spark, sf):
    return _normalized(spark, sf).select("doc_id", X.phone(F.col("norm_text")).alias("vendor_phone"))


@query("extract_address", f"SELECT {K} AS doc_id, CASE WHEN {_has_contact} THEN {fx.ADDRESS} END AS vendor_address FROM orders")
def extract_address(spark, sf):
    return _normalized(spark, sf).select("doc_id", X.address(F.col("norm_text")).alias("vendor_address"))


_REG = f"CASE WHEN {K} % 7 <> 0 THEN {fx.REG_NO} END"


@query("extract_registration_no", f"SELECT {K} AS doc_id, {_REG} AS registration_no FROM orders")
def extract_registration_no(spark, sf):
    return _normalized(spark, sf).select("doc_id", X.registration_no(F.col("norm_text")).alias("registration_no"))


@query("extract_invoice_no", f"SELECT {K} AS doc_id, CASE WHEN {K} % 7 <> 0 THEN substr({fx.REG_NO}, 2) END AS invoice_number FROM orders")
def extract_invoice_no(spark, sf):
    return _normalized(spark, sf).select("doc_id", X.invoice_no(F.col("norm_text")).alias("invoice_number"))


@query("extract_payment_method", f"""SELECT {K} AS doc_id, {fx.PAYMENT} AS payment_method FROM orders""")
def extract_payment_method(spark, sf):
    return _normalized(spark, sf).select("doc_id", X.payment_method(F.lower("norm_text")).alias("payment_method"))


def ladder(text: str, groups: dict[str, list[str]]) -> str:
    """SQL: name of the first group with a keyword in an already lower-case text."""
    arms = [f"WHEN {' OR '.join(f'contains({text}, {fx.q(w.lower())})' for w in words)} THEN {fx.q(name)}" for name, words in groups.items()]
    return f"CASE {' '.join(arms)} END"


@query("payment_method_documents", f"SELECT doc_id, {ladder('lower(text)', C.PAYMENT_KEYWORDS)} AS payment_method FROM documents")
def payment_method_documents(spark, sf):
    docs = fx.prose(spark, sf).select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", X.payment_method(F.col("low")).alias("payment_method"))


_amounts = f"""SELECT {K} AS doc_id, cast({fx.TOTAL} as double) AS total_amount, cast({fx.SUB} as double) AS subtotal_amount,
  cast(CASE WHEN {K} % 10 = 7 THEN NULL ELSE {fx.TAX} END as double) AS tax_amount_10,
  cast(CASE WHEN {K} % 10 = 7 THEN {fx.TAX} END as double) AS tax_amount_8 FROM orders"""
_AMOUNT_NAMES = ("total_amount", "subtotal_amount", "tax_amount_10", "tax_amount_8")


@query("extract_amounts", _amounts.replace(f"{K} % 10 = 7 THEN NULL", f"{K} % 10 IN (3, 7) THEN NULL"))
def extract_amounts(spark, sf):
    return X.with_amounts(_normalized(spark, sf), "norm_text", infer_tax=False).select("doc_id", *[num(n).alias(n) for n in _AMOUNT_NAMES])


@query("infer_tax", _amounts)
def infer_tax(spark, sf):
    return X.with_amounts(_normalized(spark, sf), "norm_text").select("doc_id", *[num(n).alias(n) for n in _AMOUNT_NAMES])


@query("max_yen_amount", f"""
SELECT doc_id, max(x) AS total_amount FROM (SELECT {K} AS doc_id, unnest([cast({fx.TOTAL} as double), cast({fx.SUB} as double)]) AS x FROM orders) GROUP BY doc_id""")
def max_yen_amount(spark, sf):
    text = f"'¥' || ({fx.comma(fx.SUB)}) || ' と ¥' || ({fx.comma(fx.TOTAL)})"
    docs = raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"{text} AS text")
    return X.with_amounts(docs, "text", yen="max").select("doc_id", num("total_amount").alias("total_amount"))


_I = fx.ITEM_COLUMNS


@query("extract_line_items", f"""
SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sort_order,
  {_I['description']} AS description, {_I['quantity']} AS quantity, cast({_I['unit_price']} as double) AS unit_price, cast({_I['amount']} as double) AS amount,
  cast(0.10 as double) AS tax_rate FROM lineitem WHERE l_linenumber % 5 <> 4""")
def extract_line_items(spark, sf):
    docs = X.with_normalized(fx.invoices(spark, sf), "text")
    rows = X.item_rows(docs.withColumn("items", X.line_items(F.col("norm_text"))), "doc_id", "items")
    return rows.select("document_id", F.col("sort_order").cast("bigint").alias("sort_order"), "description", "quantity",
                       num("unit_price").alias("unit_price"), num("amount").alias("amount"), num("tax_rate").alias("tax_rate"))


@query("suggest_account_text", f"SELECT {K} AS doc_id, {ladder(f'lower({fx.VENDOR})', C.ACCOUNT_KEYWORDS)} AS account_title FROM orders")
def suggest_account_text(spark, sf):
    df = X.with_vendor(_normalized(spark, sf), "norm_text").withColumn("low", F.lower("norm_text"))
    return X.with_account(df, "low", "vendor_name").select("doc_id", "account_title")


@query("suggest_account_documents", f"SELECT doc_id, {ladder('lower(text)', C.ACCOUNT_KEYWORDS)} AS account_title FROM documents")
def suggest_account_documents(spark, sf):
    df = fx.prose(spark, sf).select("doc_id", F.lower("text").alias("low"), F.lit(None).cast("string").alias("vendor_name"))
    return X.with_account(df, "low", "vendor_name").select("doc_id", "account_title")


@query("field_confidence", f"""
SELECT {K} AS doc_id, CASE WHEN {DATE_TRUTH} IS NULL THEN 0.0::double ELSE 1.0::double END AS c_date, CASE WHEN {fx.TOTAL} > 0 THEN 1.0::double ELSE 0.0::double END AS c_amount,
  0.8::double AS c_vendor, CASE WHEN {fx.TAX} > 0 THEN 1.0::double ELSE 0.2::double END AS c_tax FROM orders""")
def field_confidence(spark, sf):
    df = X.extract_fields(fx.receipts(spark, sf), "text", fx.AS_OF)
    c = F.col("fields.confidence")
    return df.select("doc_id", c["date"].alias("c_date"), c["amount"].alias("c_amount"), c["vendor"].alias("c_vendor"), c["tax"].alias("c_tax"))


_FIELDS_SQL = f"""
SELECT {K} AS doc_id, {DATE_TRUTH} AS transaction_date, {fx.VENDOR} AS vendor_name,
  CASE WHEN {_has_contact} THEN {fx.ADDRESS} END AS vendor_address, CASE WHEN {_has_contact} THEN {fx.PHONE} END AS vendor_phone,
  {_REG} AS vendor_registration_no, cast({fx.TOTAL} as double) AS total_amount, cast({fx.SUB} as double) AS subtotal_amount,
  cast(CASE WHEN {K} % 10 = 7 THEN NULL ELSE {fx.TAX} END as double) AS tax_amount_10, cast(CASE WHEN {K} % 10 = 7 THEN {fx.TAX} END as double) AS tax_amount_8,
  {fx.PAYMENT} AS payment_method, {ladder(f'lower({fx.VENDOR})', C.ACCOUNT_KEYWORDS)} AS account_title FROM orders"""


@query("extract_fields", _FIELDS_SQL)
def extract_fields(spark, sf):
    df = X.extract_fields(fx.receipts(spark, sf), "text", fx.AS_OF).select("doc_id", "fields.*")
    return df.select("doc_id", day("transaction_date").alias("transaction_date"), "vendor_name", "vendor_address", "vendor_phone",
                     "vendor_registration_no", *[num(n).alias(n) for n in _AMOUNT_NAMES], "payment_method", "account_title")


def _sparse_fields(keep_total: str, keep_vendor: str):
    """A fields struct with some fields left out, as another engine would return it."""
    null = {
        "transaction_date": "date", "vendor_address": "string", "vendor_phone": "string", "vendor_registration_no": "string",
        "subtotal_amount": "decimal(14,2)", "tax_amount_10": "decimal(14,2)", "tax_amount_8": "decimal(14,2)", "invoice_number": "string",
        "payment_method": "string", "note": "string", "account_title": "string",
    }
    parts = []
    for name in X.FIELD_NAMES:
        if name == "total_amount":
            parts.append(F.expr(f"cast(CASE WHEN {keep_total} THEN 1000 END as decimal(14,2))").alias(name))
        elif name == "vendor_name":
            parts.append(F.expr(f"CASE WHEN {keep_vendor} THEN '別エンジン商店' END").alias(name))
        else:
            parts.append(F.lit(None).cast(null[name]).alias(name))
    return F.struct(*parts, F.lit(None).cast(X.ITEM_TYPE).alias("line_items"), F.lit(None).cast("map<string,double>").alias("confidence"))


@query("merge_fields", f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 2 = 0 THEN 1000.0::double ELSE cast({fx.TOTAL} as double) END AS total_amount,
  CASE WHEN {K} % 3 = 0 THEN '別エンジン商店' ELSE {fx.VENDOR} END AS vendor_name, {fx.PAYMENT} AS payment_method FROM orders""")
def merge_fields(spark, sf):
    df = X.extract_fields(fx.receipts(spark, sf), "text", fx.AS_OF)
    df = df.withColumn("other", _sparse_fields("doc_id % 2 = 0", "doc_id % 3 = 0")).withColumn("m", X.merge_fields(F.col("other"), F.col("fields")))
    return df.select("doc_id", num("m.total_amount").alias("total_amount"), "m.vendor_name", "m.payment_method")


@query("prefer_source", f"""
SELECT {K} AS doc_id,
  CASE {K} % 3 WHEN 0 THEN 'refined' WHEN 1 THEN 'mapped' ELSE 'fallback' END AS source,
  CASE {K} % 3 WHEN 0 THEN 'cloud_ocr:skipped,postprocess' WHEN 1 THEN 'cloud_ocr,rule_mapping' ELSE 'cloud_ocr:skipped,model_fallback' END AS steps,
  CASE {K} % 3 WHEN 0 THEN 0.85::double WHEN 1 THEN 0.7::double ELSE 0.6::double END AS confidence_hint,
  CASE {K} % 3 WHEN 1 THEN CASE WHEN {K} % 2 = 0 THEN 1000.0::double ELSE cast({fx.TOTAL} as double) END ELSE 1000.0::double END AS total_amount,
  CASE {K} % 3 WHEN 1 THEN CASE WHEN {K} % 5 = 0 THEN '別エンジン商店' ELSE {fx.VENDOR} END ELSE '別エンジン商店' END AS vendor_name
FROM orders""")
def prefer_source(spark, sf):
    df = X.extract_fields(fx.receipts(spark, sf), "text", fx.AS_OF, out="text_fields")
    full, partial = _sparse_fields("true", "true"), _sparse_fields("doc_id % 2 = 0", "doc_id % 5 = 0")
    df = df.withColumns({
        "refined": F.when(F.expr("doc_id % 3 = 0"), full), "refined_conf": F.lit(None).cast("double"),
        "mapped": F.when(F.expr("doc_id % 3 = 1"), partial), "mapped_conf": F.lit(0.7),
        "fallback": full, "fallback_conf": F.lit(0.6)})
    out = X.prefer_source(df, "refined", "mapped", "text_fields", "fallback")
    return out.select("doc_id", "source", F.array_join("pipeline_steps", ",").alias("steps"), "confidence_hint",
                      num("fields.total_amount").alias("total_amount"), F.col("fields.vendor_name").alias("vendor_name"))


@query("parse_free_date", f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
  CASE {K} % 3 WHEN 0 THEN {fx.REG_NO} WHEN 1 THEN {fx.REG_NO} ELSE 'ID 99' END AS registration FROM orders""")
def parse_free_date(spark, sf):
    written = F.expr(
        f"CASE {K} % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/M/d') "
        f"WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 3 THEN date_format(o_orderdate, 'MMM d, yyyy') "
        f"WHEN 4 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE 'unknown' END")
    number = F.expr(f"CASE {K} % 3 WHEN 0 THEN lower({fx.REG_NO}) WHEN 1 THEN 'No. ' || substr({fx.REG_NO}, 1, 5) || ' ' || substr({fx.REG_NO}, 6) ELSE ' ID 99 ' END")
    return raw(spark, sf, "orders").select(
        F.col(K).alias("doc_id"), day(X.parse_iso_or_free_date(written)).alias("parsed"), X.normalize_registration(number).alias("registration"))


@query("raw_text_from_json", f"""
SELECT {K} AS doc_id, 'vendor_name: ' || {fx.VENDOR} || chr(10) || 'total_amount: ' || cast({fx.TOTAL} as string) ||
  CASE WHEN {K} % 6 = 4 THEN '' ELSE chr(10) || 'payment_method: ' || {fx.PAYMENT} END AS text FROM orders""")
def raw_text_from_json(spark, sf):
    pairs = F.expr(f"map('vendor_name', {fx.VENDOR}, 'line_items', '[]', 'total_amount', cast({fx.TOTAL} as string), 'payment_method', {fx.PAYMENT})")
    return raw(spark, sf, "orders").select(F.col(K).alias("doc_id"), X.raw_text_from_json(pairs).alias("text"))


@query("text_lines", r"""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
  lambda x: regexp_replace(x, '[\s\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g') <> ''))::bigint AS lines FROM documents""")
def count_lines(spark, sf):
    return fx.prose(spark, sf).select("doc_id", F.size(text_lines(F.col("text"))).cast("bigint").alias("lines"))


@query("line_table", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'),
  lambda x: regexp_replace(x, '[\s\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+', '', 'g') <> '') AS ls FROM documents)
SELECT doc_id, unnest(range(len(ls)))::bigint AS line_no, unnest(ls) AS line FROM t""")
def line_table(spark, sf):
    return fx.prose(spark, sf).select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


