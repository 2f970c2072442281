"""Export dialects: each turns approved documents with their extracted row into CSV cells, or deal payloads into JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import blank_to_null, lookup, strip
from docledger.session import keep


def safe_date(col: Column, fmt: str = "yyyy/MM/dd") -> Column:
    return F.coalesce(F.date_format(col, fmt), F.lit(""))


def safe_amount(col: Column) -> Column:
    """Whole amounts without decimals, others with two, NULL as nothing."""
    v = col.cast("decimal(20,2)")
    return F.coalesce(F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")), F.lit(""))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _shared() -> dict[str, Column]:
    tax10 = F.coalesce(F.col("tax_amount_10"), F.lit(0)).cast("decimal(20,2)")
    tax8 = F.coalesce(F.col("tax_amount_8"), F.lit(0)).cast("decimal(20,2)")
    return {
        "no": F.substring("id", 1, 8), "date": safe_date(F.col("transaction_date")),
        "debit": F.coalesce(blank_to_null(F.col("account_title")), F.lit(C.DEFAULT_DEBIT)),
        "credit": F.when(F.col("payment_method") == C.CASH, C.CASH).otherwise(C.DEFAULT_PAYABLE),
        "amount": safe_amount(F.col("total_amount")), "tax": tax10 + tax8, "has10": tax10 > 0, "has8": tax8 > 0,
        "vendor": _or_empty("vendor_name"), "file": _or_empty("original_filename"), "none": F.lit(""),
    }


def pair(docs: DataFrame, extracted: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with their extracted row; ``inner`` leaves out documents without one."""
    return docs.join(extracted.withColumnRenamed("document_id", "id"), "id", how)


def _cells(pairs: DataFrame, headers: list[str], cells: list[Column], extra: list[str] = ()) -> DataFrame:
    assert len(headers) == len(cells)
    return pairs.select("id", "client_id", "transaction_date", *extra, F.array(*cells).alias("cells"))


def freee_rows(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    p, c = pair(docs, extracted), _shared()
    label = F.when(c["has10"], "課税仕入10%").when(c["has8"], "課税仕入8%軽").otherwise("課税仕入10%")
    tax = F.when(c["tax"] != 0, safe_amount(c["tax"])).otherwise("")
    e = c["none"]
    return _cells(p, C.FREEE_HEADERS, [
        c["no"], c["date"], c["debit"], label, c["amount"], tax, c["credit"], e, c["amount"], e, c["vendor"], c["file"], e, e])


def money_forward_rows(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    p, c = pair(docs, extracted), _shared()
    label = F.when(c["has10"], "課税仕入10%").otherwise("課税仕入8%")
    tax = F.when(c["tax"] != 0, safe_amount(c["tax"])).otherwise("")
    summary, e = strip(F.concat(c["vendor"], F.lit(" "), c["file"])), c["none"]
    return _cells(p, C.MF_HEADERS, [
        c["date"], c["debit"], e, e, label, c["amount"], tax, c["credit"], e, e, e, c["amount"], e, summary, c["no"]])


def yayoi_rows(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Rows carry a running voucher number in (date, id) order, without gaps."""
    p = number_rows(pair(docs, extracted), "transaction_date", "id", "voucher")
    c = _shared()
    code = F.when(c["has10"], "10").otherwise("11")
    tax = F.when(c["tax"] != 0, safe_amount(c["tax"])).otherwise("0")
    voucher = F.lpad(F.col("voucher").cast("string"), F.greatest(F.lit(6), F.length(F.col("voucher").cast("string"))), F.lit("0"))
    e, zero = c["none"], F.lit("0")
    return _cells(p, C.YAYOI_HEADERS, [
        F.lit("2"), voucher, zero, c["date"], c["debit"], e, e, c["amount"], tax, code, F.lit("1"), c["credit"], e, e, c["amount"],
        zero, zero, zero, c["vendor"], e, e, e, e], extra=["voucher"])


def generic_rows(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """The widest dialect; documents without an extracted row stay in."""
    p = pair(docs, extracted, "left")
    conf = F.when(F.coalesce(F.col("ocr_confidence"), F.lit(0)) != 0, F.round(F.col("ocr_confidence").cast("decimal(10,4)"), 2).cast("decimal(10,2)").cast("string")).otherwise("")
    amounts = [safe_amount(F.col(n)) for n in ("total_amount", "subtotal_amount", "tax_amount_10", "tax_amount_8")]
    texts = [_or_empty(n) for n in ("vendor_name", "vendor_address", "vendor_phone", "vendor_registration_no", "invoice_number")]
    return _cells(p, C.GENERIC_HEADERS, [
        F.col("id"), _or_empty("original_filename"), _or_empty("doc_type"), safe_date(F.col("transaction_date")), *texts, *amounts,
        _or_empty("payment_method"), _or_empty("account_title"), _or_empty("note"), conf, _or_empty("approved_by"),
        safe_date(F.col("approved_at"), "yyyy/MM/dd HH:mm")])


def number_rows(df: DataFrame, day: str, key: str, out: str) -> DataFrame:
    """Numbers rows 1, 2, 3 … in (day, key) order, rows without a day first; rows alike in both are numbered in any order.

    A range sort deals the rows out, so a day or a prefix of keys that holds most of them is still spread. The sorted rows are
    kept with their place in their partition; the counts of the partitions, a row for each, add up to what comes before.
    """
    order = F.col(day).asc_nulls_first(), F.col(key).asc_nulls_first()
    running = F.monotonically_increasing_id()  # partition in the upper bits, place in it in the lower 33
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_running", running)
    placed = keep(placed.withColumns({"_part": F.shiftright("_running", 33), "_place": F.col("_running").bitwiseAND((1 << 33) - 1)}).drop("_running"), "placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def csv_line(cells: Column) -> Column:
    """Every cell quoted, inner quotes doubled."""
    quoted = F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(quoted, ",")


def _head(rows: list[list[str]]) -> list[str]:
    return [",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows]


DIALECTS = {
    "freee": (freee_rows, _head([C.FREEE_HEADERS]), "utf-8-sig"),
    "money_forward": (money_forward_rows, _head([C.MF_HEADERS]), "utf-8-sig"),
    "yayoi": (yayoi_rows, _head([C.YAYOI_BANNER, C.YAYOI_HEADERS]), "cp932"),
    "generic_csv": (generic_rows, _head([C.GENERIC_HEADERS]), "utf-8-sig"),
}


def export_lines(docs: DataFrame, extracted: DataFrame, fmt: str) -> DataFrame:
    """The CSV lines of one format: id, client_id, transaction_date, line."""
    if fmt not in DIALECTS:
        raise ValueError(f"未対応のエクスポート形式: {fmt}")
    rows = DIALECTS[fmt][0](docs, extracted)
    return rows.withColumn("line", csv_line(F.col("cells"))).drop("cells")


def export_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.EXPORT_FORMATS, "id string, name string, description string, encoding string")


def build_deals(docs: DataFrame, extracted: DataFrame, company_id: int, as_of: Column) -> DataFrame:
    """(id, payload): one deal per document as JSON text."""
    p = pair(docs, extracted)
    day = F.date_format(F.coalesce(F.col("transaction_date"), as_of), "yyyy-MM-dd")
    total = F.coalesce(F.col("total_amount"), F.lit(0)).cast("decimal(20,2)")
    amount = F.when(total < 0, F.ceil(total)).otherwise(F.floor(total)).cast("bigint")
    account = lookup(F.coalesce(F.col("account_title"), F.lit("")), C.DEAL_ACCOUNT_CODES, F.lit(1012))
    tax = lookup(F.coalesce(blank_to_null(F.col("tax_category")), F.lit(C.DEFAULT_TAX)), C.DEAL_TAX_CODES, F.lit(17))
    wallet = lookup(F.coalesce(F.col("payment_method"), F.lit("")), C.DEAL_WALLETS, F.lit(1))
    vendor = F.coalesce(blank_to_null(F.col("vendor_name")), F.lit("不明"))
    null = F.lit(None).cast("int")
    detail = F.struct(
        tax.alias("tax_code"), account.alias("account_item_id"), amount.alias("amount"),
        F.substring(F.concat(vendor, F.lit(" "), _or_empty("original_filename")), 1, 255).alias("description"),
        null.alias("item_id"), null.alias("section_id"))
    payment = F.struct(
        amount.alias("amount"), F.lit("account_item").alias("from_walletable_type"), wallet.alias("from_walletable_id"), day.alias("date"))
    body = [
        F.lit(company_id).alias("company_id"), day.alias("issue_date"), F.lit("expense").alias("type"), day.alias("due_date"),
        amount.alias("amount"), amount.alias("due_amount"), F.lit("expense").alias("payment_type"), F.array(detail).alias("details"),
        F.array(payment).alias("payments"), F.array().cast("array<int>").alias("receipt_ids")]
    keep_nulls = {"ignoreNullFields": "false"}
    qualified = F.to_json(F.struct(*body, F.lit("qualified").alias("qualified_invoice_status")), keep_nulls)
    plain = F.to_json(F.struct(*body), keep_nulls)
    return p.select("id", F.when(blank_to_null(F.col("vendor_registration_no")).isNotNull(), qualified).otherwise(plain).alias("payload"))
