"""Account and tax resolution per bookkeeping package, client masters, and package-neutral ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions import registration
from docledger.functions.text import blank_to_null, lookup

SOFTWARE = ("freee", "money_forward", "yayoi")
_MASTER_COLUMN = {"freee": "freee_id", "money_forward": "mf_name", "yayoi": "yayoi_name"}


def client_account_master(changes: DataFrame) -> DataFrame:
    """Current master per (client_id, internal_name) from a change log.

    ``changes``: client_id, internal_name, freee_id, mf_name, yayoi_name, mode ('register' or 'load'), seq. A load
    replaces everything the client had; a registration adds one name and fills missing names with the internal one.
    """
    last_load = changes.filter("mode = 'load'").groupBy("client_id").agg(F.max("seq").alias("_from"))
    live = changes.join(last_load, "client_id", "left").filter(
        (F.col("_from").isNull() | (F.col("seq") >= F.col("_from"))) & (F.col("internal_name") != ""))
    name = F.col("internal_name")
    filled = lambda c: F.when(F.col("mode") == "register", F.coalesce(blank_to_null(F.col(c)), name)).otherwise(F.col(c))
    latest = F.max(F.struct("seq", F.col("freee_id"), filled("mf_name").alias("mf_name"), filled("yayoi_name").alias("yayoi_name")))
    return live.groupBy("client_id", "internal_name").agg(latest.alias("m")).select(
        "client_id", "internal_name", "m.freee_id", "m.mf_name", "m.yayoi_name")


def _system(name: Column, software: str) -> Column:
    at = SOFTWARE.index(software)
    return lookup(name, {k: str(v[at]) for k, v in C.ACCOUNT_MASTER.items()}, name)


def tax_code(tax: Column, software: str) -> Column:
    """Package code of a tax category, as a string."""
    software = software if software in SOFTWARE else "money_forward"
    at = SOFTWARE.index(software)
    default = {"freee": "17", "money_forward": "課税仕入10%", "yayoi": "10"}[software]
    return lookup(tax, {k: str(v[at]) for k, v in C.TAX_MASTER.items()}, F.lit(default))


def resolve_accounts(entries: DataFrame, software: str, master: DataFrame | None = None) -> DataFrame:
    """Adds debit_code, credit_code, tax_code for one package; unknown packages read as money_forward.

    Order: the client's own master, the system master, the name itself. The numeric package turns anything that is not a
    number into 1012 (debit) or 1 (credit). The system master is a fixed table and folds into the projection; the client
    master is joined and broadcast only if Spark finds it small.
    """
    software = software if software in SOFTWARE else "money_forward"
    out = entries
    column = _MASTER_COLUMN[software]
    for side in ("debit", "credit"):
        name = F.col(f"{side}_account")
        if master is None:
            resolved = _system(name, software)
        else:
            own = master.select(
                "client_id", F.col("internal_name").alias(f"{side}_account"),
                F.struct(F.col(column).cast("string").alias("v")).alias("_own"))
            out = out.join(own, ["client_id", f"{side}_account"], "left")
            resolved = F.when(F.col("_own").isNotNull(), F.col("_own.v")).otherwise(_system(name, software))
        if software == "freee":
            fallback = "1012" if side == "debit" else "1"
            resolved = F.when(resolved.rlike("^[0-9]+$"), resolved).otherwise(F.lit(fallback))
        out = out.withColumn(f"{side}_code", resolved).drop("_own")
    return out.withColumn("tax_code", tax_code(F.col("tax_category"), software))


def to_journal_entries(docs: DataFrame, extracted: DataFrame, items: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Package-neutral ledger rows: documents with their extracted fields, item lines nested in order."""
    line = F.struct(
        "sort_order", "description", "quantity", "unit_price",
        F.coalesce("amount", F.lit(0).cast("decimal(14,2)")).alias("amount"),
        F.coalesce("tax_rate", F.lit("0.10").cast("decimal(5,3)")).alias("tax_rate"),
        "account_title", F.lit(C.DEFAULT_TAX).alias("tax_category"))
    lines = items.groupBy("document_id").agg(F.sort_array(F.collect_list(line)).alias("line_items"))
    base = docs.select(F.col("id").alias("document_id"), "client_id").join(extracted, "document_id").join(lines, "document_id", "left")
    if scans is not None:
        base = base.join(scans.select(
            "document_id", F.col("image_hash").alias("original_image_hash"), F.col("scan_datetime").alias("scan_timestamp"), "scan_dpi",
        ), "document_id", "left")
    else:
        base = base.withColumns({
            "original_image_hash": F.lit(None).cast("string"), "scan_timestamp": F.lit(None).cast("timestamp"),
            "scan_dpi": F.lit(None).cast("int")})
    credit = F.when(blank_to_null(F.col("payment_method")).isNull() | (F.col("payment_method") == C.CASH), C.DEFAULT_CREDIT).otherwise(C.DEFAULT_PAYABLE)
    return base.select(
        "document_id", "client_id", "transaction_date", "vendor_name", "vendor_address", "vendor_registration_no", "invoice_number",
        F.coalesce("total_amount", F.lit(0).cast("decimal(14,2)")).alias("total_amount"), "subtotal_amount", "tax_amount_10",
        "tax_amount_8",
        F.coalesce(blank_to_null(F.col("account_title")), F.lit(C.DEFAULT_DEBIT)).alias("debit_account"),
        credit.alias("credit_account"),
        F.coalesce(blank_to_null(F.col("tax_category")), F.lit(C.DEFAULT_TAX)).alias("tax_category"),
        "payment_method", "cost_center", "note", "line_items", "original_image_hash", "scan_timestamp", "scan_dpi",
        F.coalesce(registration.validate(F.col("vendor_registration_no"))["is_valid"], F.lit(False)).alias("is_qualified_invoice"),
    )


def ledger_lines(entries: DataFrame) -> DataFrame:
    """Debit and credit in long form; the signed amounts of a document add up to zero."""
    side = lambda name, account, sign: F.struct(
        F.lit(name).alias("side"), F.col(account).alias("account"), (F.col("total_amount") * F.lit(sign)).cast("decimal(14,2)").alias("signed_amount"))
    sides = F.array(side("debit", "debit_account", 1), side("credit", "credit_account", -1))
    return entries.select("document_id", "client_id", "transaction_date", F.inline(sides))


def unbalanced(lines: DataFrame) -> DataFrame:
    return lines.groupBy("document_id").agg(F.sum("signed_amount").alias("balance")).filter("balance <> 0")
