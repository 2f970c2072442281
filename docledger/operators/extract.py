"""Field extraction from recognised text, each field as a frame-to-frame operator.

Every step is split into stages (`withColumns`) so that an expensive pattern runs once per row and its small result is
re-used, rather than being repeated inside one wide expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import constants as C
from docledger.functions.text import (
    FLAGS_NOCASE, LINE_BREAK, blank_to_null, contains_any, first_group, has_any, normalize_text, parse_amount, rx, rx_all, rx_raw, strip,
)

ITEM_TYPE = "array<struct<description:string,quantity:bigint,unit_price:decimal(14,2),amount:decimal(14,2),tax_rate:decimal(5,3)>>"


def _as_date(value) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(value))


def with_normalized(df: DataFrame, text_col: str, out: str = "norm_text") -> DataFrame:
    return df.withColumn(out, normalize_text(F.col(text_col)))


def with_date(df: DataFrame, norm_col: str, as_of, out: str = "transaction_date") -> DataFrame:
    """Transaction date: the first pattern, in order, whose first match is a real date."""
    df = df.withColumns({
        f"_dm{i}": rx_raw(F.col(norm_col), p, 0, C.DATE_LITERALS.get(name, ())) for i, (name, p, _) in enumerate(C.DATE_PATTERNS)})
    df = df.withColumns({
        f"_dn{i}": F.regexp_extract_all(F.col(f"_dm{i}"), F.lit(r"(?U)\d+"), F.lit(0))
        for i in range(len(C.DATE_PATTERNS))
    })
    today = _as_date(as_of)
    found = []
    for i, (_, _, offset) in enumerate(C.DATE_PATTERNS):
        part = lambda k, i=i: F.get(F.col(f"_dn{i}"), F.lit(k)).try_cast("int")
        if offset is None:
            this_year = _safe_date(F.year(today), part(0), part(1))
            last_year = _safe_date(F.year(today) - 1, part(0), part(1))
            found.append(F.when(this_year > today, last_year).otherwise(this_year))
        else:
            found.append(_safe_date(part(0) + offset, part(1), part(2)))
    df = df.withColumn(out, F.coalesce(*found))
    return df.drop(*[f"_d{k}{i}" for i in range(len(C.DATE_PATTERNS)) for k in "mn"])


def _safe_date(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, zero, zero, zero.cast("decimal(8,6)")).cast("date")


def with_vendor(df: DataFrame, norm_col: str, out: str = "vendor_name") -> DataFrame:
    """Vendor: labelled or corporate-form patterns, else the first plausible one of the first five lines."""
    text = F.col(norm_col)
    tried = lambda i: rx_raw(text, C.VENDOR_PATTERNS[i], 1, C.VENDOR_LITERALS[i])
    df = df.withColumn("_v0", tried(0)).withColumn("_v1", F.when(F.col("_v0") == "", tried(1)).otherwise(""))
    # the last pattern is costly and only counts when the first two found nothing
    df = df.withColumn("_v2", F.when((F.col("_v0") == "") & (F.col("_v1") == ""), tried(2)))
    df = df.withColumn("_labelled", F.coalesce(*[blank_to_null(F.col(f"_v{i}")) for i in range(3)])).drop("_v0", "_v1", "_v2")

    def plausible(line):
        ok = (F.length(line) >= 2) & ~line.rlike(r"(?U)^[〒\d]")
        return ok & ~contains_any(line, C.VENDOR_LINE_EXCLUDED)

    head = F.transform(F.slice(F.split(text, LINE_BREAK, 6), 1, 5), strip)
    df = df.withColumn("_first_line", F.when(F.col("_labelled").isNull(), F.get(F.filter(head, plausible), F.lit(0))))
    df = df.withColumn(out, blank_to_null(F.substring(F.coalesce(strip(F.col("_labelled")), F.col("_first_line")), 1, 100)))
    return df.drop("_labelled", "_first_line")


def phone(norm: Column) -> Column:
    return blank_to_null(rx_raw(norm, C.PHONE_PATTERN, 1, C.PHONE_LITERALS))


def address(norm: Column) -> Column:
    return strip(blank_to_null(rx_raw(norm, C.ADDRESS_PATTERN, 0, C.ADDRESS_LITERALS)))


def registration_no(norm: Column) -> Column:
    return F.concat(F.lit("T"), rx(norm, C.REGISTRATION_NO_PATTERN))


def invoice_no(norm: Column) -> Column:
    return strip(blank_to_null(F.when(has_any(norm, C.INVOICE_NO_LITERALS), F.regexp_extract(norm, FLAGS_NOCASE + C.INVOICE_NO_PATTERN, 1))))


def payment_method(lowered: Column) -> Column:
    return first_group(lowered, [(words, F.lit(name)) for name, words in C.PAYMENT_KEYWORDS.items()])


def suggest_account(lowered: Column, vendor: Column) -> Column:
    """Account from the keywords in text and vendor; ``lowered`` is the lower-case text."""
    combined = F.concat_ws(" ", lowered, F.lower(F.coalesce(vendor, F.lit(""))))
    return first_group(combined, [(words, F.lit(name)) for name, words in C.ACCOUNT_KEYWORDS.items()])


def with_account(df: DataFrame, lowered_col: str, vendor_col: str, out: str = "account_title") -> DataFrame:
    df = df.withColumn("_combined", F.concat(F.col(lowered_col), F.lit(" "), F.lower(F.coalesce(F.col(vendor_col), F.lit("")))))
    groups = [(words, F.lit(name)) for name, words in C.ACCOUNT_KEYWORDS.items()]
    return df.withColumn(out, first_group(F.col("_combined"), groups)).drop("_combined")


def with_amounts(df: DataFrame, norm_col: str, yen: str = "first", infer_tax: bool = True) -> DataFrame:
    """Adds total_amount, subtotal_amount, tax_amount_10, tax_amount_8.

    ``yen='first'`` reads the first yen-sign amount when no label gave a total, ``'max'`` the largest one.
    """
    text = F.col(norm_col)
    positive = lambda c: F.when(c > 0, c)
    read = lambda k: rx_raw(text, C.AMOUNT_PATTERNS[k], 1, C.AMOUNT_LITERALS[k])
    found = {f"_am_{k}": parse_amount(read(k)) for k in C.AMOUNT_PATTERNS if k not in ("yen_amount", "tax_total")}
    df = df.withColumns(found)
    a = {k: positive(F.col(f"_am_{k}")) for k in C.AMOUNT_PATTERNS}
    # these two count only when the patterns before them found nothing
    no_total, no_tax = a["total"].isNull() & a["total_tax_included"].isNull(), a["tax_10"].isNull() & a["tax_8"].isNull()
    late = {"_am_yen_amount": F.when(no_total, read("yen_amount")), "_am_tax_total": F.when(no_tax, read("tax_total"))}
    if yen == "max":
        late["_am_yen_amount"] = F.when(no_total, rx_all(text, C.AMOUNT_PATTERNS["yen_amount"]))
    df = df.withColumns(late)
    if yen == "max":
        every = F.transform("_am_yen_amount", parse_amount)
        parsed = {"_am_yen_amount": F.array_max(F.filter(every, lambda v: v.isNotNull()))}
    else:
        parsed = {"_am_yen_amount": parse_amount(F.col("_am_yen_amount"))}
    df = df.withColumns(parsed | {"_am_tax_total": parse_amount(F.col("_am_tax_total"))})
    df = df.withColumns({
        "total_amount": F.coalesce(a["total"], a["total_tax_included"], a["yen_amount"]),
        "subtotal_amount": a["subtotal"],
        "tax_amount_10": F.coalesce(a["tax_10"], F.when(a["tax_8"].isNull(), a["tax_total"])),
        "tax_amount_8": a["tax_8"],
    }).drop(*found, *late)
    if infer_tax:
        df = df.withColumn("tax_amount_10", inferred_tax())
    return df


def inferred_tax() -> Column:
    """10 % tax as the gap between total and subtotal when no tax line was found."""
    gap = F.col("total_amount") - F.col("subtotal_amount")
    missing = F.col("tax_amount_10").isNull() & F.col("tax_amount_8").isNull() & (gap > 0)
    return F.when(missing, gap.cast("decimal(14,2)")).otherwise(F.col("tax_amount_10"))


def line_items(norm: Column) -> Column:
    """Item rows ``description  qty  price  amount`` whose product is within 10 % of the amount."""
    part = lambda m, g: F.regexp_extract(m, "(?dU)" + C.LINE_ITEM_PATTERN, g)
    # the full pattern is costly; only texts with a wide gap before a digit can hold an item row
    whole = F.when(norm.rlike(r"(?U)\s\s\d"), rx_all(norm, C.LINE_ITEM_PATTERN, 0)).when(norm.isNotNull(), F.array().cast("array<string>"))
    rows = F.transform(whole, lambda m: F.struct(
        strip(part(m, 1)).alias("description"),
        part(m, 2).try_cast("bigint").alias("quantity"),
        parse_amount(part(m, 3)).alias("unit_price"),
        parse_amount(part(m, 4)).alias("amount"),
        F.lit("0.10").cast("decimal(5,3)").alias("tax_rate"),
    ))
    wide = lambda c: c.cast("decimal(18,2)")
    fits = lambda r: F.abs(
        r["quantity"].cast("decimal(18,0)") * wide(r["unit_price"]) - wide(r["amount"])
    ) <= wide(r["amount"]) * F.lit("0.1").cast("decimal(2,1)")
    return F.filter(rows, lambda r: F.coalesce(fits(r), F.lit(False)))


def field_confidence(date: Column, total: Column, vendor: Column, tax10: Column, tax8: Column) -> Column:
    has = lambda c: c.isNotNull() & (c != 0)
    flag = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    return F.create_map(
        F.lit("date"), flag(date.isNotNull(), 1.0, 0.0),
        F.lit("amount"), flag(F.coalesce(has(total), F.lit(False)), 1.0, 0.0),
        F.lit("vendor"), flag(vendor.isNotNull() & (vendor != ""), 0.8, 0.0),
        F.lit("tax"), flag(F.coalesce(has(tax10), F.lit(False)) | F.coalesce(has(tax8), F.lit(False)), 1.0, 0.2),
    )


FIELD_NAMES = [
    "transaction_date", "vendor_name", "vendor_address", "vendor_phone", "vendor_registration_no", "total_amount",
    "subtotal_amount", "tax_amount_10", "tax_amount_8", "invoice_number", "payment_method", "note", "account_title",
]


def extract_fields(df: DataFrame, text_col: str, as_of, out: str = "fields") -> DataFrame:
    """All fields of one document text as a struct column, in one projection chain without any shuffle."""
    staged = with_normalized(df, text_col, "_norm").withColumn("_lower", F.lower("_norm"))
    staged = with_date(staged, "_norm", as_of)
    staged = with_vendor(staged, "_norm")
    staged = with_amounts(staged, "_norm")
    staged = with_account(staged, "_lower", "vendor_name")
    norm = F.col("_norm")
    staged = staged.withColumns({
        "vendor_address": address(norm),
        "vendor_phone": phone(norm),
        "vendor_registration_no": registration_no(norm),
        "invoice_number": invoice_no(norm),
        "payment_method": payment_method(F.col("_lower")),
        "note": F.lit(None).cast("string"),
        "_items": line_items(norm),
    })
    confidence = field_confidence(*[F.col(c) for c in (
        "transaction_date", "total_amount", "vendor_name", "tax_amount_10", "tax_amount_8")])
    fields = F.struct(*[F.col(c) for c in FIELD_NAMES], F.col("_items").alias("line_items"), confidence.alias("confidence"))
    keep = [F.col(c) for c in df.columns]
    return staged.select(*keep, fields.alias(out))


def merge_fields(primary: Column, secondary: Column) -> Column:
    """Fill the NULL fields of ``primary`` from ``secondary``; items are taken over when there are none."""
    filled = [F.coalesce(primary[c], secondary[c]).alias(c) for c in FIELD_NAMES]
    items = F.when(F.coalesce(F.size(primary["line_items"]), F.lit(0)) > 0, primary["line_items"]).otherwise(
        F.coalesce(secondary["line_items"], primary["line_items"]))
    return F.struct(*filled, items.alias("line_items"), F.coalesce(primary["confidence"], secondary["confidence"]).alias("confidence"))


def prefer_source(df: DataFrame, refined: str, mapped: str, text: str, fallback: str) -> DataFrame:
    """Choose between joined result tables: refined fields, else mapped fields (filled up from the text fields when total
    or vendor is missing), else the fallback model. Adds ``fields``, ``source`` and the step list.

    The named columns are structs (NULL when the source has no row); ``<name>_conf`` holds each source's own confidence.
    """
    r, m, t, f = (F.col(c) for c in (refined, mapped, text, fallback))
    lacking = m["total_amount"].isNull() | (m["total_amount"] == 0) | m["vendor_name"].isNull() | (m["vendor_name"] == "")
    filled = F.when(lacking & t.isNotNull(), merge_fields(m, t)).otherwise(m)
    hint = lambda name, default: F.coalesce(F.nullif(F.col(f"{name}_conf"), F.lit(0.0)), F.lit(default))
    source = F.when(r.isNotNull(), "refined").when(m.isNotNull(), "mapped").otherwise("fallback")
    steps = F.array_compact(F.array(
        F.when(m.isNotNull(), F.lit("cloud_ocr")).otherwise(F.lit("cloud_ocr:skipped")),
        F.when(r.isNotNull(), F.lit("postprocess")),
        F.when(r.isNull() & m.isNotNull(), F.lit("rule_mapping")),
        F.when(r.isNull() & m.isNull(), F.lit("model_fallback")),
    ))
    return df.withColumns({
        "fields": F.when(r.isNotNull(), r).when(m.isNotNull(), filled).otherwise(f),
        "source": source,
        "pipeline_steps": steps,
        "confidence_hint": F.when(r.isNotNull(), hint(refined, 0.85)).when(m.isNotNull(), F.col(f"{mapped}_conf"))
        .otherwise(hint(fallback, 0.8)),
    })


def item_rows(df: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """Long form of the item arrays: one row per item, numbered from 0."""
    return df.select(id_col, F.posexplode(items_col).alias("sort_order", "_item")).select(
        F.col(id_col).alias("document_id"), "sort_order", "_item.*")


def parse_iso_or_free_date(col: Column) -> Column:
    """Dates as they come from engine replies: ISO first, then the usual written forms."""
    text = strip(col)
    formats = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy",
               "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def normalize_registration(col: Column) -> Column:
    """``T`` + 13 digits out of a free value, else the trimmed value itself."""
    squeezed = F.upper(F.replace(col, F.lit(" "), F.lit("")))
    return F.coalesce(rx(squeezed, r"T\d{13}", 0), blank_to_null(strip(col)))


def raw_text_from_json(pairs: Column) -> Column:
    """``key: value`` lines of a map<string,string>, without NULL values and without the item list."""
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull() & (k != "line_items"))
    return F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
