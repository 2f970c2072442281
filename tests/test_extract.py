"""Field extraction against known answers."""

import datetime as dt

from pyspark.sql import functions as F

from docledger.operators import extract as X


def fields(spark, texts, as_of="2024-06-30"):
    """Fields of many texts in one run, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.fields for r in X.extract_fields(df, "text", as_of).orderBy("i").collect()]


def test_samples(samples):
    got = {r.id: r for r in X.extract_fields(samples, "text", "2024-06-30").select("id", "fields.*").collect()}
    r, i, h, c = (got[k] for k in ("receipt", "invoice", "handwritten", "card"))
    assert (r.transaction_date, r.total_amount, r.subtotal_amount) == (dt.date(2024, 5, 8), 550, 500)
    assert (r.tax_amount_10, r.tax_amount_8, r.vendor_registration_no) == (50, None, "T7000012050002")
    assert r.vendor_name == "みどり文具 北口店" and r.invoice_number == "7000012050002" and r.line_items == []
    assert (i.transaction_date, i.total_amount, i.tax_amount_10) == (dt.date(2023, 11, 30), 220000, 20000)
    assert i.vendor_name == "あおば設計" and i.invoice_number == "2023-1130"
    assert [(x.description, x.quantity, x.amount) for x in i.line_items] == [("図面作成", 2, 160000), ("現地調査", 1, 40000)]
    assert (h.transaction_date, h.total_amount) == (dt.date(2023, 7, 2), 4800)
    assert c.total_amount == 12340 and c.payment_method == "クレジットカード"


DATES = [
    ("令和6年3月15日", dt.date(2024, 3, 15)), ("平成31年4月30日", dt.date(2019, 4, 30)), ("昭和64年1月7日", dt.date(1989, 1, 7)),
    ("2024/3/15", dt.date(2024, 3, 15)), ("発行日: 2024-03-15", dt.date(2024, 3, 15)), ("24.3.15", dt.date(2024, 3, 15)),
    ("2024年2月30日 24/2/28", dt.date(2024, 2, 28)), ("5月3日", dt.date(2024, 5, 3)), ("12月3日", dt.date(2023, 12, 3)), ("合計 1200円", None), ("", None)]
AMOUNTS = [
    ("小計 1,000円\n消費税 (10%) 100円\n合計 1,100円", (1100, 1000, 100, None)), ("本体 500円\n消費税 (8%) 40円\n合計 540円", (540, None, None, 40)),
    ("税込合計 ¥1,320", (1320, None, 1320, None)), ("請求金額 ¥1,320,000", (1320000, None, None, None)), ("お支払金額 ¥ 5,400", (5400, None, None, None)),
    ("合計 １，２００円", (1200, None, None, None)), ("￥３，５００", (3500, None, None, None)), ("小計 1,000円 合計 1,100円", (1100, 1000, 100, None)),
    ("2024年3月15日", (None, None, None, None))]
PAYMENTS = [("現金でお支払い", "現金"), ("クレジットカードでお支払い", "クレジットカード"), ("PayPay 残高", "電子マネー"), ("口座振替", "口座引落"), ("なし", None)]
VENDORS = [
    ("発行元： ABC商会 \n2024", "ABC商会"), ("有限会社 山田", "山田"), ("山田 合同会社", "山田"), ("2024年\n合計\nA\n 花屋さん \n", "花屋さん"),
    ("1\n2\n3\n4\n5\n六番目", None), ("発行元:  ", None)]
ITEMS = [("弁当   2   580   1,160\nコーヒー  1   300    900\nパン  3個  100  300", [("弁当", 2, 1160), ("パン", 3, 300)])]


def test_single_fields(spark):
    """Dates, amounts, payment methods, vendors and item rows, all texts in one run."""
    cases = (
        [("transaction_date", t, e) for t, e in DATES] + [("amounts", t, e) for t, e in AMOUNTS] + [("payment_method", t, e) for t, e in PAYMENTS]
        + [("vendor_name", t, e) for t, e in VENDORS] + [("line_items", t, e) for t, e in ITEMS])
    for (what, text, expected), f in zip(cases, fields(spark, [t for _, t, _ in cases])):
        if what == "amounts":
            got = tuple(None if v is None else int(v) for v in (f.total_amount, f.subtotal_amount, f.tax_amount_10, f.tax_amount_8))
        elif what == "line_items":
            got = [(i.description, i.quantity, i.amount) for i in f.line_items]
        else:
            got = f[what]
        assert got == expected, (what, text)


def test_merge_keeps_primary(spark):
    df = spark.createDataFrame([("合計 100円", "合計 200円\n現金")], "a string, b string")
    df = X.extract_fields(X.extract_fields(df, "a", "2024-01-01", "fa"), "b", "2024-01-01", "fb")
    m = df.select(X.merge_fields(F.col("fa"), F.col("fb")).alias("m")).collect()[0].m
    assert m.total_amount == 100 and m.payment_method == "現金"
