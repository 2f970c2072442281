"""Long inputs and plans: many hits in one text, voucher numbers without a day, a page before its join."""

import re
import time

import public_tokenizers
from pyspark.sql import functions as F

from docledger.catalog import QUERIES
from docledger.functions import pii as P
from docledger.functions import registration as R
from docledger.functions.text import parse_amount, strip
from docledger.llm import packing as PK
from docledger.operators import exports as EX
from docledger.operators import reports as RP
from docledger.plans import fixtures as fx
from docledger.session import SHUFFLE_PARTITIONS, scratch_folder
from docledger.sources import files as FI
from docledger.sources.tables import TASK_ROWS, spread

SF = "/root/testdata/sf0.001"


def test_ten_thousand_hits_both_ways(spark):
    text = " ".join(f"{i:04d}-{i * 3 % 10000:04d}-{i * 7 % 10000:04d} and [CARD_NUMBER_{i}]" for i in range(10_000))  # what looks like a placeholder in the text itself stays
    cards = "4532015112830366 4532015112830367 " * 5000
    df = spark.createDataFrame([(1, text), (2, cards)], "i int, t string")
    start = time.perf_counter()
    out = P.mask_pii(df, "t", kinds=P.ALL_KINDS).withColumn("back", P.restore_pii(F.col("masked_text"), F.col("restored_values")))
    rows = out.orderBy("i").collect()
    assert time.perf_counter() - start < 60
    assert [r.mask_count for r in rows] == [10_000, 5_000] and all(r.back == r.t for r in rows)


def test_restoring_takes_any_map_and_leaves_what_is_no_placeholder(spark):
    label = next(iter(P.C.PII_PATTERNS.values()))[0]
    df = spark.createDataFrame([(f"a [{label}_7] b [{label}_1] [{label}_99999999999] [x_1] $1",)], "t string")
    made = F.create_map(F.lit(f"[{label}_7]"), F.lit(r"\seven$"), F.lit(f"[{label}_1]"), F.lit("one"))
    assert df.select(P.restore_pii(F.col("t"), made)).first()[0] == rf"a \seven$ b one [{label}_99999999999] [x_1] $1"


def test_numbers_follow_day_and_id(spark):
    rows = [(None if i % 3 else f"2024-01-{i % 28 + 1:02d}", f"same-{i * 7919 % 1000:04d}") for i in range(1000)] + [(None, None), ("2024-01-01", "same-0000")]
    df = spark.createDataFrame(rows, "day string, id string").withColumn("day", F.to_date("day"))
    got = EX.number_rows(df.repartition(7), "day", "id", "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1003))
    told = [(r.day is not None, str(r.day), r.id is not None, r.id or "") for r in sorted(got, key=lambda r: r.n)]
    assert told == sorted(told)
    assert EX.number_rows(df.limit(0), "day", "id", "n").collect() == []


def test_numbering_has_no_window_over_rows(spark, capsys):
    df = spark.createDataFrame([("a", 1)], "id string, day int")
    EX.number_rows(df, "day", "id", "n").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Window (") <= 2 and "HashAggregate" in plan  # the window sees one row per partition


def test_page_is_chosen_before_the_join(spark, capsys):
    docs = spark.range(300).selectExpr(
        "cast(id as string) AS id", "'f' AS original_filename", "'receipt' AS doc_type", "'pending' AS status", "0.5D AS ocr_confidence", "timestamp_seconds(id * 7 % 300) AS uploaded_at",
        "current_timestamp() AS processed_at", "current_timestamp() AS approved_at", "'x' AS confidence_tier", "1.0D AS confidence_score", "true AS arithmetic_check_ok", "array('a') AS review_flags")
    extracted = spark.range(0, 300, 2).selectExpr("cast(id as string) AS document_id", "cast(id as decimal(14,2)) AS total_amount", "'v' AS vendor_name", "current_date() AS transaction_date")
    rows, total = RP.list_page(docs, extracted, 2, 20, status="pending")
    whole = RP.page(RP.list_documents(docs, extracted, status="pending"), 2, 20).collect()
    assert [r.id for r in rows.collect()] == [r.id for r in whole] and {r.id: r.vendor_name for r in rows.collect()} == {r.id: r.vendor_name for r in whole}
    assert total.first().total == 300
    rows.explain()
    plan = capsys.readouterr().out
    assert "TakeOrdered" not in plan and "SortMergeJoin" not in plan


def stored(spark):
    folder = scratch_folder(spark, "files")
    content = spark.createDataFrame([("2.png", b"two"), ("3.png", b"three"), ("5.png", b"")], "name string, content binary")
    assert FI.write_files(content.filter("name <> '3.png'"), f"{folder}/up").count() == 2
    assert FI.write_files(content.filter("name = '3.png'"), f"{folder}/originals").count() == 1
    docs = spark.createDataFrame(
        [("1", "b25l", "/up/1.png"), ("2", None, "/up/2.png"), ("3", "*", "/up/3.png"), ("4", "", None), ("5", None, "/up/5.png")], "id string, file_content string, file_path string")
    docs = docs.withColumns({"original_filename": F.lit("x.png"), "mime_type": F.lit("image/png")})
    uploads = FI.list_files(spark, f"{folder}/up").select(F.concat(F.lit("/up/"), FI.file_name(F.col("path"))).alias("file_path"), "path")
    return docs, uploads, FI.list_files(spark, f"{folder}/originals").select(FI.file_name(F.col("path")).alias("file_key"), "path")


def test_bytes_are_read_last(spark, capsys):
    out = FI.resolve_bytes(*stored(spark))
    got = {r.id: (r.content_source, None if r.content is None else bytes(r.content)) for r in out.collect()}
    assert got == {"1": ("inline", b"one"), "2": ("upload", b"two"), "3": ("original", b"three"), "4": (None, None), "5": (None, None)}  # Spark lists no empty files
    out.explain("formatted")
    sections = capsys.readouterr().out.split("\n\n")
    moved = [x for x in sections if "Exchange" in x.split("\n")[0] and x.lstrip().startswith("(")]
    assert moved and not any(re.search(r"\bcontent#|_bytes", x) for x in moved)


def test_a_file_that_is_gone_is_null(spark):
    df = spark.createDataFrame([("/nowhere/x",), (None,)], "path string")
    assert [r.b for r in FI.read_contents(df, "path", "b").collect()] == [None, None]


def test_tasks_of_text_work_follow_the_rows(spark):
    few, many = spark.range(0, 1000, 1, 2), spark.range(0, 9 * TASK_ROWS, 1, 4)
    assert spread(few).rdd.getNumPartitions() == 4  # as many as cores
    assert spread(many).rdd.getNumPartitions() == 9 and spread(many).count() == 9 * TASK_ROWS
    assert spread(spark.range(0, 1000, 1, 30)).rdd.getNumPartitions() == 30


def test_queries_bound_what_one_task_sorts(spark, capsys):
    QUERIES["newest_rules"](spark, SF).explain()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\)", capsys.readouterr().out)]
    assert dealt and min(dealt) >= SHUFFLE_PARTITIONS


def test_amounts_without_digits_are_null(spark):
    got = spark.createDataFrame([("1,234",), ("¥5，600",), ("",), (",",), (None,), ("x",)], "t string").select(parse_amount(F.col("t")).alias("a")).collect()
    assert [None if r.a is None else int(r.a) for r in got] == [1234, 5600, None, None, None, None]


def test_a_text_is_narrowed_and_a_number_cleaned_once(spark, capsys):
    df = spark.createDataFrame([("登録番号 Ｔ７０００012050002", None), ("T7000012050003", "x"), ("none", " t7000012050002 "), ("none", "T1"), (None, None)], "text string, vendor_registration_no string")
    out = R.apply_registration(df, "text")
    assert [(r.vendor_registration_no, len(r.review_flags)) for r in out.collect()] == [
        ("T7000012050002", 0), ("T7000012050003", 1), (" t7000012050002 ", 0), ("T1", 1), (None, 0)]
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("translate(text") == 1 and plan.count("upper(") == 1


def test_white_space_goes_from_both_ends_only(spark):
    got = spark.createDataFrame([("　\x1c a b \n\r\n",), (" \t",), (None,)], "t string").select(strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["a b", "", None]


def test_history_moves_half_a_document_id(spark, capsys):
    h = fx.history(spark, SF)
    assert h.filter("document_id rlike '^[0-9a-f]{32}$'").count() == h.count()
    h.explain()
    assert "min(unhex(md5(" in capsys.readouterr().out


def test_an_encoder_stays_small():
    e = PK._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(x.nbytes for x in (e.pool, e.memo.keys, e.memo.values, e.memo.known)) < 16 << 20
