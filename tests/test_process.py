"""The whole run: engine replies, skipped documents, failures beside good ones."""

import pytest
from pyspark.sql import functions as F

from docledger.catalog import QUERIES
from docledger.operators.retention import scan_compliance
from docledger.plans.process import NO_ORIGINAL, UNREADABLE_REPLY, failing, new_or_changed, process, read_replies
from docledger.sources.engines import FIELD_TYPES

AT = "timestamp'2026-01-15 00:00:00'"
HISTORY = "client_id string, vendor_name string, account_title string, tax_category string, payment_method string, use_count bigint, last_used_at timestamp"
RAW = "id string, refined_json string, mapped_vendor string, mapped_total string, model_json string"


def texts():
    good = "青葉文具店\n2024年5月8日\n合計 1,100円\n"
    return [("a", "c1", good, "h1"), ("b", "c1", "川上食堂\n2024年5月9日\n合計 2,200円\n", "h2"), ("gone", "c1", None, "h3"), ("same", "c1", good, "h4"), ("changed", None, good, "new")]


def run(spark, rows, replies=None, processed=None, **more):
    docs = spark.createDataFrame(rows, "id string, client_id string, ocr_raw_text string, content_hash string")
    done = None if processed is None else spark.createDataFrame(processed, "id string, content_hash string")
    return process(docs, spark.createDataFrame([], HISTORY), "2026-01-15", F.expr(AT), replies=replies, processed=done, **more)


def told(tables):
    return {r.id: r.asDict() for r in tables["documents"].collect()}, {r.document_id: r.asDict() for r in tables["extracted_data"].collect()}


def replies_of(spark, rows):
    df = spark.createDataFrame(rows, RAW)
    named = {n: F.lit(None).cast(t) for n, t in FIELD_TYPES.items()} | {"vendor_name": F.col("mapped_vendor"), "total_amount": F.col("mapped_total").cast("decimal(14,2)")}
    mapped = F.when(F.col("mapped_vendor").isNotNull(), F.struct(*[c.alias(n) for n, c in named.items()]))
    return read_replies(df.select("id", "refined_json", "model_json", mapped.alias("mapped"), F.lit(0.9).alias("mapped_conf")))


def test_one_bad_document_leaves_the_others_as_they_are(spark):
    alone = told(run(spark, texts()[:2]))
    tables = run(spark, texts()[:3])
    docs, extracted = told(tables)
    assert {k: docs[k] for k in "ab"} == alone[0] and extracted == alone[1]
    bad = docs["gone"]
    assert bad["status"] == "uploaded" and bad["processing_error"] == NO_ORIGINAL
    assert all(bad[c] is None for c in ("doc_type", "confidence_tier", "confidence_score", "review_flags", "processed_at", "approved_by"))
    assert [r.id for r in tables["failed"].collect()] == ["gone"]


def test_unchanged_documents_are_left_out(spark):
    docs, _ = told(run(spark, texts()[3:], processed=[("same", "h4"), ("changed", "old")]))
    assert set(docs) == {"changed"}
    docs, _ = told(run(spark, texts()[3:], processed=[]))
    assert set(docs) == {"same", "changed"}


def test_sources_in_order(spark):
    rows = [(k, "c", "青葉文具店\n合計 1,100円\n", k) for k in ("refined", "mapped", "lacking", "model", "none", "broken refinement", "broken model", "broken but mapped")]
    rows += [("no text", "c", None, "x"), ("nothing", "c", None, "y"), ("broken and no text", "c", None, "z")]
    told_by = [
        ("refined", 'Sure: {"vendor_name": "R", "total_amount": "1,000"} ok', "M", "5", '{"vendor_name": "V"}'),
        ("mapped", None, "M", "5", '{"vendor_name": "V"}'),
        ("lacking", None, "M", None, None),
        ("model", None, None, None, '{"vendor_name": "V", "total_amount": 7, "doc_type": "invoice"}'),
        ("broken refinement", "{", None, None, '{"vendor_name": "V", "total_amount": 7}'),
        ("broken model", None, None, None, "I cannot read this"),
        ("broken but mapped", None, "M", "5", "I cannot read this"),
        ("no text", None, None, None, '{"vendor_name": "V", "total_amount": 7}'),
        ("broken and no text", None, None, None, "{{"),
    ]
    docs, extracted = told(run(spark, rows, replies_of(spark, told_by)))
    got = {k: (docs[k]["source"], extracted[k]["vendor_name"], int(extracted[k]["total_amount"])) for k in extracted}
    assert got == {
        "refined": ("refined", "R", 1000), "mapped": ("mapped", "M", 5), "lacking": ("mapped", "M", 1100), "model": ("fallback", "V", 7), "none": ("text", "青葉文具店", 1100),
        "broken refinement": ("fallback", "V", 7), "broken but mapped": ("mapped", "M", 5), "no text": ("fallback", "V", 7),
    }
    assert docs["model"]["doc_type"] == "invoice"
    errors = {k: d["processing_error"] for k, d in docs.items() if d["processing_error"]}
    assert errors == {"broken model": UNREADABLE_REPLY, "broken and no text": UNREADABLE_REPLY, "nothing": NO_ORIGINAL}


def test_the_first_error_stays(spark):
    df = spark.createDataFrame([(1, None), (2, "before"), (3, None)], "n int, processing_error string")
    got = failing(failing(df, {"odd": F.col("n") % 2 == 1, "big": F.col("n") > 2}), {"later": F.col("n") > 0})
    assert [r.processing_error for r in got.orderBy("n").collect()] == ["odd", "before", "odd"]


def test_scan_records_of_good_and_bad_documents(spark):
    docs = spark.createDataFrame(texts()[:3], "id string, client_id string, ocr_raw_text string, content_hash string").withColumns({
        "file_size_bytes": F.lit(1000).cast("bigint"),
        "compliance": scan_compliance(F.lit(150), F.lit("rgb"), F.lit(2000), F.lit(3000), F.lit(1000), F.lit(210.0), F.lit(297.0)),
    })
    tables = process(docs, spark.createDataFrame([], HISTORY), "2026-01-15", F.expr(AT))
    got = {r.document_id: r for r in tables["scan_timestamps"].collect()}
    assert set(got) == {"a", "b", "gone"} and not got["gone"].is_compliant and got["a"].image_hash == "h1" and got["a"].input_user == "c1"
    assert "compliance" not in tables["documents"].columns


def test_documents_are_shuffled_once_for_hashes_and_replies(spark):
    """NULL ids and hashes count as new, an id may have several hashes, and a join by id needs no second exchange of the documents."""
    import contextlib
    import io

    rows = [("a", "1"), ("a", "2"), ("a", None), (None, "1"), ("b", "1"), ("b", "1"), ("c", "1")]
    docs = spark.createDataFrame(rows, "id string, content_hash string").withColumn("more", F.lit(1))
    done = spark.createDataFrame([("a", "2"), ("a", "3"), ("a", "2"), ("a", None), (None, "1"), ("c", "1")], "id string, content_hash string")
    new = new_or_changed(docs, done)
    assert new.columns == ["id", "content_hash", "more"]
    assert sorted(map(str, new.drop("more").collect())) == sorted(map(str, docs.drop("more").join(done, ["id", "content_hash"], "left_anti").collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            new_or_changed(docs, done).join(done.select("id", F.lit(2).alias("reply")), "id", "left").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.getvalue().count("Exchange hashpartitioning") == 3  # documents, hashes, replies


def test_few_rules_meet_documents_without_a_shuffle(spark, monkeypatch):
    """The rules found are written before documents are joined, so few of them go to the documents and the texts stay where they are. The
    two stages that hold texts are written with the smaller codec."""
    import contextlib
    import glob
    import io

    from docledger.plans import process as plan

    frames, kept, real = {}, {}, plan.keep

    def keep(df, name, *more):
        frames[name], kept[name] = df, real(df, name, *more)
        return kept[name]

    monkeypatch.setattr(plan, "keep", keep)
    history = spark.createDataFrame([("c1", "青葉文具", "消耗品費", "課税10%", None, 3, None), (None, "川上食堂", "会議費", None, None, 1, None)], HISTORY)
    docs = spark.createDataFrame(texts()[:3], "id string, client_id string, ocr_raw_text string, content_hash string")
    out = process(docs, history, "2026-01-15", F.expr(AT))["extracted_data"].collect()
    assert {r.document_id: r.account_title for r in out} == {"a": "消耗品費", "b": "会議費"}
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frames["scored"].explain()
    assert "BroadcastHashJoin" in text.getvalue() and "Exchange hashpartitioning" not in text.getvalue()
    for name in ("fields", "scored"):
        folder = kept[name].inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert glob.glob(f"{folder}/*.zstd.parquet")


def test_no_documents(spark):
    assert all(df.isEmpty() for df in run(spark, [], replies_of(spark, [])).values())


@pytest.mark.parametrize("name", ["process_documents", "list_files"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 10
