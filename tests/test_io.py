"""Byte sinks, report files, image statistics and binary file streams."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.operators import exports as EX
from docledger.sources import files as FI
from docledger.sources.images import gray_levels
from docledger.sources.reports import failed_cases, read_suites, read_test_report
from docledger.sources.sinks import write_export
from docledger.streaming.streams import stream_intake

DOC = "id string, client_id string, original_filename string, doc_type string, ocr_confidence double, approved_by string, approved_at timestamp"
EXT = ("document_id string, transaction_date date, vendor_name string, total_amount decimal(14,2), subtotal_amount decimal(14,2), tax_amount_10 decimal(14,2), "
       "tax_amount_8 decimal(14,2), payment_method string, account_title string, tax_category string, vendor_registration_no string, vendor_address string, "
       "vendor_phone string, invoice_number string, note string")


def office(spark):
    docs = [(f"{i:08d}-x", "c1" if i % 3 else "c2", f"f{i}.jpg", "receipt", 0.9, None, None) for i in range(20)]
    ext = [(f"{i:08d}-x", dt.date(2024, 1, i % 5 + 1), '店"A"', Decimal(1100), None, Decimal(100), None, "現金", None, None, None, None, None, None, None) for i in range(20)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(ext, EXT)


@pytest.mark.parametrize("fmt, encoding, heads", [("freee", "utf-8-sig", 1), ("yayoi", "cp932", 2), ("money_forward", "utf-8-sig", 1), ("generic_csv", "utf-8-sig", 1)])
def test_sink_bytes(spark, tmp_path, fmt, encoding, heads):
    docs, ext = office(spark)
    done = write_export(docs, ext, fmt, str(tmp_path), max_rows=5).collect()
    assert sum(r.row_count for r in done) == 20 and max(r.row_count for r in done) <= 5
    lines = []
    for r in done:
        raw = open(r.path, "rb").read()
        assert raw.startswith(b"\xef\xbb\xbf") == (encoding == "utf-8-sig") and raw.endswith(b"\r\n")
        body = raw.decode(encoding).split("\r\n")[:-1]
        assert body[:heads] == EX.DIALECTS[fmt][1]
        lines += body[heads:]
    assert len(lines) == 20 and all('店""A""' in x for x in lines)
    if fmt == "yayoi":
        assert sorted(x.split(",")[1] for x in lines) == [f'"{i:06d}"' for i in range(1, 21)]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        EX.export_lines(*office(spark), "mjs")


def test_junit(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<testsuites><testsuite name="w" tests="0"><testsuite name="s" tests="4" errors="0" failures="1" skipped="1" time="1.5">'
        '<testcase name="bad" classname="c"><failure message="boom"/></testcase><testcase name="good" classname="c"/></testsuite></testsuite></testsuites>')
    (tmp_path / "b.xml").write_text("no report")
    rows = {r.file.rsplit("/", 1)[-1]: r for r in read_test_report(spark, str(tmp_path)).collect()}
    a = rows["a.xml"]
    assert (a.total, a.passed, a.failed, a.skipped, a.pass_rate, a.time_seconds) == (4, 2, 1, 1, 50.0, 1.5)
    assert rows["b.xml"].total == 0 and rows["b.xml"].failed_cases == []
    assert [tuple(x) for x in a.failed_cases] == [("bad", "c", "boom")]
    assert [(r.name, r.message) for r in failed_cases(read_suites(spark, str(tmp_path / "a.xml"))).collect()] == [("bad", "boom")]


def test_gray_levels():
    assert gray_levels(bytes([255] * 12), 2, 2, 3).mean() == 255.0 and gray_levels(bytes([7, 9]), 1, 2, 1).tolist() == [[7.0, 9.0]]


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"d{i}.jpg").write_bytes(bytes([i]) * 10)
    once = {r.id for r in FI.scan_files(spark, str(src)).select("id").collect()}
    assert len(once) == 3 and once == {r.id for r in FI.scan_files(spark, str(src)).select("id").collect()}
    with pytest.raises(ValueError):
        FI.scan_batch(spark, str(src), "j", max_files=2)
    q = stream_intake(spark, str(src)).select("original_filename", F.length("content").alias("n")).writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.original_filename, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(f"d{i}.jpg", 10) for i in range(3)]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from docledger.session import ensure_checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_reruns_do_not_mix(spark, tmp_path):
    docs, ext = office(spark)
    runs = [write_export(docs, ext, "freee", str(tmp_path), files=n).collect() for n in (4, 1)]
    assert all(sum(r.row_count for r in done) == 20 for done in runs)
    assert not {r.path.split("/client=")[0] for r in runs[0]} & {r.path.split("/client=")[0] for r in runs[1]}


def test_small_files_share_tasks(spark, tmp_path):
    src = tmp_path / "many"
    src.mkdir()
    for i in range(1600):
        (src / f"p{i}.pdf").write_bytes(b"x")
    own = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        docs = FI.scan_batch(spark, str(src), "j")
        assert docs.count() == 1600 and docs.rdd.getNumPartitions() < 1600 // 32
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", own)
