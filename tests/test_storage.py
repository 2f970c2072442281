"""Tables in folders, commit markers, images and reports read back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docledger.catalog import QUERIES
from docledger.sources.commits import commit_run, committed_runs, is_committed
from docledger.sources.tables import read_table, write_table
from docledger.streaming import streams as STR

HISTORY = "client_id string, vendor_name string, account_title string, tax_category string, payment_method string, use_count bigint, last_used_at timestamp"


def test_one_folder_is_replaced_and_reads_are_pruned(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), (None, "n")], "client_id string, vendor_name string")
    write_table(rows, base, "journal_history", by=("client_id",))
    write_table(spark.createDataFrame([("c1", "new")], "client_id string, vendor_name string"), base, "journal_history", "overwrite", by=("client_id",))
    back = read_table(spark, base, "journal_history")
    assert back.columns[:3] == ["client_id", "document_id", "vendor_name"]
    assert sorted((r.client_id or "", r.vendor_name) for r in back.collect()) == [("", "n"), ("c1", "new"), ("c2", "a")]
    plan = back.filter("client_id = 'c2'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(client_id" in plan


def test_markers(spark, tmp_path):
    base = str(tmp_path / "none")
    assert committed_runs(spark, base).isEmpty()
    commit_run(spark, base, "q", 3)
    commit_run(spark, base, "q", 3)
    assert is_committed(spark, base, "q", 3) and not is_committed(spark, base, "q", 4) and not is_committed(spark, base, "other", 3)
    assert committed_runs(spark, base).count() == 1


def test_a_batch_killed_between_two_tables_counts_once(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([("a", "c1", "青葉文具店\n2024年5月8日\n合計 1,100円\n"), ("b", "c1", "川上食堂\n2024年5月9日\n合計 2,200円\n")], "id string, client_id string, ocr_raw_text string")
    texts.write.parquet(str(tmp_path / "in"))
    out, whole = str(tmp_path / "out"), STR.write_batch

    def start():
        s = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
        return STR.stream_process(s, lambda session: session.createDataFrame([], HISTORY), out, str(tmp_path / "ckpt"), "2026-01-15", F.lit(dt.datetime(2026, 1, 15)))

    def dies(df, base, name, query, batch_id):
        if name == "extracted_data":
            raise RuntimeError("killed")
        whole(df, base, name, query, batch_id)

    monkeypatch.setattr(STR, "write_batch", dies)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert STR.read_batches(spark, out, "documents").isEmpty()
    monkeypatch.setattr(STR, "write_batch", whole)
    start().awaitTermination()
    assert [r.id for r in STR.read_batches(spark, out, "documents").orderBy("id").collect()] == ["a", "b"]
    assert STR.read_batches(spark, out, "extracted_data").count() == 2


@pytest.mark.parametrize("name, rows", [("scan_batch", 25), ("image_features", 50), ("read_test_report", 15), ("stream_dedupe_restarts", 2001)])
def test_queries_run(spark, name, rows):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= rows


@pytest.mark.parametrize("folder", [False, True])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, folder):
    pages = spark.createDataFrame([(0, "u0", "<p>a"), (1, "u1", None), (2, "u2", "<p>b")], "page_id bigint, url string, html string").repartition(3 if folder else 1)
    pages.write.parquet(str(tmp_path / ("pages.parquet" if folder else "written")))
    if not folder:
        next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    got = QUERIES["stream_intake"](spark, str(tmp_path)).orderBy("original_filename").collect()
    assert [(r.original_filename, r.content_hash is None) for r in got] == [("p0.PDF", False), ("p1.jpg", True), ("p2.html", False)]
