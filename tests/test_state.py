"""State changes under repeated requests, gaps in versions, long holidays."""

import datetime as dt

from pyspark.sql import functions as F

from docledger.operators import audit as AU
from docledger.operators import retention as RE
from docledger.operators import state as S
from docledger.sources.commits import run_path

DOCS = "id string, status string, approved_by string, approved_at timestamp, processing_error string"


def docs(spark):
    return spark.createDataFrame([("a", "pending", None, None, None), ("b", "approved", "x", None, None), ("c", "uploaded", None, None, "old")], DOCS)


def test_repeated_approvals(spark):
    at = [dt.datetime(2024, 1, d) for d in (3, 2, 5)]
    req = spark.createDataFrame([("a", "late", at[0]), ("a", "early", at[1]), ("b", "z", at[2]), ("q", "z", at[2]), ("q", "z", at[2])], "id string, approved_by string, approved_at timestamp")
    ok, no = S.approve(docs(spark), req)
    assert [(r.id, r.approved_by, r.status) for r in ok.collect()] == [("a", "early", "approved")]
    assert sorted((r.id, r.reason) for r in no.collect()) == [("a", "repeated"), ("b", "not_approvable:approved"), ("q", "not_found"), ("q", "repeated")]


def test_repeated_rejections(spark):
    req = spark.createDataFrame([("a", "blurred"), ("a", "again"), ("a", None), ("c", None)], "id string, reason string")
    rows = {r.id: (r.status, r.processing_error) for r in S.reject(docs(spark), req).collect()}
    assert rows == {"a": ("rejected", "差し戻し: again; blurred"), "b": ("approved", None), "c": ("rejected", "old")}


def test_repeated_corrections(spark):
    ext = spark.createDataFrame([("a", "店", 1), ("b", "別", 2)], "document_id string, vendor_name string, note string")
    patches = spark.createDataFrame([("a", "一", None, 1), ("a", "二", "n", 2), ("a", None, None, 3)], "document_id string, vendor_name string, note string, seq int")
    d, e = S.apply_corrections(docs(spark), ext, patches, order="seq")
    assert d.count() == 3 and {r.document_id: (r.vendor_name, r.note) for r in e.collect()} == {"a": ("二", "n"), "b": ("別", "2")}


def test_versions_with_gaps(spark):
    log = spark.createDataFrame([("k", 1, "x", "p"), ("k", 3, "x", "q"), ("k", 9, "y", "q"), ("m", 4, None, "p")], "id string, version int, s string, p string")
    rows = {(r.id, r.version): (r.is_first, sorted(r.changes)) for r in AU.version_history(log, "id", "version", ["s", "p"]).collect()}
    assert rows == {("k", 1): (True, ["p", "s"]), ("k", 3): (False, ["p"]), ("k", 9): (False, ["s"]), ("m", 4): (True, ["p"])}


def test_long_holidays(spark):
    scans = spark.createDataFrame([(1, dt.datetime(2024, 1, 4, 9)), (2, dt.datetime(2024, 6, 3, 8)), (3, None)], "i int, at timestamp")
    off = spark.createDataFrame([(dt.date(2024, 1, 5) + dt.timedelta(d),) for d in range(60)], "holiday date")
    got = {r.i: r.deadline for r in RE.timestamp_deadline_with_holidays(scans, "at", off).collect()}
    assert got == {1: dt.datetime(2024, 3, 6, 9), 2: dt.datetime(2024, 6, 5, 8), 3: None}


def test_jsonl_round_trip(spark, tmp_path):
    base = spark.createDataFrame([("1", dt.datetime(2024, 1, 1, 5), "login"), ("2", dt.datetime(2024, 1, 2, 5), "export")], "id string, at timestamp, what string")
    events = AU.audit_events(base, event_id=F.col("id"), at=F.col("at"), event_type=F.col("what"), user=F.lit(""), resource_type=F.lit("document"), resource_id=F.col("id"))
    base = str(tmp_path / "log")
    assert AU.write_jsonl(events, base, "a") and not AU.write_jsonl(events, base, "a") and AU.write_jsonl(events.filter("id = '1'"), base, "b")
    events.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").json(run_path(base, AU.LOG, "c", 0))  # a run that stopped before its marker
    back = AU.read_jsonl(spark, base).collect()
    assert sorted(r.id for r in back) == ["1", "1", "2"] and {r.user_id for r in back} == {"anonymous"} and {str(r.day) for r in back} == {"2024-01-01", "2024-01-02"}
    assert AU.write_jsonl(events.filter("id = '2'"), base, "c")
    assert sorted(r.id for r in AU.read_jsonl(spark, base).collect()) == ["1", "1", "2", "2"]
