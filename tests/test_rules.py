"""Suggestions, history and accounts against brute force and known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docledger.functions.vendor import vendor_key
from docledger.operators import accounts as A
from docledger.operators import containing
from docledger.operators import history as H
from docledger.operators import rules as RU

HISTORY = "client_id string, document_id string, vendor_name string, account_title string, tax_category string, payment_method string, use_count bigint, last_used_at timestamp, created_at timestamp"
DOCS = "id int, client_id string, vendor_name string, account_title string, tax_category string"


def rule(client, vendor, account, tax="課税仕入10%", uses=1, day=1):
    at = dt.datetime(2024, 1, day)
    return (client, None, vendor, account, tax, None, uses, at, at)


def suggest(spark, docs, history, **kw):
    d = spark.createDataFrame([(i, c, v, a, None) for i, (c, v, a) in enumerate(docs)], DOCS)
    h = spark.createDataFrame(history, HISTORY)
    out = RU.suggest_accounts(d, h, **kw).select("id", "suggestion.*").orderBy("id").collect()
    return [(r.account_title, r.match_type, r.confidence) for r in out]


KEYWORDS = [
    ("セブンイレブン金沢", "消耗品費"), ("中央タクシー", "旅費交通費"), ("JR北陸", "旅費交通費"), ("レストラン海風", "交際費"), ("水道局 中央", "水道光熱費"),
    ("ドコモショップ金沢", "通信費"), ("Amazonマーケット", "消耗品費"), ("スターバックス金沢", "会議費"), ("弁当の花", "福利厚生費"), ("名もなき店", None)]


def test_keywords(spark):
    df = RU.match_keyword(spark.createDataFrame(KEYWORDS, "vendor_name string, want string"))
    for r in df.collect():
        assert (r.suggestion.account_title if r.suggestion else None) == r.want, r.vendor_name


@pytest.mark.parametrize("stage", [True, False])
def test_cascade(spark, stage):
    history = [rule("a", "ヒカリ株式会社XYZ", "外注費"), rule("b", "川北電気工業", "修繕費"), rule(None, "みんなの店", "雑費", tax="軽減8%")]
    docs = [("a", "ﾋｶﾘ 株式会社ｘｙｚ", None), ("b", "川北電気", None), ("b", "新川北電気工業本店", None), ("b", "ヒカリ株式会社XYZ", None), (None, "みんなの店", None),
            ("c", "東京電力", None), ("c", "未知", "会議費"), ("c", "未知", None), ("c", None, "会議費"), ("c", "", None)]
    assert suggest(spark, docs, history, stage=stage) == [
        ("外注費", "exact", 0.97), ("修繕費", "partial", 0.85), ("修繕費", "partial", 0.85), ("外注費", "exact", 0.90), ("雑費", "exact", 0.97),
        ("水道光熱費", "keyword", 0.70), ("会議費", "vlm", 0.60), (None, "none", 0.0), ("会議費", "none", 0.30), (None, "none", 0.30)]


@pytest.mark.parametrize("cap, long", [(5, 64), (1000, 64), (None, 64), (None, 3)])
def test_partial_equals_brute_force(spark, cap, long, monkeypatch):
    monkeypatch.setattr(RU, "LONG", long)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    history = [rule("hot" if rnd.random() < 0.5 else f"c{rnd.randint(0, 3)}", word(), f"acc{i}", uses=rnd.randint(1, 50), day=rnd.randint(1, 28)) for i in range(120)]
    vendors = {("hot" if rnd.random() < 0.5 else f"c{rnd.randint(0, 3)}", word()) for _ in range(80)}
    h = spark.createDataFrame(history, HISTORY)
    v = spark.createDataFrame(sorted(vendors), "client_key string, vendor_name string").withColumn("vendor_key", F.col("vendor_name"))
    got = {(r.client_key, r.vendor_name): r.a for r in RU.match_partial(v, RU.client_rules(h, cap)).select("client_key", "vendor_name", F.col("suggestion.account_title").alias("a")).collect()}
    want = {}
    for client in {c for c, _ in vendors}:
        rows = [(r[0], r[2], r[3], r[6], r[7]) for r in history if r[0] == client]
        rows = sorted(rows, key=lambda r: (-r[3], -r[4].timestamp(), r[1], r[2]))[: cap or len(rows)]
        for name in [n for c, n in vendors if c == client]:
            for r in rows:
                if r[1] in name or name in r[1]:
                    want[(client, name)] = r[2]
                    break
    assert got == want and want


def test_vendor_key(spark):
    df = spark.createDataFrame([("㈱ ＡＢＣ　商店",), ("Plain Name ",), (None,)], "v string")
    assert [r.k for r in df.select(vendor_key(F.col("v")).alias("k")).collect()] == ["(株)abc商店", "plainname", None]


def test_learn_adds_up(spark):
    h = spark.createDataFrame([rule("a", "店", "雑費", uses=2, day=1)], HISTORY)
    ap = spark.createDataFrame([rule("a", "店", "雑費", day=5), rule("a", "店", "雑費", day=9), rule("a", "店", "会議費", tax=None, day=3), rule(None, "店", "雑費"),
                                rule(None, "店", "雑費"), rule("a", "", "雑費"), rule("a", "店", None)], HISTORY)
    rows = {(r.client_id, r.account_title): r for r in H.learn_history(h, ap).collect()}
    assert len(rows) == 3 and rows[("a", "雑費")].use_count == 4 and rows[("a", "雑費")].last_used_at.day == 9
    assert rows[("a", "会議費")].tax_category == "課税仕入10%" and rows[(None, "雑費")].use_count == 2


def test_caps(spark):
    h = spark.createDataFrame([rule("a", f"v{i}", "雑費", uses=i, day=i % 28 + 1) for i in range(30)], HISTORY)
    assert [r.vendor_name for r in H.top_per_client(h, 3).orderBy("rank").collect()] == ["v29", "v28", "v27"]
    assert H.newest_rules(h, 4).count() == 4 and H.newest_rules_global(h, 6).count() == 6
    with pytest.raises(ValueError):
        H.top_history(h, "a", 201)


def entries(spark, debit, credit="現金", tax="課税仕入10%", client="c1"):
    return spark.createDataFrame([(client, debit, credit, tax)], "client_id string, debit_account string, credit_account string, tax_category string")


@pytest.mark.parametrize("software, debit, expected", [
    ("freee", "消耗品費", ("1012", "1", "17")), ("freee", "旅費交通費", ("1013", "1", "17")), ("freee", "存在しない科目", ("1012", "1", "17")),
    ("money_forward", "謎の科目", ("謎の科目", "現金", "課税仕入10%")), ("yayoi", "消耗品費", ("消耗品費", "現金", "10")), ("unknown", "雑費", ("雑費", "現金", "課税仕入10%"))])
def test_resolve(spark, software, debit, expected):
    r = A.resolve_accounts(entries(spark, debit), software).collect()[0]
    assert (r.debit_code, r.credit_code, r.tax_code) == expected


@pytest.mark.parametrize("tax, codes", [("課税仕入8%軽減", ("30", "課税仕入8%軽", "11")), ("非課税", ("14", "非課税仕入", "14")), ("不課税", ("0", "対象外", "0")), ("?", ("17", "課税仕入10%", "10"))])
def test_tax_codes(spark, tax, codes):
    row = entries(spark, "雑費", tax=tax).select(*[A.tax_code(F.col("tax_category"), s).alias(s) for s in A.SOFTWARE]).collect()[0]
    assert tuple(row) == codes


def test_client_master(spark):
    ddl = "client_id string, internal_name string, freee_id int, mf_name string, yayoi_name string, mode string, seq int"
    ch = spark.createDataFrame([
        ("c1", "交通費", 1, None, None, "register", 1), ("c1", "交通費", 9999, "交通費カスタム", None, "register", 2),
        ("c2", "旧", 1, "a", "b", "register", 1), ("c2", "旅費", None, None, "旅費Y", "load", 2)], ddl)
    m = A.client_account_master(ch)
    rows = {(r.client_id, r.internal_name): (r.freee_id, r.mf_name, r.yayoi_name) for r in m.collect()}
    assert rows == {("c1", "交通費"): (9999, "交通費カスタム", "交通費"), ("c2", "旅費"): (None, None, "旅費Y")}
    assert A.resolve_accounts(entries(spark, "交通費"), "freee", m).collect()[0].debit_code == "9999"
    assert A.resolve_accounts(entries(spark, "旅費", client="c2"), "money_forward", m).collect()[0].debit_code is None
    assert A.resolve_accounts(entries(spark, "旅費", client="c2"), "freee", m).collect()[0].debit_code == "1012"


def test_large_client_is_spread(spark):
    """With broadcasts off, the substrings of one client's rules are exchanged by (client, substring) before they are grouped."""
    import contextlib
    import io

    h = spark.createDataFrame([rule("a", f"店{i}番", "雑費") for i in range(20)], HISTORY)
    v = spark.createDataFrame([("a", "店3番の隣")], "client_key string, vendor_name string").withColumn("vendor_key", F.col("vendor_name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            RU.match_partial(v, RU.client_rules(h), long=False).explain()
        plan = told.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    grouped = plan.index("Exchange hashpartitioning(client_key", plan.index("min(rule_order"))
    assert grouped < plan.index("_share", grouped)


def test_partial_rule_comes_with_its_order(spark):
    """The chosen rule is not looked up again: two joins for each of the two searches, and none after them."""
    import contextlib
    import io

    h = spark.createDataFrame([rule("a", "川北電気工業", "修繕費", tax="軽減8%"), rule("a", "川北電気", "雑費", tax="非課税", uses=3)], HISTORY)
    v = spark.createDataFrame([("a", "川北電気工業本店"), ("a", "北電気工")], "client_key string, vendor_name string").withColumn("vendor_key", F.col("vendor_name"))
    found = RU.match_partial(v, RU.client_rules(h), long=False)
    assert sorted((r.vendor_name, *r.suggestion) for r in found.collect()) == [
        ("北電気工", "修繕費", "課税仕入8%軽減", "partial", 0.85, "川北電気工業"), ("川北電気工業本店", "雑費", "非課税", "partial", 0.85, "川北電気")]
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        found.explain()
    assert sum("Join " in line for line in told.getvalue().split("== Initial Plan ==")[0].splitlines()) == 4


HEX = "0123456789abcdef0123456789abcdef"


def test_packed_clients_come_back(spark):
    """Only even numbers of lower-case digits are halved, and no two ids meet."""
    ids = [HEX, HEX.upper(), HEX[:-1], HEX + "\n", "ab", "\xab", "_global", "顧客1", "0", "00", ""]
    df = spark.createDataFrame([(i,) for i in ids], "c string").withColumn("p", RU._packed(F.col("c"))).withColumn("back", RU._unpacked(F.col("p")))
    rows = df.collect()
    assert [r.back for r in rows] == ids and len({bytes(r.p) for r in rows}) == len(ids) and len(rows[0].p) == 17


@pytest.mark.parametrize("pairs", [0, 6, 64])
def test_staged_partial_equals_brute_force(spark, pairs, monkeypatch):
    """Clients of few names compare their rules in place, the others by substrings; long and empty names, a name written twice."""
    monkeypatch.setattr(RU, "PAIRS", pairs)
    monkeypatch.setattr(RU, "LONG", 5)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab東") for _ in range(rnd.randint(1, 7)))
    who = lambda: HEX if rnd.random() < 0.4 else f"c{rnd.randint(0, 3)}"
    history = [rule(who(), word(), f"acc{i}", uses=rnd.randint(1, 50), day=rnd.randint(1, 28)) for i in range(100)] + [rule("c0", "　", "空", uses=99)]
    vendors = sorted({(who(), word()) for _ in range(60)} | {("c0", " "), ("c0", "A b"), ("c0", "ab"), ("none", "ab")})
    v = spark.createDataFrame(vendors, "client_key string, vendor_name string").withColumn("vendor_key", vendor_key(F.col("vendor_name")))
    found = RU.match_partial(v, RU.client_rules(spark.createDataFrame(history, HISTORY)), stage=True)
    got = sorted((r.client_key, r.vendor_name, r.suggestion.account_title) for r in found.collect())
    want = []
    for client, name in vendors:
        key = "".join(name.lower().split())
        best = sorted(((-r[6], -r[7].timestamp(), r[2], r[3]) for r in history if r[0] == client and key and r[2].strip() and (r[2] in key or key in r[2])))
        want += [(client, name, best[0][3])] if best else []
    assert got == sorted(want) and want


@pytest.mark.parametrize("cap", [None, 4])
def test_staged_suggestions_equal_plain_ones(spark, cap, monkeypatch):
    """One client above PAIRS and several below it, documents and history without a client, repeated rows, names of white space."""
    monkeypatch.setattr(RU, "PAIRS", 5)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abＸ東 ") for _ in range(rnd.randint(1, 5)))
    who = lambda: rnd.choice([HEX, HEX, HEX, "c1", "c2", "c3", "", None])
    history = [rule(who(), word(), rnd.choice(["雑費", "会議費", "", None]), tax=rnd.choice(["軽減8%", "", None]), uses=rnd.randint(1, 9), day=rnd.randint(1, 28)) for _ in range(60)]
    docs = [(who(), rnd.choice([word(), word(), "東京電力", "", None]), rnd.choice(["会議費", None])) for _ in range(80)]
    docs += [("c4", "ab", None)] * 2
    assert suggest(spark, docs, history * 2, cap=cap) == suggest(spark, docs, history * 2, cap=cap, stage=False)


def test_few_names_make_no_substrings(spark, monkeypatch):
    """History rows of clients with few names are compared where they lie; only a client with more names goes to the joins on substrings."""
    asked = []
    plain = RU.match_partial
    monkeypatch.setattr(RU, "match_partial", lambda vendors, *a, **kw: (asked.extend(r.client_key for r in vendors.collect()), plain(vendors, *a, **kw))[1])
    history = [rule(c, f"店{i}番", "雑費", uses=i) for c in ("a", "b") for i in range(9)]
    docs = [("a", f"店{i}番の隣", None) for i in range(3)] + [("b", f"新店{i}番", None) for i in range(9)]
    monkeypatch.setattr(RU, "PAIRS", 8)
    assert {r[1] for r in suggest(spark, docs, history)} == {"partial"}
    assert set(asked) == {"b"}


def test_names_inside_equals_brute_force(spark, monkeypatch):
    """Ties, repeats, nulls and empty names; a client split into shares by its count; other clients' names never match."""
    monkeypatch.setattr(containing, "PER_SHARE", 7)
    rnd = random.Random(3)
    word = lambda most: "".join(rnd.choice("ab東") for _ in range(rnd.randint(1, most)))
    texts = [("hot" if i % 3 else "c", word(40)) for i in range(60)] + [("c", ""), ("c", None), (None, "ab")]
    names = [("hot" if i % 2 else "c", word(9)) for i in range(60)] + [("hot", "a"), ("hot", "a"), ("c", ""), ("c", None), ("d", "b")]
    t = spark.createDataFrame(texts, "client_key string, text string")
    found = containing.names_inside(t, "text", spark.createDataFrame(names, "client_key string, name string"), "name")
    got = {tuple(r) for r in found.select("client_key", "text", "name").collect()}
    assert got == {(c, x, n) for c, x in texts for d, n in names if c == d and c and x and n and n in x}
    shares = containing.with_client(t, t.filter("client_key is not null").select("client_key").distinct(), "text")
    assert shares.count() == len([x for c, x in texts if c])


def test_a_long_name_is_no_burst(spark):
    """A name of 5,000 characters looks up its windows at powers of two, here one for each place and each of two entry lengths."""
    long = "".join(chr(0x4E00 + (i * i * 7 + i) % 3001) for i in range(5000))
    v = spark.createDataFrame([("a", long, long)], "client_key string, vendor_name string, vendor_key string")
    history = [rule("a", long[4000:4000 + n], f"科目{n}", uses=n) for n in range(2, 60)] + [rule("a", long + "外", "長い", uses=1)]
    found = RU.match_partial(v, RU.client_rules(spark.createDataFrame(history, HISTORY))).collect()
    assert [r.suggestion.account_title for r in found] == ["科目59"]
    entries = containing.index(spark.createDataFrame([("a", long[:n]) for n in (16, 17, 31, 40)], "client_key string, name string"), "name")
    assert sorted((len(r.start), r.n) for r in entries.collect()) == [(16, 16), (16, 17), (16, 31), (32, 40)]


def test_keyword_table(spark):
    table = spark.createDataFrame([(2, "Taxi", "旅費", None), (1, "tax", "租税", "非課税"), (3, "", "空", None), (4, None, "無", None)], "rule_id int, keyword string, account_title string, tax_category string")
    v = spark.createDataFrame([("City TAXI",), ("city taxi",), ("bus",), (None,)], "vendor_name string")
    assert {r.vendor_name: r.suggestion.account_title for r in RU.match_keyword_table(v, table).collect()} == {"City TAXI": "租税", "city taxi": "租税"}


def test_no_cap_is_the_whole_history(spark):
    h = spark.createDataFrame([rule("a", "同じ店", "古い", uses=3, day=1), rule("a", "同じ店", "新しい", uses=3, day=9)], HISTORY)
    for cap in (None, 500):
        assert RU.client_rules(h, cap).first().rule.account_title == "新しい"
