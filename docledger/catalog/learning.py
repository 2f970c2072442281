"""Account rules, learned history, account resolution and ledger rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger import constants as C
from docledger.catalog.base import num, query, stamp
from docledger.functions.vendor import vendor_key
from docledger.operators import accounts as A
from docledger.operators import history as H
from docledger.operators import rules as RU
from docledger.plans import fixtures as fx
from docledger.sources.tables import raw

K = fx.K
_CLIENT = "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE md5('client' || cast(o_custkey as string)) END"

# vendors of the rule documents: the smallest supplier of the order (so the client knows it), written in several ways
_NAME = fx.case(f"{K} % 7", ["s_name", "s_name || ' 本店'", "substr(s_name, 10)", "upper(s_name)", "'Ｘ' || s_name", None], fx.VENDOR)
_RULE_DOCS_SQL = f"""
SELECT {K} AS doc_id, {_CLIENT} AS client_id, {_NAME} AS vendor_name, {fx.ACCOUNT} AS account_title, {fx.TAX_CATEGORY} AS tax_category
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) ON l_orderkey = {K} LEFT JOIN supplier ON s_suppkey = sk"""
_HISTORY = fx.HISTORY_SQL.replace(f"md5('client' || {fx.s('o_custkey')}) AS client_id", f"{_CLIENT} AS client_id")


def rule_docs(spark, sf):
    first = raw(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"))
    o, s = raw(spark, sf, "orders"), raw(spark, sf, "supplier").select("s_suppkey", "s_name")
    j = o.join(first, o.o_orderkey == first.l_orderkey, "left").join(s, F.col("sk") == s.s_suppkey, "left")
    return j.selectExpr(f"{K} AS doc_id", f"{_CLIENT} AS client_id", f"{_NAME} AS vendor_name", f"{fx.ACCOUNT} AS account_title", f"{fx.TAX_CATEGORY} AS tax_category")


def rule_history(spark, sf):
    """History where one customer in seventeen has no client of its own."""
    return fx.history(spark, sf, _CLIENT)


_TAX = f"CASE tax_category {' '.join(f'WHEN {fx.q(k)} THEN {fx.q(v)}' for k, v in C.TAX_ALIASES.items())} ELSE tax_category END"
_VKEY = "lower(regexp_replace(replace(vendor_name, 'Ｘ', 'X'), '\\s+', '', 'g'))"
_RULES_CTE = f"""
WITH h AS (SELECT *, coalesce(client_id, '_global') AS ck FROM ({_HISTORY})),
ranked AS (SELECT *, {_VKEY} AS vk, row_number() OVER (PARTITION BY ck ORDER BY use_count DESC, last_used_at DESC, vendor_name, account_title) AS rk FROM h),
client_rules AS (SELECT ck, vk, vendor_name AS rv, account_title AS ra, {_TAX} AS rt, rk FROM ranked
  QUALIFY row_number() OVER (PARTITION BY ck, vk ORDER BY rk) = 1),
global_rules AS (SELECT vk, vendor_name AS rv, account_title AS ra, {_TAX} AS rt FROM ranked
  QUALIFY row_number() OVER (PARTITION BY vk ORDER BY last_used_at DESC, use_count DESC, vendor_name DESC, account_title DESC, tax_category DESC) = 1),
docs AS (SELECT *, coalesce(client_id, '_global') AS ck, {_VKEY} AS vk FROM ({_RULE_DOCS_SQL})),
names AS (SELECT DISTINCT ck, vendor_name, vk FROM docs WHERE vendor_name IS NOT NULL),
exact AS (SELECT n.*, ra, rt, rv FROM names n JOIN client_rules r USING (ck, vk)),
partial AS (SELECT n.ck, n.vendor_name, n.vk, ra, rt, rv FROM names n JOIN client_rules r ON n.ck = r.ck AND (contains(n.vk, r.vk) OR contains(r.vk, n.vk))
  QUALIFY row_number() OVER (PARTITION BY n.ck, n.vendor_name ORDER BY rk, r.vk) = 1),
everywhere AS (SELECT n.*, ra, rt, rv FROM names n JOIN global_rules r USING (vk)),
kw AS (SELECT DISTINCT vendor_name, CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(vendor_name), {fx.q(w.lower())})' for w in ws)} THEN {i}" for i, (ws, _, _) in enumerate(C.KEYWORD_RULES))} END AS rule FROM names)"""
_KW = lambda at: f"CASE rule {' '.join(f'WHEN {i} THEN {fx.q(r[at])}' for i, r in enumerate(C.KEYWORD_RULES))} END"


def _flat(df, *keys):
    s = F.col("suggestion")
    return df.select(*keys, s["account_title"].alias("account_title"), s["tax_category"].alias("tax_category"), s["match_type"].alias("match_type"),
                     s["confidence"].alias("confidence"), s["matched_vendor"].alias("matched_vendor"))


def _found(table: str, kind: str, conf: float) -> str:
    return (f"{_RULES_CTE} SELECT ck AS client_key, vendor_name, ra AS account_title, rt AS tax_category, '{kind}' AS match_type, "
            f"{conf}::double AS confidence, rv AS matched_vendor FROM {table}")


@query("rules_exact", _found("exact", "exact", 0.97))
def rules_exact(spark, sf):
    v = RU.distinct_vendors(rule_docs(spark, sf))
    return _flat(RU.match_exact(v, RU.client_rules(rule_history(spark, sf))).filter("suggestion is not null"), "client_key", "vendor_name")


@query("rules_partial", _found("partial", "partial", 0.85))
def rules_partial(spark, sf):
    v = RU.distinct_vendors(rule_docs(spark, sf))
    return _flat(RU.match_partial(v, RU.client_rules(rule_history(spark, sf)), stage=True), "client_key", "vendor_name")


@query("rules_global", _found("everywhere", "exact", 0.90))
def rules_global(spark, sf):
    v = RU.distinct_vendors(rule_docs(spark, sf))
    return _flat(RU.match_global(v, RU.global_rules(rule_history(spark, sf))).filter("suggestion is not null"), "client_key", "vendor_name")


@query("rules_keyword", f"""WITH n AS (SELECT DISTINCT {fx.VENDOR} AS vendor_name FROM orders),
kw AS (SELECT vendor_name, CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(vendor_name), {fx.q(w.lower())})' for w in ws)} THEN {i}" for i, (ws, _, _) in enumerate(C.KEYWORD_RULES))} END AS rule FROM n)
SELECT vendor_name, {_KW(1)} AS account_title, {_KW(2)} AS tax_category, CASE WHEN rule IS NOT NULL THEN 'keyword' END AS match_type, CASE WHEN rule IS NOT NULL THEN 0.7::double END AS confidence FROM kw""")
def rules_keyword(spark, sf):
    n = raw(spark, sf, "orders").selectExpr(f"{fx.VENDOR} AS vendor_name").distinct()
    return _flat(RU.match_keyword(n), "vendor_name").drop("matched_vendor")


# an office's own rules: every part name is a keyword for vendors described by part type and name
_OWN_RULES = "SELECT p_partkey AS rule_id, p_name AS keyword, p_brand AS account_title, p_type AS tax_category FROM part"
_OWN_NAMES = "SELECT DISTINCT upper(p_name) || ' ' || p_type || ' store' AS vendor_name FROM part"


@query("rules_keyword_table", f"""
WITH r AS ({_OWN_RULES}), n AS ({_OWN_NAMES})
SELECT vendor_name, account_title, tax_category FROM n JOIN r ON contains(lower(vendor_name), lower(keyword))
QUALIFY row_number() OVER (PARTITION BY vendor_name ORDER BY rule_id) = 1""")
def rules_keyword_table(spark, sf):
    p = raw(spark, sf, "part")
    table = p.selectExpr("p_partkey AS rule_id", "p_name AS keyword", "p_brand AS account_title", "p_type AS tax_category")
    names = p.selectExpr("upper(p_name) || ' ' || p_type || ' store' AS vendor_name").distinct()
    return _flat(RU.match_keyword_table(names, table), "vendor_name").select("vendor_name", "account_title", "tax_category")


_CASCADE = f"""{_RULES_CTE},
j AS (SELECT d.doc_id, d.vendor_name, d.account_title, d.tax_category, e.ra AS ea, e.rt AS et, e.rv AS ev, p.ra AS pa, p.rt AS pt, p.rv AS pv, g.ra AS ga, g.rt AS gt, g.rv AS gv, rule
  FROM docs d LEFT JOIN exact e USING (ck, vendor_name) LEFT JOIN partial p USING (ck, vendor_name) LEFT JOIN everywhere g USING (ck, vendor_name) LEFT JOIN kw USING (vendor_name)),
c AS (SELECT *, CASE WHEN vendor_name IS NULL THEN 'none0' WHEN ea IS NOT NULL THEN 'exact' WHEN pa IS NOT NULL THEN 'partial' WHEN ga IS NOT NULL THEN 'global'
  WHEN rule IS NOT NULL THEN 'keyword' WHEN account_title IS NOT NULL THEN 'vlm' ELSE 'none' END AS k FROM j),
r AS (SELECT doc_id, account_title AS given_account, tax_category AS given_tax, CASE k WHEN 'none0' THEN 'none' WHEN 'global' THEN 'exact' ELSE k END AS match_type,
  CASE k WHEN 'none0' THEN 0.3 WHEN 'exact' THEN 0.97 WHEN 'partial' THEN 0.85 WHEN 'global' THEN 0.9 WHEN 'keyword' THEN 0.7 WHEN 'vlm' THEN 0.6 ELSE 0 END::double AS confidence,
  CASE k WHEN 'none0' THEN account_title WHEN 'exact' THEN ea WHEN 'partial' THEN pa WHEN 'global' THEN ga WHEN 'keyword' THEN {_KW(1)} WHEN 'vlm' THEN account_title END AS account_title,
  CASE k WHEN 'none0' THEN tax_category WHEN 'exact' THEN et WHEN 'partial' THEN pt WHEN 'global' THEN gt WHEN 'keyword' THEN {_KW(2)} WHEN 'vlm' THEN {_TAX} END AS tax_category,
  CASE k WHEN 'exact' THEN ev WHEN 'partial' THEN pv WHEN 'global' THEN gv END AS matched_vendor FROM c)"""


@query("suggest_accounts", f"{_CASCADE} SELECT doc_id, account_title, tax_category, match_type, confidence, matched_vendor FROM r")
def suggest_accounts(spark, sf):
    return _flat(RU.suggest_accounts(rule_docs(spark, sf), rule_history(spark, sf)), "doc_id")


@query("apply_suggestion", f"""{_CASCADE}
SELECT doc_id, CASE WHEN confidence > 0.7 THEN coalesce(account_title, given_account) ELSE given_account END AS account_title,
  coalesce(tax_category, given_tax, '課税仕入10%') AS tax_category FROM r""")
def apply_suggestion(spark, sf):
    return RU.apply_suggestion(RU.suggest_accounts(rule_docs(spark, sf), rule_history(spark, sf))).select("doc_id", "account_title", "tax_category")


@query("normalize_tax_category", f"SELECT DISTINCT tax_category AS raw_label, {_TAX} AS label FROM ({fx.HISTORY_SQL})")
def normalize_tax_category(spark, sf):
    return fx.history(spark, sf).select("tax_category").distinct().select(
        F.col("tax_category").alias("raw_label"), RU.normalize_tax(F.col("tax_category")).alias("label"))


_AZ, _WIDE_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26))
_WRITTEN = f"CASE p_partkey % 3 WHEN 0 THEN '㈱　' || translate(upper(p_name), '{_AZ}', '{_WIDE_AZ}') WHEN 1 THEN 'ｶﾞｽ ' || p_name ELSE '山田商店ガス ' || p_name END"


@query("vendor_key", f"""
SELECT p_partkey, {_WRITTEN} AS vendor_name, CASE p_partkey % 3 WHEN 0 THEN '(株)' WHEN 1 THEN 'ガス' ELSE '山田商店ガス' END || lower(regexp_replace(p_name, '\\s+', '', 'g')) AS vendor_key FROM part""")
def vendor_keys(spark, sf):
    """Names with wide letters, wide spaces, a company sign and half-width kana."""
    p = raw(spark, sf, "part").selectExpr("p_partkey", f"{_WRITTEN} AS vendor_name")
    return p.withColumn("vendor_key", vendor_key(F.col("vendor_name")))


# --- history --------------------------------------------------------------------------------------
@query("history_rank", f"""
SELECT client_id, vendor_name, use_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY use_count DESC, last_used_at DESC, vendor_name, account_title) AS rank FROM ({fx.HISTORY_SQL}))
WHERE rank <= 500""")
def history_rank(spark, sf):
    return H.top_per_client(fx.history(spark, sf), 500).select("client_id", "vendor_name", "use_count", F.col("rank").cast("bigint").alias("rank"))


_NEWEST = """
WITH h AS ({history}), k AS (SELECT *, coalesce(client_id, '_global') AS ck, lower(regexp_replace(vendor_name, '\\s+', '', 'g')) AS vk FROM h),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY last_used_at DESC, use_count DESC, vendor_name DESC, account_title DESC, tax_category DESC) = 1)"""


@query("newest_rules", _NEWEST.format(history=_HISTORY, keys="ck, vk") + """
SELECT ck AS client_key, vk AS vendor_key, account_title, strftime(last_used_at, '%Y-%m-%d') AS last_used FROM n""")
def newest_rules(spark, sf):
    return H.newest_rules(rule_history(spark, sf)).select(
        "client_key", "vendor_key", "account_title", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


@query("newest_rules_global", _NEWEST.format(history=_HISTORY, keys="vk") + """
SELECT vk AS vendor_key, account_title, strftime(last_used_at, '%Y-%m-%d') AS last_used FROM n""")
def newest_rules_global(spark, sf):
    return H.newest_rules_global(rule_history(spark, sf)).select(
        "vendor_key", "account_title", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


_APPROVED = f"""SELECT e.document_id, d.client_id, e.vendor_name, e.account_title, e.tax_category, e.payment_method, d.approved_at
FROM ({fx.DOCUMENTS_SQL}) d JOIN ({fx.EXTRACTED_SQL}) e ON d.id = e.document_id WHERE d.status = 'approved'"""


def approved(spark, sf):
    d = fx.documents(spark, sf).filter("status = 'approved'").select(F.col("id").alias("document_id"), "client_id", "approved_at")
    return fx.extracted(spark, sf).join(d, "document_id")


def increments(spark, sf):
    return H.as_approvals(approved(spark, sf), F.col("approved_at"))


@query("learn_upsert", f"""
WITH b AS (SELECT client_id, document_id, vendor_name, account_title, tax_category, use_count, last_used_at::timestamp AS last_used_at, created_at::timestamp AS created_at FROM ({_HISTORY})
  UNION ALL SELECT client_id, document_id, vendor_name, account_title, coalesce(tax_category, '課税仕入10%'), 1, approved_at, approved_at FROM ({_APPROVED}) WHERE vendor_name <> '' AND account_title <> '')
SELECT client_id, vendor_name, account_title, sum(use_count)::bigint AS use_count, strftime(max(last_used_at), '%Y-%m-%d %H:%M:%S') AS last_used,
  arg_min(tax_category, (created_at, document_id, tax_category)) AS tax_category FROM b GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY client_id, vendor_name, account_title"))
def learn_upsert(spark, sf):
    h = rule_history(spark, sf)
    return H.learn_history(h, increments(spark, sf).select(*h.columns)).select(
        "client_id", "vendor_name", "account_title", "use_count", stamp("last_used_at").alias("last_used"), "tax_category")


@query("top_history", f"""
SELECT vendor_name, account_title, tax_category, use_count FROM ({fx.HISTORY_SQL}) WHERE client_id = md5('client0') ORDER BY use_count DESC, last_used_at DESC, vendor_name LIMIT 50""")
def top_history(spark, sf):
    import hashlib

    return H.top_history(fx.history(spark, sf), hashlib.md5(b"client0").hexdigest()).drop("last_used_at")


@query("amount_range", f"""
SELECT coalesce(b, 'none') AS band, count(*) AS documents FROM (SELECT CASE WHEN total_amount <= 1000 THEN '0-1000' WHEN total_amount <= 10000 THEN '1001-10000' WHEN total_amount > 10000 THEN '10001+' END AS b
 FROM ({fx.EXTRACTED_SQL})) GROUP BY 1""")
def amount_range(spark, sf):
    return fx.extracted(spark, sf).groupBy(F.coalesce(H.amount_range(F.col("total_amount")), F.lit("none")).alias("band")).agg(F.count("*").alias("documents"))


# --- accounts -------------------------------------------------------------------------------------
_CHANGES_SQL = f"""
SELECT md5('client' || {fx.s('c_custkey')}) AS client_id, {fx.case('c_nationkey % 3', [fx.q('消耗品費'), fx.q('謎の科目'), fx.q('旅費交通費')])} AS internal_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 9000 + c_nationkey END AS freee_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '科目' || {fx.s('c_nationkey')} END AS mf_name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Y' || {fx.s('c_nationkey')} END AS yayoi_name, CASE WHEN c_custkey % 4 = 0 THEN 'load' ELSE 'register' END AS mode, 2 AS seq FROM customer
UNION ALL SELECT md5('client' || {fx.s('c_custkey')}), '雑費', 777, '雑費MF', '雑費Y', 'register', 1 FROM customer"""
_MASTER_SQL = f"""
WITH ch AS ({_CHANGES_SQL}), ld AS (SELECT client_id, max(seq) AS f FROM ch WHERE mode = 'load' GROUP BY client_id),
m AS (SELECT ch.client_id, internal_name, freee_id, CASE WHEN mode = 'register' THEN coalesce(nullif(mf_name, ''), internal_name) ELSE mf_name END AS mf_name,
  CASE WHEN mode = 'register' THEN coalesce(nullif(yayoi_name, ''), internal_name) ELSE yayoi_name END AS yayoi_name FROM ch LEFT JOIN ld USING (client_id) WHERE f IS NULL OR seq >= f
  QUALIFY row_number() OVER (PARTITION BY ch.client_id, internal_name ORDER BY seq DESC) = 1)"""


def master_changes(spark, sf):
    return spark.sql(_CHANGES_SQL.replace("FROM customer", "FROM {customer}"), customer=raw(spark, sf, "customer"))


@query("client_account_master", f"{_MASTER_SQL} SELECT client_id, internal_name, freee_id::bigint AS freee_id, mf_name, yayoi_name FROM m")
def client_account_master(spark, sf):
    return A.client_account_master(master_changes(spark, sf)).withColumn("freee_id", F.col("freee_id").cast("bigint"))


_ENTRIES = f"""SELECT e.document_id, d.client_id, coalesce(account_title, '消耗品費') AS debit_account,
  CASE WHEN payment_method IS NULL OR payment_method = '現金' THEN '現金' ELSE '未払金' END AS credit_account, coalesce(tax_category, '課税仕入10%') AS tax_category
  FROM ({fx.EXTRACTED_SQL}) e JOIN ({fx.DOCUMENTS_SQL}) d ON d.id = e.document_id"""


def _sys(col: str, at: int) -> str:
    return f"CASE {col} {' '.join(f'WHEN {fx.q(k)} THEN {fx.q(str(v[at]))}' for k, v in C.ACCOUNT_MASTER.items())} ELSE {col} END"


def _taxcode(at: int, default: str) -> str:
    return f"CASE tax_category {' '.join(f'WHEN {fx.q(k)} THEN {fx.q(str(v[at]))}' for k, v in C.TAX_MASTER.items())} ELSE '{default}' END"


def _entries(spark, sf):
    d = fx.documents(spark, sf).select(F.col("id").alias("document_id"), "client_id")
    e = fx.extracted(spark, sf).join(d, "document_id")
    return e.select(
        "document_id", "client_id", F.coalesce("account_title", F.lit("消耗品費")).alias("debit_account"),
        F.when(F.col("payment_method").isNull() | (F.col("payment_method") == "現金"), "現金").otherwise("未払金").alias("credit_account"),
        F.coalesce("tax_category", F.lit("課税仕入10%")).alias("tax_category"))


for _soft, _at, _col, _tax in (("freee", 0, "cast(freee_id as string)", "17"), ("money_forward", 1, "mf_name", "課税仕入10%"), ("yayoi", 2, "yayoi_name", "10")):
    _res = lambda side, own: f"CASE WHEN {own}.client_id IS NOT NULL THEN {own}.{_col.replace('cast(', '').replace(' as string)', '')}::varchar ELSE {_sys(f'{side}_account', _at)} END"
    _num = lambda x, d: f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN {x} ELSE '{d}' END" if _soft == "freee" else x

    @query(f"resolve_accounts_{_soft}", f"""{_MASTER_SQL}, e AS ({_ENTRIES}),
r AS (SELECT document_id, tax_category, {_res('debit', 'a')} AS dr, {_res('credit', 'b')} AS cr FROM e
  LEFT JOIN m a ON a.client_id = e.client_id AND a.internal_name = debit_account LEFT JOIN m b ON b.client_id = e.client_id AND b.internal_name = credit_account)
SELECT document_id, {_num('dr', '1012')} AS debit_code, {_num('cr', '1')} AS credit_code, {_taxcode(_at, _tax)} AS tax_code FROM r""")
    def _resolve(spark, sf, software=_soft):
        master = A.client_account_master(master_changes(spark, sf))
        return A.resolve_accounts(_entries(spark, sf), software, master).select("document_id", "debit_code", "credit_code", "tax_code")


@query("resolve_tax_code", f"SELECT DISTINCT tax_category, {_taxcode(0, '17')} AS freee, {_taxcode(1, '課税仕入10%')} AS money_forward, {_taxcode(2, '10')} AS yayoi FROM ({fx.EXTRACTED_SQL})")
def resolve_tax_code(spark, sf):
    t = fx.extracted(spark, sf).select("tax_category").distinct()
    return t.select("tax_category", *[A.tax_code(F.col("tax_category"), s).alias(s) for s in A.SOFTWARE])


def _journal(spark, sf):
    return A.to_journal_entries(fx.documents(spark, sf), fx.extracted(spark, sf), fx.line_items(spark, sf))


@query("journal_entries", f"""
SELECT e.document_id, d.client_id, coalesce(total_amount, 0)::double AS total_amount, coalesce(account_title, '消耗品費') AS debit_account,
  CASE WHEN payment_method IS NULL OR payment_method = '現金' THEN '現金' ELSE '未払金' END AS credit_account, coalesce(tax_category, '課税仕入10%') AS tax_category,
  (vendor_registration_no IS NOT NULL AND ok) AS is_qualified_invoice, coalesce(n, 0)::bigint AS lines, coalesce(amt, 0)::double AS line_amount
FROM (SELECT *, {fx.REG_VALID} AS ok FROM (SELECT {fx.select_list(fx.EXTRACTED_COLUMNS)}, {K} FROM orders)) e JOIN ({fx.DOCUMENTS_SQL}) d ON d.id = e.document_id
LEFT JOIN (SELECT md5({fx.s('l_orderkey')}) AS document_id, count(*) AS n, sum({fx.ITEM_COLUMNS['amount']}) AS amt FROM lineitem GROUP BY 1) i ON i.document_id = e.document_id""")
def journal_entries(spark, sf):
    amount = F.reduce(F.transform("line_items", lambda x: x["amount"].cast("double")), F.lit(0.0), lambda a, b: a + b)
    return _journal(spark, sf).select(
        "document_id", "client_id", num("total_amount").alias("total_amount"), "debit_account", "credit_account", "tax_category", "is_qualified_invoice",
        F.coalesce(F.size("line_items"), F.lit(0)).cast("bigint").alias("lines"), F.coalesce(amount, F.lit(0.0)).alias("line_amount"))


@query("ledger_lines", f"""
WITH e AS ({_ENTRIES}), x AS ({fx.EXTRACTED_SQL})
SELECT document_id, 'debit' AS side, debit_account AS account, coalesce(total_amount, 0)::double AS signed_amount FROM e JOIN x USING (document_id)
UNION ALL SELECT document_id, 'credit', credit_account, -coalesce(total_amount, 0)::double FROM e JOIN x USING (document_id)""")
def ledger_lines(spark, sf):
    return A.ledger_lines(_journal(spark, sf)).select("document_id", "side", "account", num("signed_amount").alias("signed_amount"))


@query("unbalanced", f"""
WITH x AS ({fx.EXTRACTED_SQL}) SELECT document_id, coalesce(total_amount, 0)::double AS balance FROM x WHERE coalesce(total_amount, 0) <> 0 AND document_id < '8'""")
def unbalanced(spark, sf):
    """Journals of half the documents have lost their credit side."""
    lines = A.ledger_lines(_journal(spark, sf)).filter("side = 'debit' OR document_id >= '8'")
    return A.unbalanced(lines).select("document_id", num("balance").alias("balance"))
