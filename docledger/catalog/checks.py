"""Registration numbers, personal data, classification, scoring."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from docledger import constants as C
from docledger.catalog.base import num, query
from docledger.functions import classify as CL
from docledger.functions import pii as P
from docledger.functions import registration as R
from docledger.functions import scoring as S
from docledger.operators import reports
from docledger.plans import fixtures as fx
from docledger.sources.tables import raw

K = fx.K
_HYPHEN = f"({fx.s(fx.CHECK_DIGIT)} || '-' || substr({fx._BODY}, 1, 4) || '-' || substr({fx._BODY}, 5, 4) || '-' || substr({fx._BODY}, 9, 4))"
_GOOD = f"('T' || {fx.s(fx.CHECK_DIGIT)} || {fx._BODY})"
_REG_TEXT = f"'登録番号 ' || {fx.REG_NO} || ' 法人番号 ' || {_HYPHEN} || chr(10)"


def _reg_docs(spark, sf):
    return raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"translate({_REG_TEXT}, '0123456789', '０１２３４５６７８９') AS text")


@query("registration_candidates", f"""
SELECT {K} AS doc_id, 0::bigint AS position, {fx.REG_NO} AS candidate FROM orders
UNION ALL SELECT {K}, 1::bigint, {_GOOD} FROM orders WHERE NOT {fx.REG_VALID}""")
def registration_candidates(spark, sf):
    c = _reg_docs(spark, sf).select("doc_id", F.posexplode(R.candidates(F.col("text"))).alias("position", "candidate"))
    return c.withColumn("position", F.col("position").cast("bigint"))


@query("best_registration", f"SELECT {K} AS doc_id, {_GOOD} AS best FROM orders")
def best_registration(spark, sf):
    return _reg_docs(spark, sf).withColumn("c", R.candidates(F.col("text"))).select("doc_id", R.best(F.col("c")).alias("best"))


_BROKEN = fx.case(f"{K} % 11", [f"substr({fx.REG_NO}, 2)", f"substr({fx.REG_NO}, 1, 13)", f"substr({fx.REG_NO}, 1, 13) || 'A'", f"lower({fx.REG_NO})"], fx.REG_NO)


@query("validate_registration", f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 11 IN (0, 1, 2) THEN NULL ELSE {fx.REG_NO} END AS number, ({K} % 11 > 2 AND {fx.REG_VALID}) AS is_valid,
  CASE WHEN {K} % 11 > 2 AND {fx.REG_VALID} THEN true END AS is_corporate,
  CASE WHEN {K} % 11 = 0 THEN 'no_prefix' WHEN {K} % 11 = 1 THEN 'bad_length' WHEN {K} % 11 = 2 THEN 'not_digits' WHEN NOT {fx.REG_VALID} THEN 'check_digit' END AS error
FROM orders""")
def validate_registration(spark, sf):
    o = raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"{_BROKEN} AS n")
    return o.select("doc_id", R.validate(F.col("n")).alias("v")).select("doc_id", "v.*")


@query("apply_registration", f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 7 <> 0 THEN {fx.REG_NO} WHEN {K} % 2 = 0 THEN 'X123' END AS number,
  CASE WHEN {K} % 7 <> 0 AND NOT {fx.REG_VALID} THEN 'インボイス番号要確認: ' || {fx.REG_NO} || '（チェックデジット不一致）'
       WHEN {K} % 7 = 0 AND {K} % 2 = 0 THEN 'インボイス番号要確認: X123' ELSE '' END AS flags FROM orders""")
def apply_registration(spark, sf):
    docs = fx.receipts(spark, sf).withColumn("vendor_registration_no", F.when(F.col("doc_id") % 2 == 0, "X123"))
    out = R.apply_registration(docs, "text")
    return out.select("doc_id", F.col("vendor_registration_no").alias("number"), F.array_join("review_flags", ",").alias("flags"))


# --- personal data --------------------------------------------------------------------------------
@query("find_pii", f"""
SELECT {K} AS doc_id, 'my_number' AS kind, 0::bigint AS ordinal, {fx.MY_NUMBER} AS value FROM orders
UNION ALL SELECT {K}, 'bank', 0, {fx.ACCOUNT_NO} FROM orders UNION ALL SELECT {K}, 'card', 0, {fx.CARD} FROM orders WHERE {fx.CARD_VALID}
UNION ALL SELECT {K}, 'phone', 0, {fx.MY_NUMBER} FROM orders UNION ALL SELECT {K}, 'phone', 1, {fx.PHONE} FROM orders
UNION ALL SELECT {K}, 'email', 0, {fx.EMAIL} FROM orders""")
def find_pii(spark, sf):
    return P.find_pii(fx.pii_texts(spark, sf), "doc_id", "text").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("find_pii_documents", r"""
WITH e AS (SELECT doc_id, 'email' AS kind, list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) AS vs FROM documents),
c AS (SELECT doc_id, 'card' AS kind, list_distinct(list_filter(regexp_extract_all(text, '(?:^|[^0-9Tt])([0-9]{4}[-\s][0-9]{4}[-\s][0-9]{4}[-\s][0-9]{4}|[0-9]{16})(?:[^0-9]|$)', 1),
  lambda v: regexp_replace(v, '[\s\-]', '', 'g') <> repeat(v[1], 16) AND
   list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN cast(regexp_replace(v, '[\s\-]', '', 'g')[i] AS int)
     ELSE 2 * cast(regexp_replace(v, '[\s\-]', '', 'g')[i] AS int) - CASE WHEN cast(regexp_replace(v, '[\s\-]', '', 'g')[i] AS int) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS vs FROM documents)
SELECT doc_id, kind, unnest(vs) AS value FROM (SELECT * FROM e UNION ALL SELECT * FROM c)""")
def find_pii_documents(spark, sf):
    return P.find_pii(fx.prose(spark, sf), "doc_id", "text", kinds=("email", "card")).drop("ordinal")


def _masked_sql(first: str, again: str, bank: str, card: str) -> str:
    return (
        f"'個人番号: [MY_NUMBER_' || {first} || ']' || chr(10) || '口座番号: [BANK_ACCOUNT_' || {bank} || '] へ' || chr(10) || 'カード ' || "
        f"CASE WHEN {fx.CARD_VALID} THEN '[CARD_NUMBER_' || {card} || ']' ELSE {fx.CARD} END || chr(10) || "
        f"CASE WHEN {K} % 4 = 0 THEN '再掲 [MY_NUMBER_' || {again} || ']' || chr(10) ELSE '' END || '連絡 ' || {fx.EMAIL} || ' 電話 ' || {fx.PHONE}")


_C = f"(CASE WHEN {fx.CARD_VALID} THEN 1 ELSE 0 END)"
_A = f"(CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END)"


def _mask(spark, sf, **options):
    out = P.mask_pii(fx.pii_texts(spark, sf), "text", **options)
    return out.select("doc_id", "masked_text", F.col("mask_count").cast("bigint").alias("mask_count"))


@query("mask_pii", f"""SELECT {K} AS doc_id, {_masked_sql(fx.s(_C), fx.s(f'{_C} + 1'), fx.s(f'{_C} + 1 + {_A}'), "'0'")} AS masked_text,
  ({_C} + 2 + {_A})::bigint AS mask_count FROM orders""")
def mask_pii(spark, sf):
    return _mask(spark, sf)


@query("mask_pii_strict_order", f"""SELECT {K} AS doc_id, {_masked_sql("'0'", "'1'", fx.s(f'1 + {_A}'), fx.s(f'2 + {_A}'))} AS masked_text,
  ({_C} + 2 + {_A})::bigint AS mask_count FROM orders""")
def mask_pii_strict_order(spark, sf):
    return _mask(spark, sf, strict_order=True)


@query("mask_contacts", f"""
SELECT {K} AS doc_id, '個人番号:[PHONE_0]' || chr(10) || '口座番号: ' || {fx.ACCOUNT_NO} || ' へ' || chr(10) || 'カード ' || {fx.CARD} || chr(10) ||
  CASE WHEN {K} % 4 = 0 THEN '再掲[PHONE_1]' || chr(10) ELSE '' END || '連絡 [EMAIL_' || {fx.s(f'2 + {_A}')} || '] 電話 [PHONE_' || {fx.s(f'1 + {_A}')} || ']' AS masked_text,
  (3 + {_A})::bigint AS mask_count FROM orders""".replace("'個人番号:[", "'個人番号: [").replace("'再掲[", "'再掲 ["))
def mask_contacts(spark, sf):
    return _mask(spark, sf, kinds=("phone", "email"))


@query("mask_documents", None)
def mask_documents(spark, sf):
    out = P.mask_pii(fx.prose(spark, sf), "text", kinds=P.ALL_KINDS)
    return out.select("doc_id", "masked_text", F.col("mask_count").cast("bigint").alias("mask_count"))


@query("restore_pii", f"SELECT {K} AS doc_id, {fx.PII_TEXT} AS text FROM orders")
def restore_pii(spark, sf):
    out = P.mask_pii(fx.pii_texts(spark, sf).drop("x"), "text", kinds=P.ALL_KINDS)
    return out.select("doc_id", P.restore_pii(F.col("masked_text"), F.col("restored_values")).alias("text"))


@query("restore_pii_documents", "SELECT doc_id, text FROM documents")
def restore_pii_documents(spark, sf):
    out = P.mask_pii(fx.prose(spark, sf), "text", kinds=P.ALL_KINDS)
    return out.select("doc_id", P.restore_pii(F.col("masked_text"), F.col("restored_values")).alias("text"))


@query("mask_when_required", f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 2 = 0 THEN {_masked_sql(fx.s(_C), fx.s(f'{_C} + 1'), fx.s(f'{_C} + 1 + {_A}'), "'0'")} ELSE {fx.PII_TEXT} END AS masked_text,
  (CASE WHEN {K} % 2 = 0 THEN {_C} + 2 + {_A} ELSE 0 END)::bigint AS mask_count FROM orders""")
def mask_when_required(spark, sf):
    out = P.mask_when_required(fx.pii_texts(spark, sf), "text", F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "masked_text", F.col("mask_count").cast("bigint").alias("mask_count"))


# --- classification -------------------------------------------------------------------------------
def _score_sql(text: str, doc_type: str) -> str:
    plus = [f"CASE WHEN contains({text}, {fx.q(w)}) THEN {float(n)}::double ELSE 0 END" for w, n in Counter(w.lower() for w in C.TYPE_KEYWORDS[doc_type]).items()]
    minus = [f" - CASE WHEN contains({text}, {fx.q(w.lower())}) THEN 2.0::double ELSE 0 END" for w in C.TYPE_NEGATIVE_KEYWORDS.get(doc_type, [])]
    return "(" + " + ".join(plus) + "".join(minus) + ")"


def classify_sql(source: str, thermal: str = "false", aspect: str = "NULL::double") -> str:
    t = C.DOC_TYPES
    best = f"greatest({', '.join(t)})"
    return f"""
WITH src AS ({source}), low AS (SELECT doc_id, text, lower(text) AS low, {thermal} AS th, {aspect} AS asp FROM src),
s0 AS (SELECT doc_id, text, th, asp, {', '.join(f'{_score_sql("low", x)} AS {x}' for x in t)} FROM low),
s1 AS (SELECT doc_id, text, handwritten, card_statement,
  receipt + CASE WHEN th THEN 3.0::double ELSE 0 END + CASE WHEN asp > 1.8 THEN 1.0::double ELSE 0 END AS receipt,
  bank_statement + CASE WHEN asp > 1.8 THEN 0.5::double ELSE 0 END AS bank_statement,
  invoice + CASE WHEN asp BETWEEN 1.2 AND 1.6 THEN 1.5::double ELSE 0 END AS invoice FROM s0),
s2 AS (SELECT * REPLACE (invoice + CASE WHEN invoice > 0 AND regexp_matches(text, 'T[0-9]{{13}}') THEN 1.0::double ELSE 0 END AS invoice) FROM s1),
s3 AS (SELECT * REPLACE (handwritten + CASE WHEN handwritten > 0 AND invoice < 1 AND receipt < 2 THEN 1.5::double ELSE 0 END AS handwritten) FROM s2),
s4 AS (SELECT *, {best} AS best, list_reverse_sort([{', '.join(t)}])[2] AS second FROM s3)
SELECT doc_id, CASE WHEN best < 1 THEN 'unknown' {' '.join(f"WHEN {x} = best THEN '{x}'" for x in t)} END AS doc_type,
  round(CASE WHEN best <= 0 THEN 0 WHEN best < 1 THEN 0.2 ELSE least(1.0, greatest(0.0, best / (best + second + 1e-6))) END, 5)::double AS confidence FROM s4"""


def _classified(df):
    return df.select("doc_id", F.col("text_doc_type").alias("doc_type"), F.round("text_confidence", 5).alias("confidence"))


@query("classify_documents", classify_sql("SELECT doc_id, text FROM documents"))
def classify_documents(spark, sf):
    return _classified(CL.classify_documents(fx.prose(spark, sf), "text"))


@query("classify_conversations", classify_sql("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"))
def classify_conversations(spark, sf):
    c = raw(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _classified(CL.classify_documents(c, "text"))


_ASPECT = f"cast((doc_id % 30) as double) / 10"


@query("classify_receipts", classify_sql(
    f"SELECT {K} AS doc_id, {fx.RECEIPT_PLAIN_SQL} AS text FROM orders", "(doc_id % 2 = 0)", _ASPECT))
def classify_receipts(spark, sf):
    return _classified(CL.classify_documents(fx.receipts(spark, sf), "text", thermal=F.col("doc_id") % 2 == 0, aspect=F.expr(_ASPECT)))


_H, _W = f"cast(({K} * 37) % 2500 + 300 as int)", f"cast(CASE WHEN {K} % 50 = 0 THEN 0 ELSE ({K} * 53) % 1600 + 300 END as int)"
_TH, _Q = f"({K} % 3 = 0)", f"cast({K} % 100 as double) / 100"
_SHAPE_SQL = f"""
WITH p AS (SELECT {K} AS doc_id, {_H} AS h, {_W} AS w, {_TH} AS th, {_Q} AS ql, CASE WHEN {_W} > 0 THEN {_H}::double / {_W} END AS a FROM orders),
s AS (SELECT doc_id, w, CASE WHEN th THEN 4.0::double ELSE 0 END + CASE WHEN a > 2 THEN 2.5 WHEN a > 1.5 THEN 1.5 ELSE 0 END AS receipt,
  CASE WHEN a > 1.5 AND a <= 2 THEN 0.5::double ELSE 0 END + CASE WHEN ql < 0.55 AND NOT th THEN 1.5 ELSE 0 END AS handwritten,
  CASE WHEN a BETWEEN 1.15 AND 1.45 THEN 2.5::double ELSE 0 END AS invoice,
  CASE WHEN a BETWEEN 1.15 AND 1.45 THEN 1.5::double ELSE 0 END + CASE WHEN a < 0.85 THEN 2.0 ELSE 0 END AS card_statement,
  CASE WHEN a > 2 THEN 1.0::double ELSE 0 END AS bank_statement FROM p),
b AS (SELECT *, greatest(receipt, handwritten, invoice, card_statement, bank_statement) AS best,
  list_reverse_sort([receipt, handwritten, invoice, card_statement, bank_statement]::double[])[2] AS second FROM s),
r AS (SELECT doc_id, CASE WHEN w <= 0 OR best <= 0 THEN 'unknown' WHEN receipt = best THEN 'receipt' WHEN handwritten = best THEN 'handwritten' WHEN invoice = best THEN 'invoice'
  WHEN card_statement = best THEN 'card_statement' ELSE 'bank_statement' END AS doc_type,
  round(CASE WHEN w <= 0 OR best <= 0 THEN 0.0 ELSE least(1.0, best / (best + second + 1e-6)) END, 5)::double AS confidence FROM b)
SELECT doc_id, doc_type, confidence, CASE WHEN confidence >= 0.35 THEN doc_type END AS hint FROM r"""


@query("classify_by_shape", _SHAPE_SQL)
def classify_by_shape(spark, sf):
    o = raw(spark, sf, "orders").selectExpr(f"{K} AS doc_id", f"{_H} AS h", f"{_W} AS w", f"{_TH} AS th", f"{_Q} AS ql")
    o = o.withColumn("s", CL.classify_by_shape(*[F.col(c) for c in ("h", "w", "th", "ql")]))
    return o.select("doc_id", "s.doc_type", F.round("s.confidence", 5).alias("confidence"), CL.shape_hint(F.col("s")).alias("hint"))


_MODEL_TYPE = fx.case(f"{K} % 4", ["'invoice'", "'unknown'", "''", None])


@query("final_doc_type", f"""
WITH c AS ({classify_sql(f"SELECT {K} AS doc_id, {fx.RECEIPT_PLAIN_SQL} AS text FROM orders")})
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'invoice' ELSE doc_type END AS doc_type, greatest(confidence, 0.8::double) AS confidence FROM c""")
def final_doc_type(spark, sf):
    c = CL.classify_documents(fx.receipts(spark, sf), "text").withColumn("m", F.expr(_MODEL_TYPE.replace(K, "doc_id")))
    return c.select("doc_id", CL.final_doc_type(F.col("m"), F.col("text_doc_type")).alias("doc_type"),
                    CL.final_confidence(F.lit(0.8), F.round("text_confidence", 5)).alias("confidence"))


# --- scoring --------------------------------------------------------------------------------------
_ARITH_CTE = f"""
WITH e AS ({fx.EXTRACTED_SQL}), a AS (SELECT *, coalesce(total_amount, 0)::decimal(18,2) AS t, coalesce(subtotal_amount, 0)::decimal(18,2) AS st,
  (coalesce(tax_amount_10, 0) + coalesce(tax_amount_8, 0))::decimal(18,2) AS x FROM e),
p AS (SELECT *, greatest(1.0, t * 0.005) AS tol, greatest(1.0, t * 0.01) AS tol1, round_even(st::double / 10, 0)::decimal(18,2) AS s10, round_even(st::double * 8 / 100, 0)::decimal(18,2) AS s8,
  round_even(t::double * 10 / 110, 0)::decimal(18,2) AS t10, round_even(t::double * 8 / 108, 0)::decimal(18,2) AS t8 FROM a),
v AS (SELECT *, CASE WHEN t <= 0 OR (st = 0 AND x = 0) THEN true WHEN st > 0 AND x > 0 THEN abs(t - st - x) <= tol
   WHEN st > 0 THEN t - st >= 0 AND (abs(t - st - s10) <= tol OR abs(t - st - s8) <= tol) ELSE abs(x - t10) <= tol1 OR abs(x - t8) <= tol1 END AS ok,
  CASE WHEN t <= 0 OR (st = 0 AND x = 0) THEN 0 WHEN st > 0 AND x > 0 THEN abs(t - st - x)
   WHEN st > 0 AND t - st < 0 THEN st - t WHEN st > 0 AND (abs(t - st - s10) <= tol OR abs(t - st - s8) <= tol) THEN 0 WHEN st > 0 THEN abs(t - st - s10)
   WHEN abs(x - t10) <= tol1 OR abs(x - t8) <= tol1 THEN 0 ELSE abs(x - t10) END AS diff FROM p)"""


@query("check_arithmetic", f"{_ARITH_CTE} SELECT document_id, ok, diff::double AS diff FROM v")
def check_arithmetic(spark, sf):
    e = fx.extracted(spark, sf).withColumn("a", S.check_arithmetic(*[F.col(c) for c in ("total_amount", "subtotal_amount", "tax_amount_10", "tax_amount_8")]))
    return e.select("document_id", "a.ok", num("a.diff").alias("diff"))


@query("quick_arithmetic", f"""{_ARITH_CTE} SELECT document_id, (t = 0 OR st = 0 OR abs(st + x - t) <= 1) AS ok FROM v""")
def quick_arithmetic(spark, sf):
    e = fx.extracted(spark, sf)
    return e.select("document_id", S.quick_arithmetic_ok(*[F.col(c) for c in ("total_amount", "subtotal_amount", "tax_amount_10", "tax_amount_8")]).alias("ok"))


# engine and rule confidence come from the order key; the SQL side works in ten-thousandths, as integers
_RULE = "CASE tk % 4 WHEN 0 THEN 97 WHEN 1 THEN 70 WHEN 2 THEN 90 ELSE 0 END"
_SCORE_SQL = f"""{_ARITH_CTE.replace('SELECT md5(', f'SELECT {K} AS tk, md5(', 1)},
b AS (SELECT *, CASE WHEN vendor_name IS NULL THEN 0 ELSE length(vendor_name) END AS vl FROM v),
s AS (SELECT *, 2000 + CASE WHEN t <= 0 THEN 0 WHEN t BETWEEN 1 AND 10000000 THEN 3000 ELSE 1500 END + CASE WHEN vl < 2 THEN 0 ELSE least(20, vl + 10) * 100 END
  + CASE WHEN x > 0 THEN 1500 WHEN t <> 0 THEN 450 ELSE 0 END + CASE WHEN ok THEN 1500 ELSE 0 END AS base FROM b),
g AS (SELECT *, CASE WHEN tk % 101 > 0 THEN least(10000, greatest(0, base + (tk % 101) * 20 - 1000)) ELSE base END AS adj FROM s),
f AS (SELECT *, floor((CASE WHEN {_RULE} >= 85 THEN least(10000, adj + 500) ELSE adj END + 5) / 10)::bigint AS score,
  (CASE WHEN t <= 0 THEN 1 ELSE 0 END + CASE WHEN vl < 2 THEN 1 ELSE 0 END + CASE WHEN x <= 0 AND t <> 0 THEN 1 ELSE 0 END + CASE WHEN NOT ok AND diff > 0 THEN 1 ELSE 0 END) AS reasons,
  {fx.DOC_TYPE.replace(K, 'tk')} AS doc_type FROM g),
r AS (SELECT *, CASE WHEN score >= 850 AND reasons = 0 THEN 'auto_confirmed' WHEN score >= 550 THEN 'needs_review' ELSE 'manual_input' END AS tier0 FROM f)
SELECT document_id, score::double / 1000 AS score, CASE WHEN tier0 = 'auto_confirmed' AND doc_type IN ('handwritten', 'card_statement', 'bank_statement') THEN 'needs_review' ELSE tier0 END AS tier,
  (reasons + CASE WHEN NOT ok AND diff > 0 THEN 1 ELSE 0 END + CASE WHEN tier0 = 'auto_confirmed' AND doc_type IN ('handwritten', 'card_statement', 'bank_statement') THEN 1 ELSE 0 END)::bigint AS flags FROM r"""


@query("score_documents", _SCORE_SQL)
def score_documents(spark, sf):
    o = raw(spark, sf, "orders").selectExpr(
        f"{K} AS tk", *[f"{e} AS {n}" for n, e in fx.EXTRACTED_COLUMNS.items()], f"{fx.DOC_TYPE} AS doc_type")
    rule = F.expr(f"cast({_RULE} as decimal(10,6)) / 100")
    out = S.score_documents(o, doc_type="doc_type", ocr_conf=F.expr("cast(tk % 101 as decimal(10,6)) / 100"), rule_conf=rule)
    return out.select("document_id", num("confidence_score").alias("score"), F.col("confidence_tier").alias("tier"),
                      F.size("review_flags").cast("bigint").alias("flags"))


_TIER_SQL = "CASE WHEN s >= 850 AND NOT why THEN 'auto_confirmed' WHEN s >= 550 THEN 'needs_review' ELSE 'manual_input' END"


@query("assign_tier", f"SELECT {K} AS doc_id, {_TIER_SQL.replace('why', f'({K} % 7 = 0)').replace('s >=', f'{K} % 1000 >=')} AS tier FROM orders")
def assign_tier(spark, sf):
    score = F.expr(f"cast(cast({K} % 1000 as decimal(10,3)) / 1000 as decimal(5,3))")
    return raw(spark, sf, "orders").select(F.col(K).alias("doc_id"), S.score_tier(score, F.col(K) % 7 == 0).alias("tier"))


@query("force_review_types", f"SELECT id, doc_type IN ('handwritten', 'card_statement', 'bank_statement') AS forced FROM ({fx.DOCUMENTS_SQL})")
def force_review_types(spark, sf):
    return fx.documents(spark, sf).select("id", reports.force_review(F.col("doc_type")).alias("forced"))
