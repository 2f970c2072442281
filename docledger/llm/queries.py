"""The registered queries of the training-data operators, each over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.align import align_documents
from docledger.llm.binary import read_documents, write_sequences
from docledger.llm.decontaminate import find_contamination
from docledger.llm.fingerprints import compare_with_next
from docledger.llm.html import extract
from docledger.llm.language import fit as fit_language
from docledger.llm.language import fold_of
from docledger.llm.language import predict as predict_language
from docledger.llm.packing import pack
from docledger.llm.personal import KINDS, find_personal_data
from docledger.llm.quality import fit as fit_quality
from docledger.llm.quality import score as score_quality
from docledger.llm.similarity import join_components
from docledger.llm.substrings import find_repeats
from docledger.llm.tokens import count_tokens
from docledger.llm.whiten import whiten
from docledger.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (k) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS s FROM a LEFT JOIN c USING (doc_id, j) WHERE c.doc_id IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""",
)
def op1(spark, sf):
    return find_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def language_model(docs: DataFrame):
    return fit_language(docs.filter(fold_of("doc_id", 4) != 2))


@query("op2_language_id")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    told = predict_language(docs, language_model(docs))
    return told.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op3_quality")
def op3(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    learn = fold_of("doc_id", 5) != 0
    model = fit_quality(docs.filter(learn), labels.filter(learn & (F.col("quality") == 1)))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_main_text")
def op4(spark, sf):
    return extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_personal_data")
def op5(spark, sf):
    found = find_personal_data(table(spark, sf, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query("op6_fingerprints")
def op6(spark, sf):
    return compare_with_next(table(spark, sf, "documents"))


@query("op7_jaccard_join")
def op7(spark, sf):
    return join_components(table(spark, sf, "documents"))


UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8_WORDS = f"regexp_extract_all(translate(text, '{UPPER_AZ}', '{LOWER_AZ}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op8_decontaminate",
    f"""
WITH d AS (SELECT doc_id, coalesce({OP8_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {OP8_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (k, n)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def op8(spark, sf):
    found = find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform(F.array_distinct(F.transform("hits", lambda h: h["item_id"])), lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_token_counts")
def op9(spark, sf):
    counts = count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op10_pack_sequences")
def op10(spark, sf):
    pieces = pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_whitening")
def op11(spark, sf):
    return whiten(table(spark, sf, "embeddings"))


@query("op12_align_tokenizers")
def op12(spark, sf):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    told = align_documents(table(spark, sf, "documents"), *paths)
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_overlaps")


@query("op13_sequence_files")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    manifest = write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_folder(spark, "sequences"))
    return read_documents(manifest)
