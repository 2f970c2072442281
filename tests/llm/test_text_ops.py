"""Operators that work row by row: tokens, packing, languages, quality, pages, fingerprints."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docledger.llm import decontaminate as D
from docledger.llm import fingerprints as FP
from docledger.llm import html as H
from docledger.llm import language as L
from docledger.llm import packing as P
from docledger.llm import quality as Q
from docledger.llm import similarity as S
from docledger.llm import tokens as T
from docledger.llm import words as W

SCHEMA = "doc_id long, text string, n_tokens long, lang string, key string"
ODD = [(1, "a b c", 9, "en", "k"), (1, "a b c", 9, "en", "k"), (2, None, None, None, None), (3, "", 0, "en", "k"), (None, "free of id", 1, "en", "k"), (4, " \n\t ", 1, "de", "k"), (5, "x" * 300_000 + " end", 1, "de", "k")]
SP = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "The", "of", "\n", "  ", " ", "\t", "▁", "é", "É", "日本", "<|endoftext|>", "<s>", ".", "1", "23", "\r\n", "\x00", "🙂", "́", " ", "\x0b", "ﬁ", "'s", ",", "!!", "Σ", "İ", " ", "\x1c", "<0x0A>"]


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_words_agree_with_a_regex():
    texts = noise(3000) + [None, "", "x" * 3_000_000, ("ab " * 700_000)]
    for separators, pattern in ((W.WHITE, r"[^\x20\x09-\x0D]+"), (W.PUNCTUATION, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}) if separators is W.PUNCTUATION else {}
        w = W.words(pa.array(texts), separators, W.LOWER if low else W.SAME)
        told = [re.findall(pattern, (t or "").translate(low)) for t in texts]
        assert w.counts.tolist() == [len(x) for x in told]
        flat = [x for t in told for x in t]
        seen = {}
        assert all(seen.setdefault(x, h) == h for x, h in zip(flat, w.hash.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


def test_token_counts_are_the_librarys():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = noise(4000) + ["", " ", "\n", " \n ", "  a  ", "a\n\nb ", "the of and"]
    assert T.text_lengths(SP, pa.array(texts)).tolist() == [len(x) for x in sp.encode(texts)]
    apart, alone = T.proof(SP)
    assert apart and "the" in alone and all(len(sp.encode(x)) == 1 for x in alone[::97])


def test_packing_gives_back_all_ids():
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(WORD)
    texts = noise(2000, 2) + [None, ""]
    ids, size = P.token_ids(WORD, pa.array(texts), 1)
    ends = np.cumsum(size)
    assert all(ids[e - n : e].tolist() == k.encode(t or "", add_special_tokens=False).ids + [1] for t, e, n in zip(texts, ends, size, strict=True))
    length, pieces = P.binary_lengths(np.array([1, 2, 7, 2048, 4099]), 2048)
    assert length.tolist() == [1, 2, 4, 2, 1, 2048, 2048, 2048, 2, 1] and pieces.tolist() == [1, 1, 3, 1, 4]


def test_packing_rows(spark, odd):
    rows = P.pack(odd, WORD, most=64).withColumn("crc", F.crc32("ids")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.crc and len(r.ids) == 4 * r.length for r in rows)
    whole = [r for r in rows if r.doc_id == 5]
    assert sum(r.length for r in whole) == whole[0].doc_tokens and sorted(r.start for r in whole)[0] == 0
    assert [(r.start, r.length) for r in rows if r.doc_id == 2] == [(0, 1)] and sum(r.doc_id == 1 for r in rows) == 2
    with pytest.raises(ValueError):
        P.pack(odd, WORD, most=100)


@pytest.mark.parametrize("run", [lambda d: T.count_tokens(d, SP), lambda d: P.pack(d, WORD), lambda d: FP.fingerprints(d), lambda d: FP.compare_with_next(d), lambda d: Q.score(d, None), lambda d: L.predict(d, None)])
def test_empty_and_odd_rows(spark, odd, run):
    assert run(odd.limit(0)).count() == 0
    keys = Counter(r.doc_id for r in run(odd).select("doc_id").collect())
    assert set(keys) == {1, 2, 3, 4, 5, None} and (keys[1] % 2 == 0)


ITEM = "item_id string, text string"


@pytest.mark.parametrize(
    "run", [lambda d, i: P.pack(d, WORD), lambda d, i: L.fit(d), lambda d, i: L.predict(d, None), lambda d, i: S.one_of_each(d), lambda d, i: D.drop_contaminated(d, i)], ids=["pack", "fit", "predict", "one_of_each", "drop_contaminated"]
)
def test_python_gets_few_megabytes_at_a_time(spark, run):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    few = spark.createDataFrame([(1, "some words of a text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    run(few, spark.createDataFrame([("a", "other words")], ITEM))
    long = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    sizes = [r.n for r in long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    assert sum(sizes) >= 20_000_000 and max(sizes) <= 5_000_000
    spark.conf.set(name, "9m")  # a session's own value stays
    run(few, spark.createDataFrame([("a", "other words")], ITEM))
    assert spark.conf.get(name) == "9m"
    spark.conf.unset(name)


def test_fingerprints_estimate_jaccard(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 400))) for _ in range(40)]
    a = FP.signatures(pa.array(texts))
    off = []
    for i in range(39):
        x, y = Counter(texts[i].split()), Counter(texts[i + 1].split())
        off.append(FP.likeness(a[i : i + 1], a[i + 1 : i + 2])[0] - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2
    assert (FP.signatures(pa.array([texts[0], texts[0]]))[0] == a[0]).all()


@pytest.mark.parametrize(("n", "common"), [(20_000, 0), (100_000, 0), (100_000, 50_000)])
def test_fingerprints_of_long_texts(n, common):
    """Each word is a term of its own, however many a text has, and kept numbers are those worked out anew."""
    texts = pa.array([" ".join(f"a{i}" for i in range(n)), " ".join([f"a{i}" for i in range(common)] + [f"b{i}" for i in range(n - common)])])
    FP._kept.cache_clear()
    a = FP.signatures(texts, 256)
    assert abs(FP.likeness(a[:1], a[1:])[0] - common / (2 * n - common)) < (0.12 if common else 0.01)
    assert (FP.signatures(texts, 256) == a).all()


def test_next_document(spark):
    r = random.Random(4)
    docs = [(i * 3, "".join(r.choice("abé🙂 \n") for _ in range(r.randint(0, 60)))) for i in range(200)]
    got = {x.doc_id: x for x in FP.compare_with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for i, (k, t) in enumerate(docs):
        n = docs[(i + 1) % 200][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(t)


def test_languages(spark):
    made = {"aa": ["tion", "the", "ing", "of"], "bb": ["keit", "der", "ung", "sch"], "cc": ["ción", "los", "que", "mente"]}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(made[k]) + r.choice(made[k]) for _ in range(30)), k) for i in range(240) for k in [r.choice(list(made))]]
    docs = spark.createDataFrame([*rows, (900, "1234 !!", "aa"), (901, None, "bb"), (902, "tionthe", None)], "doc_id long, text string, lang string")
    model = L.fit(docs.filter(L.fold_of("doc_id", 4) != 2))
    got = {x.doc_id: x for x in L.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.98
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    kept = L.drop_unknown(docs, model)
    assert kept.columns == docs.columns and kept.count() == 241 and kept.filter("doc_id = 902").first().lang == "aa"
    assert L.fit(docs.filter("lang is null")) is None
    one = L.fit(docs.filter("lang = 'aa'"))
    assert {x.lang_pred for x in L.predict(docs, one).collect()} == {"aa", "und"}


def test_quality(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    good = [(i, " ".join(word() for _ in range(r.randint(20, 200))) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(word() + r.choice(["###", "%%%"]) for _ in range(r.randint(20, 200)))) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    model = Q.fit(docs, labels)
    assert 0.55 < model.prior < 0.9  # 150 of 212 unlabelled texts are good
    got = {x.doc_id: x.score for x in Q.score(docs, model).collect()}
    assert min(got[i] for i, _ in good) > max(got[i] for i, _ in bad) and len(got) == 362
    assert Q.fit(docs, labels.limit(0)) is None


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


LONG = "word " * 60


@pytest.mark.parametrize(
    "html, text",
    [
        (page(f"<nav><ul><li><a href=x>menu</a></ul></nav><article><h1>Head</h1><p>One &amp; <b>two</b>\n three<p>Ti.</article><footer>foot</footer>"), "Head One & two three Ti."),
        (page(f"<div class='cookie-banner'>we use</div><div id=main><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar>side</div>"), f"{LONG}Short. {LONG}".strip()),
        (page(f"<article><p>{LONG}</p><section class='comments'><p>nice post {LONG}</p></section><aside>ad</aside><form>mail</form></article>"), LONG.strip()),
        (page("<header>Site</header><main><p>a&nbsp;b&#233;<script>var t='</p>';</script></p></main>"), "a bé"),
        ("plain text, no tags", "plain text, no tags"),
        ("<p>open <b>never <div>closed", "open never closed"),
        ("", ""),
        ("<nav>only menu</nav>", ""),
        ("<div class='ad'>left open<article><p>main text</p></article>", "main text"),
    ],
)
def test_main_text(html, text):
    assert " ".join(H.content_lines(html)) == text


def test_pages(spark):
    rows = [(1, "u", "<p>a</p>", "x", 7), (1, "u", "<p>a</p>", "x", 7), (2, None, None, None, None), (None, "v", "", "y", 1)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "v", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]


@pytest.mark.parametrize("name", ["row has-sidebar", "no-sidebar", "post-search-results", "entry share", "legal-news", "comments"])
@pytest.mark.parametrize("shape", ["<div class='{0}'>{1}</div>", "<div class='{0}'><article>{1}</article></div>", "<article class='{0}'>{1}</article>", "<article><div class='{0}'>{1}</div></article>"])
def test_marks_never_empty_a_page(name, shape):
    body = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p>"
    got = " ".join(H.content_lines(page("<nav><a href=x>menu</a></nav>" + shape.format(name, body) + "<footer>foot</footer>")))
    assert got == f"Head {LONG}Short."


def test_readers_text_goes_even_if_long():
    assert H.content_lines(page(f"<article><p>{LONG}</p><div class=comments><article class=comment><p>{LONG * 9}</p></article></div></article>")) == [LONG.strip()]
    assert H.content_lines(page(f"<article><p>{LONG}</p></article><div class=comments><article class=comment><p>{LONG * 9}</p></article></div>")) == [LONG.strip()]


def test_threshold_decides():
    links = "".join(f"<li><b><a href=x>t{i}</a></b></li>" for i in range(12))
    assert H.content_lines(page(f"<article><p>{LONG}</p><p>{LONG}</p><div><ul>{links}</ul></div></article>")) == [LONG.strip()] * 2
    assert H.content_lines(page(f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>")) == [LONG.strip(), "Short.", LONG.strip()]


def test_smoothing_against_plain_sums():
    import numpy as np

    values = np.array([3.0, 80.0, 1.0, 0.0, 12.0, 55.0, 7.0])
    weight = lambda d: np.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    plain = [sum(weight(i - j) * v for j, v in enumerate(values)) / sum(weight(i - j) for j in range(7)) for i in range(7)]
    assert np.allclose(H.smooth(values), plain)


def test_parser_takes_linear_time():
    import time

    began = time.time()
    for html in ("<div>" * 40000 + "text" + "</x>" * 40000, "<div><b><div>" + "<i>" * 40000 + "</b>" * 40000, "<article>" * 40000 + "a" + "<p class=ad>b" * 40000):
        H.content_lines(html)
    assert time.time() - began < 20


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
