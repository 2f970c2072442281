"""Operators that compare documents, against brute force on small tables, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docledger.llm import decontaminate as D
from docledger.llm import graph as G
from docledger.llm import personal as P
from docledger.llm import similarity as S
from docledger.llm import substrings as R

SCHEMA = "doc_id long, text string, n_words long, spans string, rid long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus(seed=7, n=120):
    """Random texts with exact and near copies, shared passages, runs of one word, odd rows."""
    r = random.Random(seed)
    fresh = lambda k: [f"{r.choice('abcdefg')}{r.randint(0, 400)}" for _ in range(k)]
    shared = [fresh(k) for k in (9, 14, 30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.4:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 6)):
                if w:
                    w[r.randrange(len(w))] = f"z{r.randint(0, 9)}"
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(" ".join(fresh(r.randint(0, 40)) + r.choice(shared) + fresh(r.randint(0, 40))))
        elif kind < 0.68:
            texts.append(" ".join(["same"] * r.randint(1, 60)))
        else:
            texts.append(" ".join(fresh(r.randint(0, 120))))
    rows = [(i, t if i % 3 else t.replace(" ", "\n", 2), 1, "s", 2) for i, t in enumerate(texts)]
    rows += [(n, None, None, None, None), (n + 1, "", 0, "", 0), (n + 2, "Two Words", 2, "", 0), (n + 3, "two words", 2, "", 0)]
    r.shuffle(rows)
    return rows


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("seed", [7, 8])
def test_repeats(spark, seed):
    rows = corpus(seed)
    first = {}
    words = {i: split(t) for i, t, *_ in rows}
    for i, w in words.items():
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, i), i)
    got = {r.doc_id: r for r in R.find_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    texts = {r.doc_id: r.text for r in R.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, w in words.items():
        gone = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()), i
        assert split(texts[i]) == kept and {x for s in got[i].spans for x in range(s["start"], s["start"] + s["length"])} == gone


def test_repeats_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(R, "SHARD_WINDOWS", 20)
    monkeypatch.setattr(R, "PIECE_WINDOWS", 5)
    monkeypatch.setattr(R, "COPY_DOCUMENTS", 3)
    test_repeats(spark, 9)


def test_repeats_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, long, 1, "", 1), (3, long, 1, "", 1), (3, long, 1, "", 1), (4, long + " more", 1, "", 1)], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_removed) for r in R.find_repeats(docs).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (4, 20)]
    assert R.find_repeats(docs.limit(0)).count() == 0


def brute_components(rows, k=4, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = split((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [7, 11])
def test_jaccard_join(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.join_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute_components(rows)


def test_jaccard_chain_and_family(spark):
    """A chain whose ends are not linked themselves, and a family of near copies of one text."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    chain = []
    for i in range(12):
        base = base[:]
        base[3 + 11 * i] = f"x{i}"
        chain.append((i, " ".join(base), 0, "", 0))
    home = [f"h{i}" for i in range(100)]
    family = []
    for i in range(60):
        w = home[:]
        w[r.randrange(100)] = f"y{i}"
        family.append((100 + i, " ".join(w), 0, "", 0))
    rows = chain + family
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in S.join_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows) and {got[i][1] for i in range(12)} == {0}


def test_one_of_each(spark):
    rows = [(5, "a b c d e f", 1, "x", 9), (2, "A b c d e f", 1, "y", 9), (2, "a b c d e f", 1, "z", 9), (None, "q r s t", 1, "n", 1), (7, None, 1, "m", 1), (8, "", 1, "m", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 8]
    assert S.one_of_each(docs.limit(0)).count() == 0 and S.join_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 60)])
def test_jaccard_join_at_other_thresholds(spark, k, percent):
    rows = corpus(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.join_components(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("seed", [7, 11])
def test_jaccard_join_cuts_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "LARGE", 2)
    test_jaccard_join(spark, seed)


def variants(seed=5, n=160):
    """Copies of one text, each with 12 of its 150 places written otherwise: few are near enough to another, all share most shingles;
    some that differ in two places from one before."""
    r = random.Random(seed)
    chosen = [r.sample(range(150), 12) for _ in range(n)]
    chosen += [[*c[:11], r.randrange(150)] for c in chosen[:20]]
    texts = [" ".join(f"b{i}x" if i % 4 == 0 and i // 4 in c else f"b{i}" for i in range(600)) for c in chosen]
    return [(i, t, 1, "", 1) for i, t in enumerate(texts)]


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    rows, made, keep = variants(), [], S.keep

    def counted(df, name):
        out = keep(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(S, "keep", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.join_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > len(rows) // 2
    assert sum(made) < len(rows) * (len(rows) - 1) // 2


def test_near_copies_stage(spark):
    """A text with a fifth of its length appended is a near copy by five words and 0.8."""
    import corpus_pipeline

    w = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(w[:100]), 0, "", 0), (2, " ".join(w), 0, "", 0), (3, " ".join(w[:90] + [f"x{i}" for i in range(40)]), 0, "", 0)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]
    assert len({r.component_id for r in S.join_components(docs).collect()}) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 100)]
    got = {r.node: r.label for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102, 200)} == {100}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, named = set(), set()
        for key, text in items:
            v = WORD.findall((text or "").translate(LOW))
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n and key is not None else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    named.add(key)
        out[i] = (len(w), len(hit), named)
    return out


@pytest.mark.parametrize("limit", [500_000, 60])
def test_decontaminate(spark, limit):
    rows = corpus(13, 80)
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[5:20])), (2, " ".join(texts[1].split()[:12]).upper()), (3, "two, words!"), (4, None), (None, "same same"), (5, "same same same"), (6, ""), (6, texts[2]), (7, "no such thing anywhere here")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = D.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), item_words=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, {h["item_id"] for h in r.hits}) for r in found} == brute_hits(rows, items)


def test_decontaminate_near_and_drop(spark):
    item = " ".join(f"t{i}" for i in range(12))
    near = " ".join([*(f"t{i}" for i in range(6)), "extra", *(f"t{i}" for i in range(6, 12))])
    docs = spark.createDataFrame([(1, f"a {item} b", 0, "", 0), (2, near, 0, "", 0), (3, "clean words", 0, "", 0), (3, None, 0, "", 0)], SCHEMA)
    items = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, len(r.hits), len(r.near)) for r in D.find_contamination(docs.filter("text is not null"), items, slop=1).collect()}
    assert got == {1: (12, 1, 1), 2: (0, 0, 1), 3: (0, 0, 0)}
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
    assert D.find_contamination(docs.limit(0), items).count() == 0 and D.find_contamination(docs, items.limit(0)).count() == 4


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"ip": lambda: all(int(x) < 256 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}.get(kind, lambda: True)():
                yield kind, m.start(), m.end()


def test_personal_data(spark):
    r = random.Random(5)
    parts = ["a", "b.c", "@", "@", ".", "1", "12", "255", "256", "4111 1111 1111 1111", " ", "-", "+", "+49 (0)30 123", "(at)", " dot ", "%", "é", "🙂", "\n", "0", "5555555555554444", ".com", "phone ", "555-123-4567", "1.2.3.4", "john.doe@mail.org"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14))), 0, "", 0) for i in range(1500)]
    rows += [(2000, None, 0, "", 0), (2001, "", 0, "", 0), (2002, "a@b.c " * 3000, 0, "", 0), (2003, "9" * 50_000, 0, "", 0), (2004, "a" * 200_000 + "@", 0, "", 0)]
    got = {x.doc_id: x.spans for x in P.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == list(brute_spans(t)), t[:100]
        for s in got[i]:
            assert s["base"] or not any(x["base"] and x["start"] < s["end"] and s["start"] < x["end"] for x in got[i])


def test_guards_hold_wherever_patterns_match(spark):
    r = random.Random(6)
    ats, dots = ["(at)", " (at) ", "[at]", " [at]", " at "], ["(dot)", " (dot) ", "[dot]", "[dot] ", " dot "]
    texts = [f"jane{a}example{d}com" for a in ats for d in dots]
    parts = [*ats, *dots, "jane", "example", "com", "@", ".", "12", "555", "5551", "4111", "+49", " ", "-", "(030)", "\n", "é"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "1.2.3.4", "+49 30 1234567", "555-123-4567", "a@b.co", "jane @ example.com", "jane@ example.com.", "4111.1111.1111.1111", "x 4111/1111/1111/1111 y", "4111–1111–1111–1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").cache()
    for (kind, loose), guard in P.guards(F.col("text")).items():
        matches = docs.filter(F.col("text").rlike((P.LOOSE if loose else P.BASE)[kind]))
        assert matches.count() and not matches.filter(~guard).collect(), (kind, loose)
    found = P.candidates(docs.filter("rid < 25")).filter("kind = 'email' and loose")
    assert sorted(x.match for x in found.collect()) == sorted(texts[:25])
    docs.unpersist()


def test_spans_that_no_base_rule_finds(spark):
    r = random.Random(8)

    def card():
        d = [4, *[r.randint(0, 9) for _ in range(14)]]
        return "".join(map(str, d)) + next(c for c in "0123456789" if luhn("".join(map(str, d)) + c))

    texts, planted = [], []
    for i in range(300):
        c = card()
        grouped = [c[j : j + 4] for j in (0, 4, 8, 12)]
        texts.append(f"please contact person{i}@example.com or pay by card {' '.join(grouped)} today, host 10.1.{i % 250}.9")
    for i in range(60):
        grouped = card()
        grouped = r.choice("._/").join(grouped[j : j + 4] for j in (0, 4, 8, 12))
        for before, span in (("please contact ", f"person{i} @ example.com"), ("write mail to ", f"person{i} (at) example (dot) com"), ("pay by card ", grouped)):
            planted.append(len(texts))
            texts.append(f"{before}{span} today")
    clean = range(len(texts), len(texts) + 120)
    texts += [f"order {r.randint(1000, 9999)}.{r.randint(1000, 9999)}.{r.randint(1000, 9999)}.000{i % 10} of part {i} look at this dot product" for i in range(120)]
    got = {x.doc_id: x.spans for x in P.find_personal_data(spark.createDataFrame([(i, t, 0, "", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    found = sum(any(not s["base"] for s in got[i]) for i in planted)
    wrong = sum(any(not s["base"] for s in got[i]) for i in clean)
    assert found >= 0.95 * len(planted) and wrong <= 0.05 * len(clean), (found, wrong)


def test_hits_in_groups(spark):
    hits = ", ".join(f"named_struct('start', {i * 7 + 2}, 'end', {i * 7 + 5}, 'kind', 'ip')" for i in range(5))
    row = spark.sql(f"SELECT repeat('aébcdéf', 5) AS text, array({hits}) AS hits").select(P._replaced(F.col("text"), F.col("hits")).alias("t")).first()
    assert row.t == "aé[ip]éf" * 5


def test_mask(spark):
    rows = [(1, "mail a@b.co or 1.2.3.4!", 3, "keep", 5), (2, None, 3, "keep", 5), (3, "🙂 +49 30 1234567", 3, "k", 5), (3, "nothing", 3, "k", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    masked = P.mask(docs)
    assert masked.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.n_words) for r in masked.collect()) == [(1, "mail [email] or [ip]!", 3), (2, "", 3), (3, "nothing", 3), (3, "🙂 [phone]", 3)]
    assert P.mask(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(14)
    word = lambda: "".join(r.choice(["tion", "the", "er", "ing"]) for _ in range(3)) + str(r.randint(0, 99)).translate(str.maketrans("0123456789", "abcdefghij"))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    item = " ".join(word() for _ in range(20))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(40, texts[3], "en", "s", 1), (41, texts[4] + " more", None, "s", 1), (42, f"{texts[5]} x {item} y {texts[6]}", "en", "s", 1), (43, "1234 567", "en", "s", 1), (44, None, None, "s", None), (45, texts[8][:200] + " me@mail.org", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left[name] = {x.doc_id for x in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = set(range(30)) | {40, 41, 42, 45}
    assert left["language_id"] == every and left["near_copies"] == every - {40, 41} and left["decontaminate"] == left["packing"] == every - {40, 41, 42}
    kept = spark.read.parquet(f"{tmp_path}/3").filter("doc_id = 45").first()
    assert kept.text.endswith("[email]") and kept.n_chars == len(kept.text)
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(x.n == x.m for x in pieces) and Counter(x.doc_id for x in pieces)[45] == 1
