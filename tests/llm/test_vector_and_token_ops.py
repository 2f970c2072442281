"""Whitening, alignment of tokenizers, and sequence files, against brute force, the libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docledger.llm import align as A
from docledger.llm import binary as B
from docledger.llm import queries as Q
from docledger.llm import units as U
from docledger.llm import whiten as W
from docledger.session import scratch_folder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "The", " of", "\n", "  ", " ", "\t", "é", "É", "日本", "<|endoftext|>", "<s>", ".", "1", "23", "\r\n", "\x00", "🙂", "́", " ", " ", "\x85", "\x0b", "ﬁ", "'s", " don't", ",", "!!", "Σ", "\x1c", "<0x0A>", " straße"]


def noise(n, seed, extra=()):
    r = random.Random(seed)
    return ["".join(r.choice([*PARTS, *extra]) for _ in range(r.randint(0, 14))) for _ in range(n)]


ODD = [(3, None, "x"), (1, "", "x"), (1, "", "x"), (2, "same key", "x"), (2, "same key, other text", "x"), (None, "no key", None), (5, "y" * 200_000 + " end", "x"), (4, "the of and " * 30_000, "x"), (9, " \n ", "x")]
ODD_SCHEMA = "doc_id long, text string, n_tokens string"


# whitening


@pytest.mark.parametrize("kind", ["random", "graded", "ties", "near ties", "rank 3", "zero", "one", "indefinite"])
def test_spectrum_is_the_librarys(kind):
    r = np.random.default_rng(5)
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    v = {
        "random": np.cov(r.standard_normal((40, 500))),
        "graded": (q * 10.0 ** np.linspace(0, -9, 40)) @ q.T,
        "ties": np.diag([3.0] * 20 + [1.0] * 18 + [0.0] * 2),
        "near ties": (q * np.array([5.0] * 15 + [5 + 1e-12] * 10 + [1e-3] * 15)) @ q.T,
        "rank 3": (q[:, :3] * [3, 2, 1]) @ q[:, :3].T,
        "zero": np.zeros((5, 5)),
        "one": np.array([[2.0]]),
        "indefinite": np.diag(np.arange(40.0) - 10),
    }[kind]
    e, x = W.spectrum(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * size * len(v)
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-13 * len(v) and np.abs(v @ x - x * e).max() <= 1e-13 * size * len(v)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30)) @ np.diag(10.0 ** np.linspace(0, -12, 30))
    u, _, v = np.linalg.svd(a)
    x = W.polar(a)
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-12 and np.abs(x - u @ v).max() < 1e-2
    h = x.T @ a
    assert np.abs(h - h.T).max() < 1e-12 * np.abs(a).max()


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = n * x - s
    e, q = np.linalg.eigh((c / n).T @ (c / n) / n)
    return n, [sum(int(y) ** 2 for y in row) for row in c], (c / n) @ q[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def test_whitening_rows(spark):
    r = np.random.default_rng(2)
    good = (r.standard_normal((300, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5])).astype(np.float32)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [nan] * 6), (904, [1.0, 2.0, inf, 0.0, 0.0, 0.0]), (905, [-inf] * 6), (906, [1.0, 2.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(0, good[0].tolist()), (None, good[5].tolist())]
    df = spark.createDataFrame([(k, v, 1.5) for k, v in rows + bad], "vec_id long, embedding array<float>, whitened double").repartition(3)
    got = W.whiten(df, most=4).collect()
    n, deviation, told, share = plain_whitening([v for _, v in rows])
    assert len(got) == 4 * n and {x.n for x in got} == {n} and all(x.identity_error < 1e-10 for x in got)
    assert sum(x.vec_id is None for x in got) == 4 and sum(x.vec_id == 0 for x in got) == 8
    for x in got:
        if x.vec_id:
            assert x.deviation == deviation[x.vec_id] and abs(x.explained / share[x.component - 1] - 1) < 1e-9
    for c in range(1, 5):
        mine = np.array([x.whitened for x in sorted((x for x in got if x.component == c and x.vec_id), key=lambda x: x.vec_id)])
        other = told[1:300, c - 1]
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8
    assert W.whiten(df.filter("vec_id >= 900")).count() == 2  # the short vector is now the only one
    assert W.whiten(df.limit(0)).collect() == [] and W.whiten(df.limit(0)).columns == W.whiten(df).columns


def test_whitening_without_variance_and_wide_sums(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(x.deviation, x.whitened, x.explained) for x in W.whiten(same).collect()} == {(0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = W.whiten(line).collect()
    assert all(x.whitened == 0 for x in got if x.component > 1) and all(x.identity_error < 1e-9 for x in got)
    far = spark.createDataFrame([(0, [1e30, 0.0]), (1, [-1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    told = {x.vec_id: x.deviation for x in W.whiten(far, most=1).collect()}
    assert told == {0: None, 1: None, 2: 0}


def test_whitening_query(spark, tmp_path):
    r = np.random.default_rng(3)
    spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(r.standard_normal((200, 40)))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.QUERIES["op11_whitening"](spark, str(tmp_path))
    assert got.count() == 200 * 32 and dict(got.dtypes)["component"] == "int" and dict(got.dtypes)["deviation"] == "bigint"


# units and sequence files


def test_units_encode_as_the_whole_text():
    texts = noise(4000, 1) + [None, "", " ", "  a  b ", "x" * 100_000, "end of file <|endoftext|> a"]
    tokenizer = Tokenizer.from_file(BYTE)
    assert U.cut_by(BYTE) and not U.cut_by(WORD)
    ids = U.Ids(BYTE)
    for a in range(0, len(texts), 700):  # several turns, so that remembered units are used too
        flat, count = ids.encode(pa.array(texts[a : a + 700], pa.string()))
        ends = np.cumsum(count)
        for t, e, n in zip(texts[a : a + 700], ends, count, strict=True):
            assert flat[e - n : e].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
    flat, count = U.Ids(WORD).encode(pa.array(texts[:200], pa.string()))
    tokenizer = Tokenizer.from_file(WORD)
    assert flat.tolist() == [i for t in texts[:200] for i in tokenizer.encode(t, add_special_tokens=False).ids]


def test_memory_of_units_is_bounded(monkeypatch):
    """Also with texts that alone are more than it holds."""
    monkeypatch.setattr(U, "POOL", 500)
    ids, tokenizer = U.Ids(BYTE), Tokenizer.from_file(BYTE)
    for i in range(60):
        texts = [" ".join(f"w{i * 37 + j}, and" for j in range(40 if i % 7 else 400)), None, "a\u00a0 b", "a \u00a0b  "]
        flat, count = ids.encode(pa.array(texts))
        assert flat.tolist() == [x for t in texts for x in tokenizer.encode(t or "", add_special_tokens=False).ids] and count[1] == 0
        assert len(ids.pool) == 500 and ids.used <= 500


def plain_documents(rows, end):
    tokenizer, out, start = Tokenizer.from_file(BYTE), [], 0
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_sequence_files_round_trip(spark):
    texts = noise(400, 7)
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], ODD_SCHEMA).repartition(5)
    folder = scratch_folder(spark, "test")
    manifest = B.write_sequences(docs, BYTE, folder, length=16, part_bytes=1500)
    parts = manifest.orderBy("part").collect()
    assert len(parts) > 3 and sum(p.documents for p in parts) == 400
    got = sorted(tuple(r) for r in B.read_documents(manifest).collect())
    assert got == plain_documents([(i * 3, t) for i, t in enumerate(texts)], 0)
    flat = []
    for p in parts:
        file = B.SequenceFile(p.folder, p.name)
        assert len(file) == p.sequences == -(-p.tokens // 16)
        views = [file[i] for i in range(len(file))]
        assert all(len(ids) == len(mask) == 16 for ids, mask in views) and not views[0][0].flags.owndata
        assert views[0][0].dtype == np.uint16 and sum(mask.true_count for _, mask in views) == p.tokens and all(mask.true_count == 16 for _, mask in views[:-1])
        assert (file[-1][0] == views[-1][0]).all()
        with pytest.raises(IndexError):
            file[len(file)]
        flat.extend(np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in views]).tolist())
    assert len(flat) == parts[-1].start + parts[-1].tokens
    again = B.read_manifest(spark, parts[0].folder)
    assert sorted(again.collect()) == sorted(manifest.collect())


def test_sequence_files_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = B.read_documents(B.write_sequences(docs, BYTE, scratch_folder(spark, "odd"), length=64, part_bytes=100)).orderBy("start").collect()
    assert len(got) == len(ODD) and [r.doc_id for r in got] == [None, 1, 1, 2, 2, 3, 4, 5, 9]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((k or -1, n, c) for k, _, n, c in plain_documents([(k, t) for k, t, _ in ODD], 0))
    empty = B.read_documents(B.write_sequences(docs.limit(0), BYTE, scratch_folder(spark, "none")))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    text_keys = B.write_sequences(docs.select(F.concat(F.lit("k"), "doc_id").alias("name"), "text"), BYTE, scratch_folder(spark, "names"), key="name")
    assert B.read_documents(text_keys, key="name").dtypes[0] == ("name", "string")


def test_a_lost_attempt_leaves_nothing_to_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    manifest = B.write_sequences(docs, BYTE, str(tmp_path))
    run = manifest.first().folder
    for name in ("part-000000-lost.arrow", "part-000000-lost.index.arrow"):
        (tmp_path / run.rsplit("/", 1)[1] / name).write_bytes(b"cut short")
    assert B.read_documents(manifest).count() == 50


def test_sequence_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(noise(120, 9))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["op13_sequence_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_documents(rows, 0)


# alignment


def test_gustavson_product_is_the_dense_one(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 7)
    r = np.random.default_rng(4)
    for _ in range(30):
        h, k, w = r.integers(0, 9, 3)
        x, y = r.integers(0, 3, (h, k)) * (r.random((h, k)) < 0.5), r.integers(0, 3, (k, w)) * (r.random((k, w)) < 0.5)
        sx, sy = (A.Sparse.of(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (x, y))
        out = sx.times(sy)
        dense = np.zeros((h, w), int)
        dense[out.rows(), out.column] = out.data
        assert (dense == x @ y).all()
        t = sx.transposed()
        back = np.zeros((k, h), int)
        back[t.rows(), t.column] = t.data
        assert (back == x.T).all()


@cache
def libraries():
    import sentencepiece

    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=PIECE), A.byte_letters()


def plain_alignment(text):
    tokenizer, sp, of = libraries()
    if not text:
        return None
    a = tokenizer.encode(" " + text, add_special_tokens=False)
    side_a = [(i, bytes(of[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    side_b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    if any(b"".join(t for _, t in side) != whole for side in (side_a, side_b)):
        return None
    spans = []
    for side in (side_a, side_b):
        at, out = 0, []
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        spans.append(out)
    cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, low = [], 0
    for high in cuts:
        groups.append(tuple([i for i, s, e in side if low <= s and e <= high] for side in spans))
        low = high
    overlaps = sum(s < f and r < e for _, s, e in spans[0] for _, r, f in spans[1]) if len(whole) < 500 else None
    return len(spans[0]), len(spans[1]), groups, overlaps


def plain_rows(texts):
    told = [plain_alignment(t) for t in texts]
    links = [Counter((x, y) for ga, gb in t[2] for x in ga for y in gb) if t else Counter() for t in told]
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for t, c in zip(told, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in t[2]) if t else ""
        out.append((
            t[0] if t else 0, t[1] if t else 0, len(t[2]) if t else 0, sum(c.values()), (t[3] if t else 0),
            sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if t else "",
        ))
    return out


def told_rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps, r.n_best, r.count_sum, r.groups) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("broadcast", [None, 40])
def test_alignment_agrees_with_brute_force(spark, monkeypatch, broadcast):
    """Also with most pairs left out of the broadcast."""
    if broadcast:
        monkeypatch.setattr(A, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(A, "ROW_PAIRS", 3)
    texts = noise(500, 3, extra=["▁", " supercalifragilistic", "…", " naïve"]) + [None, "", " ", "same text", "same text", "aaaaaaaaaaaaaaaa" * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = told_rows(A.align_documents(df, BYTE, PIECE))
    assert got == plain_rows(texts)
    assert sum(r[0] > 0 for r in got) > 300 and sum(r[0] == 0 for r in got) > 20  # texts with a word mark are not given back


def test_alignment_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = A.align_documents(df, BYTE, PIECE).collect()
    assert len(got) == len(ODD) and sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, *_ in ODD)
    assert all(r.n_a == r.n_links == r.count_sum == 0 and r.groups == "" for r in got if r.doc_id in (1, 3))
    long = next(r for r in got if r.doc_id == 4)
    assert long.n_a > 80_000 and long.n_best > 0
    assert A.align_documents(df.limit(0), BYTE, PIECE).collect() == []
    shown = A.align_documents(df.filter("doc_id = 2"), BYTE, PIECE, groups=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() for r in shown) and all("|" in r.groups for r in shown)


def test_link_table(spark):
    texts = ["the cat", "the dog", "the cat sat", None]
    got = A.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE, PIECE).collect()
    al = A.aligner(BYTE, PIECE)
    the = [r for r in got if al.a.bytes[r.a_id] == b" the"]
    assert [(al.b.bytes[r.b_id], r.documents, r.links, r.shared_bytes, r.best) for r in the] == [(b" the", 3, 3, 12, True)]


def test_alignment_query(spark, tmp_path):
    texts = noise(150, 11)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["op12_align_tokenizers"](spark, str(tmp_path)).withColumnRenamed("groups_sha256", "groups")
    assert told_rows(got) == plain_rows(texts)


def test_bytes_of_all_ids():
    al = A.Aligner(BYTE, PIECE)
    assert al.a.bytes[50256] == b"<|endoftext|>" and sorted(len(x) for x in al.a.bytes)[0] == 1
    assert {bytes([b]) for b in range(256)} <= set(al.a.bytes) and {bytes([b]) for b in range(256)} <= set(al.b.bytes)
    assert pa.array(al.size_b).to_pylist() == [len(x) for x in al.b.bytes]
