"""Whitening, chunk reuse and resampling against brute force and the tokenizer itself, and on rows that are null, empty,
very long, repeated or tied; tables that are empty or have columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm import ann, bpe, chunks, packing, resample, sharding, storage, whitening

SCHEMA = "doc_id long, text string, key string, k1 long, shared string, score double, rank string, u string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    a, b = prose(rng, 300), prose(rng, 300)
    texts = [a, a, b, a + " and " + b, b + a, None, "", " \n\t", "one", "x" * 60_000, "é中😀'll " * 700, prose(rng, 9000), "a <|endoftext|> b " + a, a + "<|endoftext|>", "Перед словом " * 300, "   \n\n  " * 400, "A B'RE " * 30]
    rows = [(i, t, "k", 1, None, 0.5, "r", None) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None, None, None, None), (None, a, "k", 1, "s", 0.5, "r", "u"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- chunk reuse


@pytest.fixture(scope="module")
def enc():
    return chunks.ByteEncoder(chunks.default_tokenizer())


def told(enc, text):
    ids = enc.whole.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_chunk_reuse_gives_the_tokenizers_ids(request, spark, sf, enc, which):
    df = request.getfixturevalue("odd") if which == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = chunks.encode(df, whole=False).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == Counter((r.doc_id, *told(enc, r.text)) for r in df.collect())
    assert sum(r.reused for r in got) > 0


def test_chunk_ids_and_texts(odd, enc):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in chunks.encode(odd).collect())
    assert got == Counter((r.doc_id, tuple(enc.whole.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in odd.collect())
    assert chunks.encode(odd.limit(0)).count() == 0


def test_chunk_joins_are_repaired(enc):
    """Any subset of chunks taken over, and any cut in place of a content-defined one, gives the ids of the whole text."""
    rng = random.Random(2)
    pool = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "é", "中", "😀", "0", "12", "!", "\x85", "\xa0", " ", "᠎", "ا", "\x1c", "̀", "²", "Ⅷ", "𝒳", "​", "﻿", "\x00", "<|end"]
    for n in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.choice([5, 60, 400])))
        want = enc.whole.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == want
        ends = sorted({*rng.sample(range(1, len(t) + 1), min(len(t), 1 + len(t) // 40)), len(t)})
        pieces = [(s, e, *enc.chunk(t[s:e])) for s, e in zip([0, *ends], ends) if rng.random() < 0.7]
        assert enc.assemble(t, pieces)[0] == want


def test_chunks_are_defined_by_content():
    rng = random.Random(3)
    a, b, c = prose(rng, 2000), prose(rng, 40), prose(rng, 3)
    for t in (a, "x" * 10_000, "", c):
        ends = chunks.cuts(t)
        assert (ends[-1] if ends else 0) == len(t)
        sizes = np.diff([0, *ends])
        assert (sizes <= chunks.MOST).all() and (sizes[:-1] >= chunks.LEAST).all()
    h = lambda t: {x[2] for x in chunks._chunks(t)}
    assert len(h(a) & h(b + a)) > 0.9 * len(h(a))


# --- resampling


def brute_resample(docs, target, percent, least, seed, lo=1, hi=1, buckets=10_000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    feats = lambda w: [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
    b = lambda x: zlib.crc32(x.encode()) % buckets
    found = [(k, words(t)) for k, t in docs]
    s, t = Counter(b(f) for _, w in found for f in feats(w)), Counter(b(f) for x in target for f in feats(words(x)))
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for k, w in found:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(math.floor(1000 * math.log((t[b(f)] + 1) * (ss + buckets) / ((s[b(f)] + 1) * (tt + buckets)))) for f in feats(w))
        out.append([k, len(feats(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for r, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[4] = r
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("percent, least, lo, hi", [(10, 20, 1, 1), (60, 1, 1, 3), (100, 0, 2, 2)])
def test_resample_odd_rows(spark, sf, odd, percent, least, lo, hi):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resample.resample(odd, target, percent=percent, least_words=least, lo=lo, hi=hi).collect())
    assert got == brute_resample([(r.doc_id, r.text) for r in odd.collect()], [r.text for r in target.collect()], percent, least, 2024, lo, hi)


def test_resample_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = resample.op13_resample(spark, sf)
    assert [k for _, k in got.dtypes] == ["bigint"] * 5
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target, 10, 20, 2024)


def test_resample_empty(spark, sf, odd):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert resample.resample(odd.limit(0), target).count() == 0
    assert resample.resample(odd, target.limit(0)).count() == odd.count()
    drawn = resample.draw(spark.read.parquet(f"{sf}/documents.parquet"), target)
    assert drawn.columns == spark.read.parquet(f"{sf}/documents.parquet").columns and drawn.count() > 0


@pytest.mark.parametrize("most", [0, 1, 900, 3000])
def test_regular_sampling_with_ties(spark, most):
    """A third of the rows share one score and one key; ranks are exact and gapless down to ``most``."""
    rng = random.Random(most)
    rows = [(7, 50) if i % 3 == 0 else (None if i % 50 == 1 else rng.randint(0, 400), rng.randint(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, score long").repartition(5)
    got = resample.ranked(df, most, segments=40, samples=300).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    assert [(r.key, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == want[:most]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, min(most, 3000) + 1)) and len(got) == 3000


# --- whitening


def brute_whiten(rows, components=16):
    """{key: ...} of the rows that take part, by a dense eigendecomposition."""
    keys = [k for k, _ in rows]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], np.int64)
    d = np.unique(x, axis=0)
    n, s = len(d), d.sum(0)
    y = (n * d - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    return keys, n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def agree(got, rows):
    keys, n, deviation, z, explained = brute_whiten(rows)
    k = z.shape[1]
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    assert max(abs(r.explained - explained[r.component - 1]) for r in got) < 1e-9 and {r.identity_error < 1e-4 for r in got} == {True}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, key in enumerate(keys):
        for c in range(k):
            found = by[key, int(deviation[i])][c + 1]
            if c not in signs and abs(z[i, c]) > 0.1:
                signs[c] = np.sign(z[i, c] * found[0])
            assert any(abs(v * signs.get(c, 1) - z[i, c]) < 1e-6 or c not in signs for v in found)


def test_whitening_query(spark, sf):
    got = whitening.op11_whitening(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    agree(got.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0, 0]).tolist()) for i in range(200)]
    good += [(i, good[0][1]) for i in range(200, 300)] + [(0, good[0][1]), (None, good[1][1])]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (905, []), (906, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame([(k, v, "a", 1) for k, v in good + bad], "vec_id long, embedding array<double>, x string, n int").repartition(4)
    agree(whitening.whiten(df).collect(), good)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])]])
def test_whitening_without_spread(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_large_deviation_is_null(spark):
    rows = [(i, [float(2**40) * (i % 5), float(i)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.deviation is None) == (r.vec_id % 5 != 2) and math.isfinite(r.whitened) for r in got) and got


@pytest.mark.parametrize("kind", ["apart", "equal", "scaled", "zeros"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(60):
        k = int(rng.integers(1, 24))
        d = np.sort({"apart": rng.normal(size=k), "equal": rng.integers(0, 3, k).astype(float), "scaled": 10.0 ** rng.integers(-8, 8, k), "zeros": np.zeros(k)}[kind])
        u, v, rho = np.linalg.qr(rng.normal(size=(k, k)))[0], rng.normal(size=k) * (rng.random(k) < 0.7), float(rng.random())
        want = u @ np.diag(d) @ u.T + rho * np.outer(v, v)
        e, q = whitening.rank_one(d, u, v, rho)
        assert np.abs(q @ np.diag(e) @ q.T - want).max() < 1e-11 * max(np.abs(want).max(), 1e-300) + 1e-300
        assert np.abs(q.T @ q - np.eye(k)).max() < 1e-11 and (np.diff(e) >= 0).all()


def test_spectra_combine(spark):
    """Many tasks, combined in more than one level, give the covariance of all."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(400, 8)) * 40).astype(np.int64) + 1_000_000
    df = spark.createDataFrame([(bytearray(r.tobytes()),) for r in x], "x binary").repartition(20)
    s = whitening.spectrum(df, 8, fan=3)
    assert s.n == 400 and s.sums == x.sum(0).tolist()
    assert np.allclose(s.u @ np.diag(s.d) @ s.u.T, np.cov(x.T, bias=True) * 400, rtol=1e-9, atol=1e-6)


def test_no_text_or_vector_on_the_driver(spark, sf):
    """What the operators read of the tables stays in tasks: plans end in a projection of keys and figures."""
    for q in (chunks.op12_chunk_bpe, resample.op13_resample, whitening.op11_whitening):
        out = q(spark, sf)
        assert not {"text", "embedding", "x", "chunk"} & set(out.columns)
        assert out.select(F.count("*")).first()[0] > 0


# --- mended in this round


def test_parts_in_any_script(spark):
    """Long texts in scripts other than Latin are cut, and the ids stay those of the whole text."""
    enc = bpe.encoding(bpe.default_ranks(), bpe._pattern())
    rng = random.Random(8)
    pools = ["Перед началом слова и 'd конец", "كلمة في جملة", "語句。次の文、漢字！「かな」カタカナ・한국어", "word ’s it's I'll  \n\n x", "!!! ... ''s 're 12 ٣٤"]
    for pool in pools:
        pieces = [*pool.split(" "), " ", "  ", "\n", "。", "、", "!", "'", "\x1c", "\x85", "\u3000"]
        text = "".join(rng.choice(pieces) for _ in range(12_000))
        cut = list(bpe.parts(text, 500))
        assert "".join(cut) == text and len(cut) > 5, pool
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert len(list(bpe.parts("Слово слово " * 20_000))) > 5


def test_nearest_with_mixed_lengths(spark):
    """Queries whose own commonest length differs from the index's: those of the index's length are answered."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3 if i % 50 == 0 and i < 300 else 8).tolist()) for i in range(310)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.Index(df).search(df.where("vec_id % 50 = 0")).collect()
    assert {r.query_id for r in got} == {300} and len(got) == 5
    assert ann.Index(df).search(df.where("vec_id < 0")).count() == 0


def test_bounded_draws_are_the_smallest(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h")).repartition(7)
    want = sorted((r.h, r.id) for r in df.collect())[:100]
    for low in (F.col("h") < want[99][0] + 2**58, F.col("h") < want[50][0], F.lit(False)):
        assert list(storage.smallest(df, [F.col("h")], low, 100, 5000)["id"]) == [i for _, i in want]
    docs = spark.createDataFrame([(i, "x" * (1 + i % 97)) for i in range(3000)], "doc_id long, text string").repartition(5)
    base = storage.stage(sharding._prepared(docs, "doc_id", "text"), "base")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "k", "k2"), 11) + 1) / F.lit(float(2**53 + 1))
    whole = base.select("k", (-F.log(u) / (F.col("size") + sharding.RECORD)).alias("o")).orderBy("o").limit(200).toPandas()["k"]
    hot, cuts = sharding.splitters(base, 16, 200)
    cold = np.sort(whole[~whole.isin(hot)].to_numpy())
    assert set(cuts) <= set(cold)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_stages_on_odd_rows(spark, sf, odd, rows):
    """Null keys and texts, repeated rows, clashing columns and an empty table go through every stage."""
    import corpus_pipeline

    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 3 > 0, "s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.col("key"), F.lit(1).alias("_own"), F.lit("x").alias("h"), F.lit(2).alias("id"))
    docs = storage.stage(docs if rows == "odd" else docs.where("false"), "docs")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = storage.stage(step(spark, docs, sf), name)
        assert out.columns == docs.columns, name
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        if rows == "odd":
            assert out.count() > (0 if name == "near_dedup" else docs.count() - 3)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id"} <= set(packed.columns) and (packed.count() > 0) == (rows == "odd")


def test_packing_holds_few_rows():
    """Workers turn a batch of ten thousand long texts into objects a slice at a time; no row is lost between slices."""
    import tracemalloc

    whole = pa.RecordBatch.from_arrays([pa.array(["x" * 5000 + str(i) for i in range(10_000)])], ["t"])
    tracemalloc.start()
    n, last = 0, ""
    for b in packing._sliced([whole, whole.slice(0, 3), whole.slice(0, 0)]):
        texts = b.column(0).to_pylist()
        n, last = n + len(texts), max(last, texts[-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_003 and last.endswith("x9999") and peak < 10_000_000


def test_packing_drops_its_encoder(spark, monkeypatch):
    """A worker that cuts ids into pieces does not hold the words that it remembered when it encoded."""
    df = spark.createDataFrame([(1, "one two three", "s")], "doc_id long, text string, source string")
    steps, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: steps.append(f) or plain(self, f, schema))
    packing.pack(df)
    packing._encoder(packing.default_tokenizer())
    assert packing._encoder.cache_info().currsize == 1
    assert list(steps[-1](iter([]))) == [] and packing._encoder.cache_info().currsize == 0
