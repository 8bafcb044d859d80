"""The training-data operators against brute force, round trips, held-out labels, and rows that are null, empty, very
long, repeated or crowded; tables that are empty or have columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import ann, bpe, components, lines, packing, passages, pii, quality, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, N string, p double"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeats, ties, clashing column names."""
    rng = random.Random(7)
    a, b = prose(rng, 120), prose(rng, 120)
    texts = [a, a, b, None, "", " \n\t", "one", "two words", "x" * 50_000, prose(rng, 8000), a + "\n" + b, "é ü 中 😀 ́ a@b.co", "call +1 (988) 555-2485 or 4041894974608795", b.upper(), "\n".join(["same line here"] * 40)]
    rows = [(i, t, "en", "s1" if i % 3 else None, 0, "x", "y", 0.5) for i, t in enumerate(texts)]
    rows += [(2, b, None, None, None, None, None, None), (None, a, "en", "s2", 0, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- quality


def brute_counts(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, hit = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            hit |= {i, i + 1, i + 2}
    said = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(said) - len(set(said)), len(hit)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.score(df).collect())
    assert got == Counter((r.doc_id, *brute_counts(r.text)) for r in df.collect())


def test_quality_verdicts(spark, sf, docs, none):
    out = quality.score(docs)
    assert out.where("base_failed and kept").count() == 0
    good = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    r = good.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert r > 0.9
    assert quality.score(none).count() == 0


# --- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype("float32")
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, [1.0] * 16), (5200, [1.0, None] + [1.0] * 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ix = ann.Index(df, leaf=64)
    got = defaultdict(list)
    for r in ix.search(df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert set(got) == set(range(0, 3000, 50)) and all(len(v) == 5 for v in got.values())
    hit = 0
    for q in got:
        s = np.round(u @ u[q], 10)
        s[q] = -2
        hit += len({i for i, _ in got[q]} & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert hit / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]  # ties go to smaller ids, itself left out
    assert ix.recall >= 0.9


def test_nearest_small(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.Index(df).search(df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    empty = df.limit(0)
    assert ann.Index(empty).search(empty).count() == 0


def test_nearest_repeats(spark):
    """A row repeated seven times beside one equal vector; candidates repeated; two vectors under one id; clashing columns."""
    rows = [(0, [1.0, 0.0])] * 7 + [(1, [1.0, 0.0])] + [(2, [1.0, 0.5])] * 3 + [(3, [0.0, 1.0]), (3, [0.1, 1.0])]
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in rows], "vec_id long, embedding array<double>, q long, id string, bucket int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.Index(df).search(df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


# --- packing


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("shares", [None, {"s1": 0.7}])
def test_packing(request, which, shares):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    df = request.getfixturevalue(which)
    p = packing.pack(df, shares=shares, length=256, window=4).toPandas()
    want = Counter()
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[(None if r.doc_id is None else int(r.doc_id), tuple(ids))] += 1
    assert p["length"].sum() == sum(len(k[1]) * n for k, n in want.items())
    for r in p.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
    sizes = p.groupby("sequence_id")["length"].sum()
    assert (sizes <= 256).all() and (sizes < 256).sum() <= 1
    rest = Counter({k: n for k, n in want.items()})
    once = {k[0] for k in want if sum(n for q, n in want.items() if q[0] == k[0]) == 1}
    for (d, ids), _ in rest.items():
        if d in once and d is not None:
            mine = p[p["doc_id"] == d].sort_values("start")
            assert [i for x in mine["ids"] for i in x] == list(ids)


def test_packing_mixture(docs):
    p = packing.pack(docs, length=256, window=8, with_ids=False).toPandas()
    share = p.groupby("source")["length"].sum() / p["length"].sum()
    sent = p.pivot_table(index="window", columns="source", values="length", aggfunc="sum", fill_value=0).reindex(range(1, int(p["window"].max()) + 1), fill_value=0).cumsum()
    due = np.outer(sent.index.to_numpy() * 256 * 8, share[sent.columns].to_numpy())
    assert np.abs(sent.to_numpy() - due).max() <= 256 + 1  # no queue is ahead or behind by more than a piece


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_word_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    e, rng = packing.WordEncoder(packing.default_tokenizer()), random.Random(1)
    letters = "abcXYZ 'stredm\n\t\x1c\x85\xa0.,!?123²½éÉßİŉǅΣσçæ中́<|endoftext|>😀ª_ſK"
    for s in ("a<|endoftext|>b", "<|startoftext|> x <|endoftext|>", "<|ENDOFTEXT|> y", "<| endoftext |>"):
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    assert 49407 in np.frombuffer(e.encode("a<|endoftext|>b"), "<u4").tolist() and e.by_word
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


# --- passages


def test_passages(spark, none):
    rng = random.Random(11)
    shared, other = prose(rng, 70), prose(rng, 70)
    fuzzy = shared.split()
    for i in (10, 25, 41, 58):
        fuzzy[i] = "edited"
    del fuzzy[33]
    base = [prose(rng, 200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows[2] = (2, base[2] + " " + shared + " " + base[2][:50])
    rows[5] = (5, shared + " " + base[5])
    rows[9] = (9, base[9] + " " + " ".join(fuzzy))
    rows += [(20, base[0]), (21, base[0]), (22, None), (23, ""), (None, prose(rng, 60)), (24, " ".join(other.split()[:40])), (25, other)]
    got = passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc, r.other, r.kind) for r in got}
    assert {(5, 2, "passage"), (9, 2, "passage"), (20, 0, "copy"), (21, 0, "copy")} <= pairs
    assert {d for r in got for d in (r.doc, r.other)} == {0, 2, 5, 9, 20, 21}
    r = next(r for r in got if (r.doc, r.other) == (5, 2))
    assert (r.start, r.end, r.other_start, r.other_end) == (0, 70, 200, 270)
    assert passages.find(none).count() == 0


def test_seeds_of_fuzzy_passages():
    """Passages of 60 words with words replaced at random share two seeds mostly, down to the least identity."""
    rng = random.Random(14)
    for edits, least in ((12, 0.8), (9, 0.93), (6, 0.98)):
        met = 0
        for _ in range(500):
            a = np.array([rng.getrandbits(32) for _ in range(60)], np.uint32)
            b = a.copy()
            for i in rng.sample(range(60), edits):
                b[i] = rng.getrandbits(32)
            met += len(set(passages.seeds(a)[0].tolist()) & set(passages.seeds(b)[0].tolist())) >= 2
        assert met >= least * 500, (edits, met)


@pytest.mark.parametrize("words,least", [(52, (0.7, 0.9, 0.95)), (60, (0.8, 0.92, 0.97)), (70, (0.87, 0.95, 0.97)), (100, (0.92, 0.97, 0.97))])
def test_fuzzy_passages_are_found(spark, words, least):
    """Passages in strangers, words changed six words or more from both ends: found, not only met, and nothing else is."""
    rng, some = random.Random(words), 120
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, kind = [], {}
    for n, identity in enumerate((0.82, 0.85, 0.9)):
        for _ in range(some):
            a = said(words)
            b = a[:]
            for i in rng.sample(range(6, words - 6), int(words * (1 - identity))):
                b[i] = "x" + b[i]
            kind[len(rows)] = n
            rows += [(len(rows) + i, " ".join(said(80) + t + said(80))) for i, t in enumerate((a, b))]
    got = [(r.other, r.doc, r.equal, r.end - r.start) for r in passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(d == o + 1 and o in kind and equal >= 0.8 * size for o, d, equal, size in got)
    share = [len({o for o, *_ in got if kind[o] == n}) / some for n in range(3)]
    assert all(x >= y for x, y in zip(share, least)), share


def test_ends_by_brute_force():
    """The ends chosen are the farthest that hold the identity, as trying all of them says, also among very many."""
    rng = random.Random(6)
    for _ in range(300):
        ends = []
        for _ in range(2):
            at, out = (0, 0, 0), [(0, 0, 0)]
            for _ in range(rng.randint(0, 8)):
                run = rng.randint(1, 9)
                at = (at[0] + rng.randint(0, 4) + run, at[1] + rng.randint(0, 4) + run, at[2] + run)
                out.append(at)
            ends.append(out)
        core = (20, 20, rng.randint(15, 20))
        want = next(((p, q) for p in reversed(ends[0]) for q in reversed(ends[1]) if (lambda x, y, n: max(x, y) >= 30 and min(x, y) >= 0.8 * max(x, y) and n >= 0.8 * max(x, y))(*(core[i] + p[i] + q[i] for i in range(3)))), None)
        assert passages._widest(core, *ends, 30, 0.8) == want
    many = [(4 * i, 4 * i, 2 * i) for i in range(50_000)]
    assert passages._widest((20, 20, 20), many, many, 60, 0.8) is None


def test_chain_is_best():
    rng = random.Random(2)
    for _ in range(60):
        pts = sorted({(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(12)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        best = [6.0] * len(pts)
        for i in range(len(pts)):
            for j in range(len(pts)):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + 6 - 0.05 * (x[i] - x[j] + y[i] - y[j])) if x[j] < x[i] else best[i]
        path = next(passages.chains(x, y))
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(path, path[1:]))
        score = 6 * len(path) - 0.05 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(path, path[1:]))
        assert score == pytest.approx(max(best))


def brute_pairs(texts, size=50):
    """Pairs of texts (by place) that share ``size`` words in a row, as class roots."""
    where, root = defaultdict(set), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, t in enumerate(texts):
        w = WORD.findall(t)
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add(d)
    for s in where.values():
        for d in s:
            root[max(top(d), top(min(s)))] = min(top(d), top(min(s)))
    return [top(i) for i in range(len(texts))]


def test_passages_between_strangers(spark):
    """A passage whose halves others hold; different texts under one key and under null keys; a passage said twice."""
    rng = random.Random(21)
    whole, twice = prose(rng, 90).split(), prose(rng, 70)
    first, second = " ".join(whole[:45]), " ".join(whole[45:])
    rows = [(1, first), (9, first), (2, second), (10, second), (5, first + " " + second), (6, first + " " + second)]
    rows = [(k, prose(rng, 60) + " " + t + " " + prose(rng, 60)) for k, t in rows]
    shared, equal = prose(rng, 120), prose(rng, 120)
    rows += [(None, prose(rng, 60) + " " + shared), (None, shared + " " + prose(rng, 60)), (30, equal), (30, equal + " " + prose(rng, 60)), (30, equal)]
    rows += [(40, prose(rng, 30) + " " + twice + " " + prose(rng, 90) + " " + twice), (41, twice + " " + prose(rng, 20))]
    got = passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = lambda d, o: sorted((r.start, r.end, r.other_start, r.other_end) for r in got if (r.doc, r.other) == (d, o))
    assert at(6, 5) == [(60, 150, 60, 150)]
    assert len(at(None, None)) == 1 and at(None, None)[0][1] - at(None, None)[0][0] == 120
    assert len(at(30, 30)) == 1
    assert at(41, 40) == [(0, 70, 30, 100), (0, 70, 190, 260)]
    assert len(got) == 5


@pytest.mark.parametrize("size", [12, 17, 25])
def test_passages_of_frequent_sentences(spark, size):
    """Exact passages built of sentences that many texts hold singly: every class by brute force is linked."""
    rng = random.Random(size)
    sentence = [prose(rng, size) for _ in range(60)]
    texts = [" ".join(x for s in rng.sample(sentence, 6) for x in (s, prose(rng, rng.randint(3, 9)))) for _ in range(600)]
    for p in range(60):
        passage = " ".join(rng.sample(sentence, 75 // size + 2))
        for d in rng.sample(range(600), 3):
            texts[d] = texts[d] + " " + prose(rng, 10) + " " + passage
    got = passages.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert r.other < r.doc and r.equal >= 0.8 * max(r.end - r.start, r.other_end - r.other_start)
        root[max(top(r.doc), top(r.other))] = min(top(r.doc), top(r.other))
    want = brute_pairs(texts)
    lost = sum(top(d) != top(w) for d, w in enumerate(want))
    assert len(set(want)) < 600 and not lost, lost


def test_passages_repeated_phrases():
    """A phrase that stands a thousand times in one text takes one pass, not one a place."""
    rng = random.Random(3)
    phrase = prose(rng, 12)
    a = passages.word_hashes((" ".join(phrase + " " + prose(rng, 9) for _ in range(3000))).split())
    b = passages.word_hashes((prose(rng, 40) + " " + phrase + " " + prose(rng, 40)).split())
    x, y = passages.points(*(passages.indexed(*passages.own_seeds(w)) for w in (a, b)))
    assert len(x) > 3000 and passages.passages(x, y, a.tolist(), b.tolist()) == []
    for _ in range(200):
        p, q = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, v in enumerate(p):
            for j, w in enumerate(q):
                best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
        assert passages.align(p, q) == best[-1][-1]
    same = passages.word_hashes(["ha"] * 5000)
    assert len(passages.own_seeds(same)[0]) == 1


def test_passages_of_one_word(spark):
    """Runs of one word or of a short phrase are passages from 50 words on, also where many shorter runs share their seeds."""
    rng = random.Random(31)
    said = lambda phrase, n: " ".join((phrase.split() * n)[:n])
    about = lambda t: prose(rng, 60) + " " + t + " " + prose(rng, 60)
    rows = [(i, about(said("the", 20 + i))) for i in range(29)]
    rows += [(30, about(said("the", 51))), (31, about(said("the", 400))), (32, about(said("the", 90))), (33, about(said("the", 51)))]
    rows += [(40, about(said("ha ho hi", 60))), (41, about(said("ho hi ha", 75)))]
    rows += [(50, about(said("der", 30) + " " + said("die", 35))), (51, about(said("der", 30) + " " + said("die", 35)))]
    got = passages.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    pairs = {(r.doc, r.other) for r in got.collect()}
    assert {d for p in pairs for d in p} == {30, 31, 32, 33, 40, 41, 50, 51}
    root = {}
    for d, o in sorted(pairs):
        root[d] = root.get(o, o)
    assert root[41] == 40 and root[51] == 50 and len(pairs) >= 5


def test_passages_on_both_sides(spark):
    """Every document with a repeated passage has rows of its own, the earliest too."""
    rng = random.Random(33)
    shared, whole = prose(rng, 70), prose(rng, 80)
    rows = [(1, prose(rng, 60) + " " + shared), (2, shared + " " + prose(rng, 60)), (3, whole), (4, whole), (5, whole), (6, prose(rng, 90))]
    got = passages.find(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = {(r.doc, r.other) for r in got.collect()}
    own = passages.both_sides(got).collect()
    assert {r.doc for r in own} == {1, 2, 3, 4, 5}
    assert {r.doc for r in own} == {d for p in pairs for d in p}
    assert {(r.doc, r.start, r.end, r.other, r.other_start, r.other_end) for r in own} == {(r.other, r.other_start, r.other_end, r.doc, r.start, r.end) for r in own}


def test_passages_beside_unlike_words():
    """A few shared words before and behind an unlike stretch do not hide the passage beyond it."""
    rng = random.Random(32)
    new = lambda n: [rng.getrandbits(32) for _ in range(n)]
    for _ in range(20):
        before, passage, behind = new(12), new(60), new(12)
        a = np.array(new(30) + before + new(35) + passage + new(35) + behind + new(30), np.uint32)
        b = np.array(new(20) + before + new(35) + passage + new(35) + behind + new(40), np.uint32)
        x, y = passages.points(*(passages.indexed(*passages.placed_seeds(w)) for w in (a, b)))
        assert passages.passages(x, y, a.tolist(), b.tolist()) == [(77, 137, 67, 127, 60)]


def test_words_are_split_as_bytes(spark):
    """Words end at blanks of ASCII only, and a text that is not UTF-8 is read as its bytes are."""
    import xxhash

    texts = [b"a\x1cb \xc2\xa0c\t\nd\x0b\xc2\x85\x0ce \xe4\xb8\xad", b" x\xff y\xc3 ", b" \n\t", b"", None]
    df = spark.createDataFrame([(i, t and bytearray(t)) for i, t in enumerate(texts)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) text")
    got = {r.doc: r for r in passages.word_table(df).collect()}
    want = {0: [b"a\x1cb", b"\xc2\xa0c", b"d", b"\xc2\x85", b"e", b"\xe4\xb8\xad"], 1: [b"x\xff", b"y\xc3"]}
    assert got.keys() == want.keys()
    for doc, words in want.items():
        assert got[doc].n == len(words) and got[doc].id == xxhash.xxh64_intdigest(b" ".join(words)) - 2**63
        assert np.frombuffer(got[doc].words, np.uint32).tolist() == [xxhash.xxh32_intdigest(w) for w in words]


def test_passages_found(docs):
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    where = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - 49):
            if len(set(w[i : i + 50])) > 10:
                where[tuple(w[i : i + 50])].add(d)
    want = {d for s in where.values() if len(s) > 1 for d in s}
    got = {d for r in passages.find(docs).collect() for d in (r.doc, r.other)}
    assert want <= got


# --- byte-level BPE


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_bpe(request, which):
    df = request.getfixturevalue(which)
    enc = bpe.encoding(bpe.default_ranks(), bpe._pattern())
    want = Counter()
    for r in df.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(df).collect()) == want


def test_bpe_parts_and_columns(odd):
    rng, enc = random.Random(4), bpe.encoding(bpe.default_ranks(), bpe._pattern())
    for _ in range(50):
        t = "".join(rng.choice("ab é'st 12\n\t  .,!") for _ in range(3000))
        assert "".join(bpe.parts(t, 100)) == t
        assert [i for p in bpe.parts(t, 100) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    out = bpe.add_decoded(bpe.add_token_ids(odd)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out)


# --- lines


def brute_lines(rows):
    """Kept (doc index, line index) by exact Jaccard over all pairs of lines."""
    every = [(i, n, x) for i, t in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    sets = [frozenset(x[k : k + 5] for k in range(max(1, len(x) - 4))) for _, _, x in every]
    par = list(range(len(every)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a in range(len(every)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if every[a][2] == every[b][2] or both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                par[max(find(a), find(b))] = min(find(a), find(b))
    return {every[a][:2] for a in range(len(every)) if find(a) == a}


def test_lines(spark):
    rng = random.Random(8)
    near = prose(rng, 30)
    words = near.split()
    words[12] = "changed"
    texts = [near + "\n\nunique " + prose(rng, 20), prose(rng, 25) + "\n" + " ".join(words), near, "\n".join(["again and again we say"] * 5), None, "", " \n ", prose(rng, 3000), near + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    keep = brute_lines(texts)
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not WORD.search(x) or (i, n) in keep)
        assert got[i] == want


def test_lines_odd(odd, none, docs):
    out = lines.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("text is null").count() == odd.where("text is null").count()
    assert lines.dedup(none).count() == 0
    counted = lines.dedup(docs, counts=True)
    assert counted.count() == docs.count()
    once = [x for r in counted.collect() for x in r.text.split("\n") if WORD.search(x)]
    assert len(once) == len(set(once))
    assert counted.agg(F.sum("n_lines") - F.sum("n_removed")).first()[0] == len(once)


def test_lines_of_repeats(spark):
    """Shingles are sets: lines that repeat a stretch are alike at any ratio of lengths."""
    df = spark.createDataFrame([(0, "=" * 20), (1, "=" * 70), (2, "ha " * 10), (3, "ha " * 25), (4, "quite another line of words")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert [got[i] for i in range(5)] == ["=" * 20, "", "ha " * 10, "", "quite another line of words"]


def test_lines_without_blanks(spark):
    """One of the first characters changed, in long and short lines without blanks."""
    rng = random.Random(13)
    rows = []
    for i in range(40):
        line = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(200 if i % 2 else 60))
        at = rng.randrange(8)
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "x" + line[at + 1 :])]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id % 2 == 1 and r.text == "" for r in got) >= 39


def test_lines_crowded(spark):
    """Near copies built of phrases that many unrelated lines use: the recall holds at two sizes of the table."""
    rng = random.Random(12)
    phrases = [prose(rng, 6) for _ in range(40)]
    for size in (400, 2000):
        rows, pairs = [], 60
        for i in range(size):
            line = " ".join(rng.choice(phrases) for _ in range(8))
            rows.append((2 * i, line))
            if i < pairs:
                w = line.split()
                w[rng.randrange(len(w))] = "changed"
                rows.append((2 * i + 1, " ".join(w)))
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.doc_id % 2 == 1 and r.text == "" for r in got) >= 0.95 * pairs


def test_lines_of_one_form(spark):
    """Lines of one long form that are not alike, each with a near copy: all minima are crowded, and no copy stays."""
    rng = random.Random(17)
    form = prose(rng, 40)[:200]
    rows = []
    for i in range(150):
        tail = prose(rng, 12)[:48]
        at = rng.randrange(len(tail))
        rows += [(2 * i, form + tail), (2 * i + 1, form + tail[:at] + "X" + tail[at + 1 :])]
    keep = brute_lines([t for _, t in rows])
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(keep) == 150 and {r.doc_id for r in got if r.text} == {d for d, _ in keep}


def test_lines_of_one_form_grow_in_proportion(spark, monkeypatch):
    """Four times the lines of one form, none alike: what is compared grows with the lines, not with their square, and copies go."""
    rng = random.Random(19)
    form = prose(rng, 40)[:200]
    count = []
    written = lines.stage

    def counted(df, label="t"):
        out = written(df, label)
        if label in ("pairs", "last"):
            count[-1] += out.count()
        return out

    monkeypatch.setattr(lines, "stage", counted)
    for size in (150, 600):
        rows = []
        for i in range(size):
            tail = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(48))
            rows += [(2 * i, form + tail), (2 * i + 1, form + tail[:20] + "X" + tail[21:])]
        count.append(0)
        got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id for r in got if r.text} == {2 * i for i in range(size)}
    assert count[1] <= 6 * count[0]


def test_lines_firsts_lose_no_link(spark):
    """Lines of a crowd, each like the one before: all alike ones of different components meet, and their maps allow them."""
    rng = random.Random(29)
    held = []
    for length in (12, 60, 400):
        line = prose(rng, 200)[:length]
        for _ in range(50):
            at = rng.randrange(len(line) - 2)
            line = line[:at] + rng.choice("abcdefgh ") + line[at + rng.randrange(3) :]
            held.append(line)
    held = sorted(set(held) | {"=" * 9, "=" * 90})
    texts = spark.createDataFrame(list(enumerate(held)), "id long, line string")
    rest = spark.createDataFrame([(k, i, i - i % 3) for i in range(len(held)) for k in {i % 2, 7}], "key long, id long, root long")
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in held]
    want = {(a, b) for b in range(len(held)) for a in range(b) if a // 3 != b // 3 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    met = lines._met(lines._firsts(rest, texts, 0.8), 0.8)
    maps = lines.mapped(texts)
    assert len(want) > 100
    assert want <= {(r.a, r.b) for r in lines._near(met, maps, 0.8).collect()}


def test_lines_of_crowds_are_told_apart(spark, monkeypatch):
    """Unrelated short lines of one frequent phrase: few are shingled for the last step, and few work tables are held at once."""
    import pathlib

    rng = random.Random(31)
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    parts = [a + b for a in "bdfgklmnprstv" for b in ("a", "e", "i", "o")]
    rows, shingled, held = [], [], []
    for i in range(3000):
        line = "in the end " + " ".join("".join(rng.choices(parts, weights=range(1, 53), k=2)) for _ in range(12))
        rows += [(2 * i, line)] + [(2 * i + 1, line + "s")] * (i % 100 == 0)
    before = set(shared.iterdir())
    written = lines.stage

    def counted(df, label="t"):
        out = written(df, label)
        if label == "shingled":
            shingled.append(out.select("id").distinct().count())
        held.append(len(set(shared.iterdir()) - before))
        return out

    monkeypatch.setattr(lines, "stage", counted)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.text for r in got if r.doc_id % 2 == 0) and not any(r.text for r in got if r.doc_id % 2)
    assert sum(shingled) < 1000 and max(held) < 16


def test_keys_of_crowds_beyond_what_is_sent(spark, monkeypatch):
    """Keys sent in parts, or too many to be sent: the links of one part, no table of all rows of keys, and signatures gone before pairs are verified."""
    import pathlib

    rng = random.Random(37)
    words = [prose(rng, 1) for _ in range(60)]
    held = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(150)]
    held += [x[:40] + "x" + x[41:] for x in held[:50]] + [f"{held[0][:60]} {i:03d}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    written, seen, wide = lines.stage, [], []

    def told(df, label="t"):
        out = written(df, label)
        seen.append(label)
        if label == "signed" and "m0" in out.columns:
            wide[:] = out.inputFiles()
        if label == "links":
            assert not any(pathlib.Path(f.removeprefix("file://")).exists() for f in wide)
        return out

    monkeypatch.setattr(lines, "stage", told)
    found = []
    for sent, parts in ((500_000, 8), (20, 10_000), (20, 1)):
        monkeypatch.setattr(lines, "SENT", sent)
        monkeypatch.setattr(lines, "PARTS", parts, raising=False)
        seen.clear()
        found.append(sorted((r.a, r.b) for r in lines.links(docs).collect()))
        assert "rows" not in seen and (seen.count("crowds") > 3) == (parts == 10_000)
    assert len(found[0]) >= 50 and found[0] == found[1] == found[2]


def test_shuffles_go_with_their_step(spark):
    """What a written step has shuffled is deleted at once, and the setting for it is as before."""
    import time

    from loomframe.llm import storage

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(storage._SHUFFLED, None)
    out = storage.stage(spark.range(10000).repartition(3).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(storage._SHUFFLED, None) == setting
    assert out.count() == 1000
    storage.dropped(out)
    assert out.inputFiles() and not __import__("pathlib").Path(out.inputFiles()[0].removeprefix("file://")).exists()


def test_native_plans(odd):
    for df in (lines.dedup(odd), pii.mask(odd), quality.score(odd)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(d):
    return sum(x if not i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def spans_of(t):
    return [(k, m.start(), m.end()) for k, p, ok in KINDS for m in re.finditer(p, t or "") if ok(m[0])]


def test_pii_base(spark, odd, docs, none):
    rng = random.Random(3)
    letters = "ab1234567890123@@...+++-- ()é😀%_x\n"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "1" * 30_000, "a" * 30_000, "+1" + "(" * 30_000]
    mine = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for df in (mine, odd, docs):
        want = Counter((r.doc_id, tuple(spans_of(r.text))) for r in df.collect())
        assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in pii.find(df).collect()) == want
    assert pii.find(none).count() == 0


def test_pii_loose_and_mask(spark):
    rows = ["reach us: joe.doe [at] mail (dot) com today", "tel. (456) 555-2186 now", "version 1.2.3.4 of order 4041894974608796", "mail a.b@c.org and 10.0.0.7, +49 (151) 555-22860", "nothing here", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df).collect()}
    assert found[0] == [("email", 10, 37)] and found[4] == [] and found[5] == []
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[3] == "mail [EMAIL] and [IP], [PHONE]" and got[4] == rows[4] and got[5] is None


def test_pii_many_spans(spark):
    """A text of 100,000 addresses, found and masked in place; overlapping spans of several kinds; blocks of the mask."""
    many = " ".join(f"user{i}@mail{i % 97}.org" for i in range(100_000))
    rng = random.Random(5)
    rows = [many] + ["".join(rng.choice(["a@b.c ", "1.2.3.4", "+1 234 567 8901", "joe [at] x.com", "text é ", "4041894974608795", "x" * 700]) for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, -s.end, s.kind) for s in r.spans] for r in pii.find(df).collect()}
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert len(found[0]) == 100_000 and got[0] == " ".join(["[EMAIL]"] * 100_000)
    for i, t in enumerate(rows):
        at, out = 0, []
        for a, b, kind in sorted(found[i]):
            if a >= at:
                out.append(t[at:a] + f"[{kind.upper()}]")
            at = max(at, -b)
        assert i == 0 or got[i] == "".join(out) + t[at:]


def test_running_folds(spark):
    from loomframe.llm.textops import before, most, total

    rng = random.Random(1)
    rows = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 5, 16, 17, 300, 1000)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<int>")
    for r in df.select("x", before(F.col("x"), total).alias("t"), before(F.col("x"), most).alias("m")).collect():
        assert r.t == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max(r.x[:i], default=0) for i in range(len(r.x))]


# --- SimHash


def brute_fp(t):
    import xxhash

    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(fps):
    par = list(range(len(fps)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                par[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(len(fps))]


def test_fingerprints(odd, docs, none):
    for df in (odd, docs.limit(60)):
        rows = df.collect()
        got = Counter((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.groups(df).collect())
        assert got == Counter((r.doc_id, brute_fp(r.text)) for r in rows)
    assert simhash.groups(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_components(spark):
    rng = random.Random(6)
    fps = []
    for _ in range(15):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 40])):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    rows = [(i, simhash._signed(x)) for i, x in enumerate(fps)]
    for sent in (10**6, 0):
        f = spark.createDataFrame(rows, "doc_id long, fp long")
        roots = components.components(simhash.links(f.select("fp"), sent=sent))
        of = {r.id: r.root for r in roots.collect()}
        mine = [of.get(x, x) for _, x in rows]
        want = linked(fps)
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def gram_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        out.append(frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def edited(rng, words, k):
    w = list(words)
    for i in rng.sample(range(len(w)), k):
        w[i] = prose(rng, 1) + "x"
    return " ".join(w)


def keep_brute(rows):
    """The ids that stay, by comparing all pairs."""
    g, root = gram_sets([r[1] for r in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(g[i], g[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_keep_one(docs, odd, none):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = simhash.keep_one(docs)
    got, want = {r.doc_id for r in kept.collect()}, keep_brute(rows)
    assert kept.columns == docs.columns and got >= want and len(got - want) <= 2
    out = simhash.keep_one(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and ids.count(3) == 1 and 4 not in ids and 5 not in ids
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("step", [lines.dedup, simhash.keep_one])
def test_work_tables_go(spark, odd, step):
    """Of the tables that a step of the pipeline writes, only the one its result reads is left, and the result is whole."""
    import pathlib

    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = step(odd)
    assert len(set(shared.iterdir()) - before) == 1
    assert 0 < out.count() <= odd.count()


@pytest.mark.parametrize("sent", [10**6, 0])
def test_like_links_in_crowds(spark, sent):
    """A crowd of one set of words in ever other orders, each text like the one before, in two chains: no link across a crowd is lost."""
    rng = random.Random(23)
    texts = []
    for _ in range(2):
        w = prose(rng, 120).split() if not texts else rng.sample(w, len(w))
        for _ in range(60):
            at = rng.randrange(len(w) - 12)
            w = w[:at] + w[at + 6 : at + 12] + w[at : at + 6] + w[at + 12 :]
            texts.append(" ".join(w))
    g = gram_sets(texts)
    want = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(g[i], g[j])]
    rows = [(i * 7919 % 100_003, t) for i, t in enumerate([*texts, "", "  ", "\n"])]
    ids = {r[0]: i for i, r in enumerate(rows)}
    found = {(ids[r.a], ids[r.b]) for r in simhash.like_links(spark.createDataFrame(rows, "id long, t string"), sent=sent).collect()}
    roots = []
    for pairs in (want + [(120, 121), (121, 122)], found):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        roots.append(root)
    assert roots[0] == roots[1] and len(set(roots[0])) < 20


@pytest.mark.parametrize("sent", [10**6, 0])
def test_like_links(spark, sent):
    """Near copies with scattered edits, alone and in a crowd around one text; only true links, recall by brute force."""
    rng = random.Random(9)
    texts, near = [], []
    for n in (60, 150, 400):
        for _ in range(40):
            base = prose(rng, n).split()
            near.append((len(texts), len(texts) + 1))
            texts += [" ".join(base), edited(rng, base, rng.randint(1, n // 60))]
    hub = prose(rng, 200).split()
    first = len(texts)
    texts += [" ".join(hub), *[edited(rng, hub, rng.randint(1, 4)) for _ in range(300)]]
    g = gram_sets(texts)
    near = [p for p in near if alike(g[p[0]], g[p[1]])]
    rows = [(i * 7919 % 100_003, t) for i, t in enumerate(texts)]
    ids = {r[0]: i for i, r in enumerate(rows)}
    found = {tuple(sorted((ids[r.a], ids[r.b]))) for r in simhash.like_links(spark.createDataFrame(rows, "id long, t string"), sent=sent).collect()}
    assert all(alike(g[a], g[b]) for a, b in found)
    assert len(near) > 100 and sum(p in found for p in near) >= 0.93 * len(near)
    root = {i: i for i in range(len(texts))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[find(a)] = find(b)
    sizes = Counter(find(i) for i in range(first, len(texts)))
    assert max(sizes.values()) >= 0.95 * 301  # those with four edits are like the hub alone, at 0.82


# --- sharding


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_shards(request, which):
    df = request.getfixturevalue(which)
    got = sharding.assign(df).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_balance(spark):
    rng = random.Random(9)
    rows = [(i, "hot text " * 20) for i in range(3000)] + [(3000 + i, prose(rng, rng.randint(5, 60))) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert set(size) == set(range(8)) and max(size.values()) < 1.05 * min(size.values())
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1  # only the text larger than a shard


# --- toxicity


def test_toxicity(spark, docs, sf, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(big, labels)
    out = toxicity.add_score(big, model, keep=["doc_id"]).withColumn("held", toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").collect()
    tp = sum(r.score >= 0.5 and r.toxic == 1 for r in out)
    fp = sum(r.score >= 0.5 and r.toxic == 0 for r in out)
    assert tp >= 0.6 * sum(r.toxic for r in out) and fp <= 0.03 * len(out)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    scored = toxicity.add_score(odd, model, out="p2")
    assert scored.columns == [*odd.columns, "p2"] and scored.where("p2 between 0 and 1").count() == odd.count()
    assert len(model[0]) < 20_000
    nothing = toxicity.fit(none, labels.limit(0))
    assert toxicity.keep_clean(odd, labels.limit(0)).count() == odd.count() and nothing[2] < 0


# --- components, pipeline


def test_components(spark):
    rng = random.Random(12)
    for n, m in ((40, 30), (200, 260), (60, 59)):
        edges = [(i, i + 1) for i in range(m)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        par = list(range(n))

        def find(a):
            while par[a] != a:
                a = par[a]
            return a

        for a, b in edges:
            par[max(find(a), find(b))] = min(find(a), find(b))
        got = {r.id: r.root for r in components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
        assert got == {a: find(a) for e in edges if e[0] != e[1] for a in e}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]
    df = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, df, sf)
        assert after.columns == docs.columns, name
        assert after.count() <= df.count()
        df = after
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert out["doc_id"].nunique() == df.count() and (out.groupby("sequence_id")["length"].sum() <= 2048).all()
