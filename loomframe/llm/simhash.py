"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most two bits, one half differs in at
most one, and then the halves agree once the right bit is deleted. So every distinct fingerprint is indexed under
2 x 32 variants (half, deleted bit, what remains); fingerprints that share a variant are verified, and verified links
are joined into components.

A variant that more than two fingerprints share (near copies cluster) is not paired out. Fingerprints found under such
a variant are indexed again, under themselves and their 64 neighbours one bit away. Two fingerprints differ in at most
two bits exactly if they share one of these, so linking the members of each to the smallest loses no component and
needs no pairs: a crowd costs 65 rows a fingerprint.

``keep_one`` asks for likeness instead: a Jaccard similarity of 0.8 or more of five-word shingles. One changed word breaks
five shingles, so fingerprints of shingles drift far apart; its fingerprints are of the sets of words instead, 192 bits in
six segments, and texts meet if one segment differs in at most one bit. Every meeting is verified by exact Jaccard.
A variant that many texts share is not paired out either: its texts meet some that stand for it, and what is then still
apart meets exactly where it can be alike, by the rarest of its shingles (see ``_firsts``).
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import storage
from .components import components
from .storage import cleared, fresh, join_hot, stage

#: A table of at most this many numbers is sent to all executors; a larger one is shuffled.
SENT = 500_000
#: Distinct fingerprints whose variants one task makes, about.
PER_TASK = 50_000
#: Segments of 32 bits in a fingerprint of words, and their columns. Two such fingerprints of like texts differ in at most
#: APART bits: the angle of a fifth of the words being others gives 28 of 192 on average, strangers have 75 and more.
SEGMENTS, APART = 6, 52
_S = [f"s{i}" for i in range(SEGMENTS)]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text, words=3):
    """The 64-bit SimHash of a text: bits set in over half of the XXH64 (seed 42) values of its word shingles."""
    import xxhash

    h = xxhash.xxh64_intdigest
    w = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not w:
        return 0
    if len(w) < words:
        values = [h(b" ".join(w), 42)]
    else:
        values = [h(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)))]
    total = np.zeros(64, dtype=np.int64)
    every = np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(every), 1 << 16):
        total += np.unpackbits(every[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values), bitorder="little").view("<u8")[0])


def add_fingerprint(docs, text="text", out="fp", words=3, keep=None):
    """``keep`` columns (all, unless named) plus ``out``, the fingerprint as a signed long. Null texts count as empty."""
    cols = list(keep if keep is not None else docs.columns)
    held = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text).alias(fresh("_text", cols)))

    def run(batches):
        for b in batches:
            t = b.column(len(cols)).to_pylist()
            fp = np.array([fingerprint(x, words) for x in t], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(fp)], [*cols, out])

    return held.mapInArrow(run, held.select(*[f"`{c}`" for c in cols]).schema.add(out, LongType()))


def links(fps, fp="fp", sent=SENT):
    """(a, b): links between distinct fingerprints, whose components are those of "differ in at most two bits"."""
    f = stage(fps.select(F.col(fp).alias("f")).where("f is not null").distinct(), "distinct")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), f.count() // PER_TASK + 1)
    f = f.repartition(parts, "f")  # spread again: each fingerprint becomes 64 rows
    low = 0xFFFFFFFF
    keys = [F.xxhash64(F.lit(32 * half + bit), F.col("f").bitwiseAND(F.lit(_signed((low << (32 * half)) & ~(1 << (32 * half + bit)))))) for half in (0, 1) for bit in range(32)]
    variants = f.select("f", F.explode(F.array(*keys)).alias("key"))
    shared = variants.groupBy("key").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = stage(shared, "shared")
    pairs = shared.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowds = shared.where("n > 2").select("key")
    crowds = F.broadcast(crowds) if crowds.count() <= sent else crowds
    crowded = variants.join(crowds, "key", "left_semi").select("f").distinct()
    near = F.array(F.col("f"), *[F.col("f").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    around = stage(crowded.select("f", F.explode(near).alias("z")), "around")
    least = around.groupBy("z").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.count("*").alias("n")).where("n > 1")
    more = around.join(least.where("n > 2").select("z", "a"), "z").where("f <> a").select("a", F.col("f").alias("b"))
    return pairs.union(least.where("n = 2").select("a", "b")).union(more).distinct()


def _signed(x):
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def groups(docs, key="doc_id", text="text", words=3):
    """One row a row of ``docs``: key, ``fp`` (signed long), ``component_id`` (smallest key in the component).

    Null and empty texts have fingerprint 0 and link like any other. A null key takes part in linking but never names
    a component (a component whose keys are all null has a null id). Repeated rows stay. Other columns take no part.
    """
    return _grouped(stage(add_fingerprint(docs, text, "fp", words, [key]), "fp"), key)


def _grouped(fps, key):
    by_fp = stage(fps.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "by_fp")
    roots = components(links(by_fp)).withColumnRenamed("id", "fp")
    least = roots.join(by_fp, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = by_fp.join(roots.join(least, "root").select("fp", "least"), "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    return join_hot(fps, stage(named, "named"), "fp").select(key, "fp", "component_id")


def word_segments(text):
    """SEGMENTS numbers of 32 bits: the SimHash of the set of words (A-Z lower-cased), each word with equal weight."""
    import xxhash

    w = set(_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower()))
    if not w:
        return np.zeros(SEGMENTS, dtype=np.int64)
    every = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) + xxhash.xxh64_digest(x) for x in w), dtype=np.uint8).reshape(len(w), -1)
    total = np.zeros(32 * SEGMENTS, dtype=np.int64)
    for at in range(0, len(every), 1 << 16):
        total += np.unpackbits(every[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(w), bitorder="little").view("<u4").astype(np.int64)


def shingles(text, words=5):
    """The set of 64-bit hashes of a text's word shingles; fewer words than that are one shingle, none are none."""
    import xxhash

    w = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    runs = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w] if w else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(r)) for r in runs], dtype=np.uint64)).view(np.int64)


def _segments(texts):
    """(id, s0 ..): the segments of each text of (id, t)."""

    def run(batches):
        for b in batches:
            made = np.array([word_segments(x) for x in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, SEGMENTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(made[:, i]) for i in range(SEGMENTS)]], ["id", *_S])

    return texts.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in _S))


def _shingled(texts, words):
    """(id, grams): the set of shingles of each text of (id, t)."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                made = [shingles(x, words) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "grams"])

    return texts.mapInArrow(run, "id long, grams array<long>")


def like_links(texts, words=5, like=0.8, sent=SENT):
    """(a, b), a < b: verified links between texts of (id, t), each id once: Jaccard of word shingles is ``like`` or more.

    Two texts of a variant are compared. Those of a crowded variant are each compared with two that stand for it, chosen by
    a hash, so that a group of near copies has few of them. If that leaves the texts of a variant in several components, all
    of them that can be alike across components are compared, so no two alike texts that share a crowded variant stay apart.
    Texts without words are alike. No pair is reported that was not verified; which texts share a variant is a matter of
    chance (see the README for measured recall).
    """
    fps = stage(_segments(texts), "segments")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count() * SEGMENTS // 2 // PER_TASK + 1)
    keys = [F.xxhash64(F.lit(32 * i + bit), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))) for i, c in enumerate(_S) for bit in range(32)]
    variants = fps.repartition(parts, "id").select("id", F.explode(F.array(*keys)).alias("key"))
    shared = variants.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    shared = stage(shared, "shared")
    crowds = shared.where("n > 2").select("key")
    small = crowds.count() <= sent
    held = stage(variants.join(F.broadcast(crowds) if small else crowds, "key", "left_semi"), "held")
    pairs = shared.where("n = 2").select("a", "b").union(_stand_ins(held, small)).distinct()
    side = lambda c: fps.select(F.col("id").alias(c), *[F.col(s).alias(f"{s}{c}") for s in _S])
    apart = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in _S), F.lit(0))
    near = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= APART).select("a", "b"), "pairs")
    # later pairs are of texts of crowds, which are all asked for here
    asked = near.select(F.explode(F.array("a", "b")).alias("id")).union(held.select("id")).distinct()
    grams = stage(_shingled(texts.join(asked, "id", "left_semi").select("id", "t"), words), "grams")
    found = stage(_alike(near, grams, like), "links")
    first = _firsts(held, grams, components(found), like)
    found = found.union(stage(_alike(stage(_met(first, _chosen(first), like), "pairs"), grams, like), "links"))
    first = stage(_rooted(first.drop("root"), components(found)), "first")
    return found.union(_alike(stage(_met(first, first, like), "pairs"), grams, like)).distinct()


def _alike(pairs, grams, like):
    """The pairs (a, b) whose sets in ``grams`` have a Jaccard similarity of ``like`` or more; empty sets are alike."""
    of = lambda c: grams.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shares = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("i"), (F.size("ga") + F.size("gb")).alias("n"))
    return shares.where((F.col("n") == 0) | (F.col("i") >= like * (F.col("n") - F.col("i")))).select("a", "b")


def _rooted(rows, roots):
    """``rows`` with the root of the component of ``id``: itself, where it has no link."""
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _firsts(held, grams, roots, like):
    """(gram, id, root, size, left): the shingles by which texts of variants that hold several components are paired.

    All shingles are put in one order: those that occur in one component only, then rare ones, then frequent ones. Of the
    shingles that two sets share, the first lies so far to the front of both that those behind it suffice for likeness:
    sets of m and n shingles must share (m + n) * like / (1 + like). Only sets that share a shingle in such places are paired,
    and a set of n has at most n - like * n + 1 of them. Empty sets share the shingle 0.
    """
    held = _rooted(held, roots)
    parted = held.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    rest = stage(held.join(parted, "key", "left_semi").select("id", "root").distinct(), "rest")
    none = F.array(F.lit(0).cast("long"))
    some = F.size("grams") > 0
    sets = grams.join(rest, "id").select("id", "root", F.when(some, F.size("grams")).otherwise(1).alias("size"), F.when(some, F.col("grams")).otherwise(none).alias("grams"))
    rows = stage(sets.select("id", "root", "size", F.explode("grams").alias("gram")), "shingled")
    seen = rows.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most")
    several = join_hot(rows, stage(seen.select("gram", "n"), "several"), "gram")
    # left: how many shingles of the set do not come before this one
    ordered = several.groupBy("id", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g")).withColumn("several", F.size("g"))
    first = ordered.select("id", "root", "size", "several", F.posexplode("g").alias("at", "g")).withColumn("left", F.col("several") - F.col("at"))
    return stage(first.where(F.col("left") >= F.col("size") * like - 1e-6).select("g.gram", "id", "root", "size", "left"), "first")


def _chosen(first):
    """Two rows of each gram, chosen by a hash, others for each gram."""
    row = F.struct(F.xxhash64("gram", "id").alias("h"), "id", "root", "size", "left")
    two = first.groupBy("gram").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    return two.select("gram", F.explode(F.array("a", "b")).alias("r")).select("gram", "r.id", "r.root", "r.size", "r.left")


def _met(rows, others, like):
    """(a, b), a < b: the ids of ``rows`` and ``others`` of one gram and two components that its place in both sets lets be alike."""
    x, y = (t.select("gram", *[F.col(c).alias(f"{c}{e}") for c in ("id", "root", "size", "left")]) for t, e in ((rows, "x"), (others, "y")))
    enough = F.least("leftx", "lefty") >= (F.col("sizex") + F.col("sizey")) * (like / (1 + like)) - 1e-6
    met = x.join(y, "gram").where("rootx <> rooty").where(enough)
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def _stand_ins(rows, small):
    """(a, b), a < b: each row (key, id) with two of the ids of its key, chosen by a hash."""
    least = [F.min(F.struct(F.xxhash64(F.col("id"), F.lit(i)).alias("h"), F.col("id").alias("id"))).alias(f"r{i}") for i in range(2)]
    reps = rows.groupBy("key").agg(*least).select("key", F.array_distinct(F.array("r0.id", "r1.id")).alias("r"))
    met = rows.join(F.broadcast(reps) if small else reps, "key").select("id", F.explode("r").alias("x")).where("id <> x")
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))


def keep_one(docs, key="doc_id", text="text", words=5, like=0.8):
    """The rows of ``docs``, all columns, with one row of each group of near copies: the one with the smallest key.

    Groups are the components of links between texts whose word shingles have a Jaccard similarity of ``like`` or more.
    Null and empty texts and texts without words are copies of one another. Rows of a group that share the smallest key
    (or whose keys are all null) are told apart by their text's hash; rows equal in key and text are repeats of which one
    stays. An empty table gives an empty one; other columns, of any name, are kept as they are.
    """
    cols = docs.columns
    k, h, own, n = (fresh(c, cols) for c in ("_k", "_h", "_own", "_n"))
    said = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"))
    with cleared(docs.sparkSession):
        by_row = docs.select(F.xxhash64(said).alias("id"), row.alias("p")).groupBy("id", "p").agg(F.count("*").alias("n"))
        by_text = stage(by_row.groupBy("id").agg(F.min(F.struct("p", "n")).alias("r")).select("id", "r.p", "r.n"), "by_text")
        texts = docs.select(F.xxhash64(said).alias("id"), said.alias("t"), row.alias("p"))
        texts = texts.join(by_text, ["id", "p"], "left_semi").select("id", "t").dropDuplicates(["id"])
        roots = components(like_links(stage(texts, "texts"), words, like))
        group = by_text.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("g")).agg(F.min(F.struct("p.none", "p.k", "id", "n")).alias("p"))
        keep = group.select(F.col("p.k").alias(k), F.col("p.id").alias(h), F.col("p.n").alias(n))
        out = docs.withColumn(own, F.xxhash64(said))
        kept = storage.kept(out.join(keep, out[key].eqNullSafe(keep[k]) & (out[own] == keep[h])).select(*[out[f"`{c}`"] for c in cols], n), "kept")
    return kept.where(F.col(n) == 1).drop(n).union(kept.where(F.col(n) > 1).drop(n).dropDuplicates([key]))


def op8_simhash(spark, sf_dir):
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
