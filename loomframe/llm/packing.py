"""Mixture-controlled packing of token ids into fixed-length sequences by deficit round-robin.

Every source has a queue of its documents' tokens. In each round (a mixture window) every queue earns a quantum of
tokens, its target share of the window, and sends pieces while what it has earned covers them; what is left over is
carried as a deficit to the next window. A piece that ends at token e of its queue can be sent as soon as the quanta
earned reach e, that is in round ceil(e / quantum): so the round-robin needs no loop, only running sums, and the
deficits carry across windows and partitions by construction. Pieces in the order (round, source, position) form one
gapless token stream that is cut every 2048 ids; only the last sequence is short.

Running sums are taken in two levels (inside buckets, then over bucket totals), so no source and no window sequence is
ever gathered in one task.
"""

import functools
import json
import math
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .storage import stage

LENGTH = 2048
#: Sequences in a mixture window.
WINDOW = 32
END = 1
#: Words whose ids a worker remembers at once.
REMEMBERED = 250_000
#: Rows that a worker holds as Python objects at once.
SLICE = 256


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(kind):
    return "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind).replace("\\", "")


class WordEncoder:
    """Ids of a word-level BPE tokenizer file, word by word.

    The tokenizer lower-cases, cuts words at white space and by a fixed pattern, and merges inside a word only; so a
    word's ids do not depend on its neighbours and can be remembered. Words with characters up to U+024F are cut here
    and merged by the tokenizer's model; words with any other character go through the whole tokenizer. So does a whole
    text that holds the string of an added token (it gets that token's id), and every text if the file normalises, cuts
    or merges in another way than SHAPE says.
    """

    #: The part of a tokenizer file for which texts may be cut into words here (fixed values of its format).
    SHAPE = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None,
    }

    def __init__(self, path):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = all(told.get(k) == v for k, v in self.SHAPE.items()) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        added = [t["content"] for t in told.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda t: None
        letters, digits = _letters("L"), _letters("N")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\x09-\\x0d\\x20\\x85\\xa0{letters}{digits}]+").findall
        self.odd = re.compile("[^\x00-ɏ]").search
        self.words = re.compile(r"[^\x20\x09-\x0D]+").findall
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in plain]
        self.byte_chars = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        self.known, self.known_odd = {}, {}

    def _word(self, w):
        s = w if w.isascii() and w.isprintable() else "".join(self.byte_chars[b] for b in w.encode("utf-8", "surrogatepass"))
        out = self.known[w] = np.array([t.id for t in self.whole.model.tokenize(s)], "<u4").tobytes()
        return out

    def _odd_word(self, w):
        out = self.known_odd[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode(self, text):
        """Little-endian unsigned 32-bit ids of ``text``, as bytes."""
        if len(self.known) + len(self.known_odd) > REMEMBERED:
            self.known, self.known_odd = {}, {}
        if not self.by_word or self.special(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii() or not self.odd(text):
            return self._plain(text)
        get = self.known_odd.get
        return b"".join([(get(w) or self._odd_word(w)) if self.odd(w) else self._plain(w) for w in self.words(text)])

    def _plain(self, text):
        found = self.cut(text.lower())
        get = self.known.get
        try:
            return b"".join(map(self.known.__getitem__, found))
        except KeyError:
            return b"".join([get(w) or self._word(w) for w in found])


@functools.lru_cache(maxsize=2)
def _encoder(path):
    return WordEncoder(path)


def _sliced(batches):
    for b in batches:
        for at in range(0, len(b), SLICE):
            yield b.slice(at, SLICE)


def tokens(docs, key="doc_id", text="text", source="source", tokenizer=None):
    """One row a document: row id, key, source (null: an empty name), n ids and the ids, END last.

    Ids are held as unsigned 16-bit numbers where all fit, else as 32-bit (``wide``). A null text counts as empty
    and gives END alone. The table is written: row ids must not change between uses.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.select(key).schema[0].dataType.simpleString()
    held = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))

    def run(batches):
        enc = _encoder(path)
        for b in _sliced(batches):
            n, out, wide = [], [], []
            for t in b.column(3).to_pylist():
                ids = np.frombuffer(enc.encode(t or "") + END.to_bytes(4, "little"), "<u4")
                n.append(len(ids))
                wide.append(bool(ids.max() > 0xFFFF))
                out.append(ids.tobytes() if wide[-1] else ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(wide), pa.array(out, pa.binary())], ["rid", "key", "source", "n", "wide", "ids"])

    return stage(held.mapInArrow(run, f"rid long, key {kind}, source string, n long, wide boolean, ids binary"), "tokens")


def place(sizes, shares=None, length=LENGTH, window=WINDOW):
    """(rid, start, length, sequence_id, offset, window): where each piece of each queue entry goes.

    ``sizes`` has rid (unique), source and n >= 1. ``shares`` maps sources to target proportions (sources not named get
    their natural share of what remains); None asks for the natural proportions throughout, so that all queues end
    together. A queue that runs dry leaves its part of later windows to the others.
    """
    total = sizes.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if not total["rows"]:
        return sizes.select("rid", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "sequence_id", "offset", "window")])
    buckets = max(1, math.isqrt(total["rows"]))
    h = F.xxhash64(F.lit("queue"), F.col("rid"))
    queue = sizes.withColumn("h", h).withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(buckets), 31))
    sums = queue.groupBy("source", "bucket").agg(F.sum("n").alias("m"))
    by_source = sums.groupBy("source").agg(F.sum("m").alias("all"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("all") / F.lit(total["n"])
    if shares:
        named = sum(shares.values())
        free = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        given = F.try_element_at(free, F.col("source"))
        left = total["n"] - (by_source.where(F.col("source").isin(list(shares))).agg(F.sum("all")).first()[0] or 0)
        share = F.coalesce(given, F.col("all") / F.lit(max(left, 1)) * F.lit(max(0.01, 1.0 - named)))
    quanta = by_source.select("source", F.greatest(share * F.lit(float(length * window)), F.lit(1e-6)).alias("quantum"))
    starts = sums.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(quanta, "source").drop("m")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["source", "bucket"])
    packets = queue.select("rid", "source", "n", "quantum", (F.col("before") + F.col("within")).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(length).cast("long"))).alias("start"))
    packets = packets.withColumn("length", F.least(F.lit(length).cast("long"), F.col("n") - F.col("start")))
    packets = packets.withColumn("end", F.col("at") + F.col("start") + F.col("length")).withColumn("window", F.ceil(F.col("end") / F.col("quantum")))
    packets = stage(packets.select("rid", "source", "start", "length", "end", "window"), "packets")

    rounds = packets.groupBy("window").agg(F.sum("length").alias("m"))
    wide = max(1, math.isqrt(packets.agg(F.max("window")).first()[0]))
    rounds = rounds.withColumn("block", F.floor(F.col("window") / wide))
    blocks = rounds.groupBy("block").agg(F.sum("m").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = Window.partitionBy("block").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumn("m", F.coalesce(F.sum("m").over(upto), F.lit(0))).join(blocks, "block").select("window", (F.col("m") + F.col("base")).alias("base"))
    inside = Window.partitionBy("window").orderBy("source", "end", "rid").rowsBetween(Window.unboundedPreceding, -1)
    g = packets.withColumn("g", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(rounds, "window").withColumn("g", F.col("g") + F.col("base"))
    first = F.least(F.col("length"), length - F.col("g") % length)
    piece = lambda start, n, at: F.struct(start.alias("start"), n.alias("length"), F.floor(at / length).alias("sequence_id"), (at % length).alias("offset"))
    pieces = F.filter(F.array(piece(F.col("start"), first, F.col("g")), piece(F.col("start") + first, F.col("length") - first, F.col("g") + first)), lambda p: p["length"] > 0)
    return g.select("rid", "window", F.explode(pieces).alias("p")).select("rid", "p.*", "window")


def pack(docs, key="doc_id", text="text", source="source", shares=None, length=LENGTH, window=WINDOW, tokenizer=None, with_ids=True):
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window (and ids).

    Every id of every document lies in exactly one piece; sequences are gapless, and all but the last are full. Null
    and empty texts give one piece with END alone; null sources share one queue; null keys stay null; repeated rows
    are packed each. An empty table gives no pieces. Other columns take no part.
    """
    ids = tokens(docs, key, text, source, tokenizer)
    placed = place(ids.select("rid", "source", "n"), shares, length, window)
    lists = placed.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "window")).alias("pieces"))  # as many as the document is long / length, twice at most
    joined = ids.join(lists, "rid").select("key", "source", "n", "wide", "ids", "pieces")
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]

    def run(batches):
        _encoder.cache_clear()  # a worker that encoded before holds its words no longer
        for b in _sliced(batches):
            keys, sources, at, rows, cut = b.column(0), b.column(1), [], [], []
            for i, (n, wide, raw, pieces) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]))):
                x = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                for p in sorted(pieces, key=lambda p: p["start"]):
                    part = x[p["start"] : p["start"] + p["length"]]
                    at.append(i)
                    rows.append((p["start"], p["length"], zlib.crc32(part.tobytes()), n, p["sequence_id"], p["offset"], p["window"]))
                    if with_ids:
                        cut.append(part.astype(np.int32))
            take = pa.array(at, pa.int64())
            cols = [keys.take(take), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], sources.take(take)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.list_(pa.int32()))] * with_ids, ["key", *names, "source", *["ids"] * with_ids])

    out = joined.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names) + ", source string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", key)


def op3_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
