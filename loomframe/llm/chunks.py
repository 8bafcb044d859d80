"""Byte-level BPE with content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so, so a passage that many documents hold is cut alike in
all of them. Chunks that occur twice or more in the table are encoded once. A document then takes over the ids of its
shared chunks and encodes only what lies between them; each join is repaired by encoding a window across it again, until a
boundary of the splitting pattern agrees with one that the chunk had when encoded alone. From such a boundary on the two
encodings are the same, since the pattern never looks behind. Where no boundary agrees, the chunk is encoded in place.

Chunk hashes are counted by a shuffle of hashes; a bit filter of fixed size, made of the shared ones, tells which texts
may hold one. Only those texts are shuffled (once, equal ones merged); the others are encoded where they are read. A
false hit of the filter costs a shuffle, never a wrong id; when the filter is full all texts take that way.

Splitting uses the tokenizer's own character classes, asked from it once a worker; merging is the tokenizer's own
model, whose ids of a word are remembered. Texts that hold the string of an added token go through the whole tokenizer.
"""

import functools
import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .storage import join_hot, stage

#: Characters of a chunk: at least, about (a power of two), at most.
LEAST, ABOUT, MOST = 64, 256, 2048
#: Characters of a window that reach into the next chunk.
REACH = 48
#: A boundary this near to the end of a piece may still depend on what follows it.
MARGIN = 4
#: Boundaries remembered at the head of a chunk.
HEADS = 8
#: Bits of the filter, as a power of two: 8 MB.
FILTER_BITS = 26
#: Words whose ids a worker remembers at once.
REMEMBERED = 400_000


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(codes):
    """The inside of a character class with these code points."""
    out, codes = [], np.asarray(codes)
    for run in np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1) if len(codes) else []:
        a, b = re.escape(chr(run[0])), re.escape(chr(run[-1]))
        out.append(a if len(run) == 1 else f"{a}-{b}")
    return "".join(out)


class ByteEncoder:
    """A byte-level BPE tokenizer file (no normalizer, one splitting pattern), word by word."""

    #: The parts of a file for which words are cut here; any other file goes through the whole tokenizer, without reuse.
    SHAPE = {"normalizer": None, "post_processor": None, "truncation": None, "padding": None}

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_word = all(told.get(k) == v for k, v in self.SHAPE.items()) and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True) and model["type"] == "BPE" and not model.get("dropout")
        added = [t["content"] for t in told.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda t: None
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        chars = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}}
        self.chars = str.maketrans({chr(b): c for b, c in chars.items()})
        back = {c: b for b, c in chars.items()}
        self.bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in self.whole.get_vocab().items()}
        self.decimal = {i: str(i) for i in self.bytes}
        self.packed = np.dtype("<u2" if max(self.bytes, default=0) < 1 << 16 else "<u4")
        self.known = {}
        if self.by_word:
            self.cut, self.odd = self._pattern(), re.compile("[^\x00-퟿-￿]").search

    def _pattern(self):
        """The splitting pattern with the character classes that the tokenizer itself has, up to U+FFFF."""
        codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
        cut = self.whole.pre_tokenizer.pre_tokenize_str
        alike = {}
        for kind in "a0!":  # each character after a letter, a digit and a sign: of the same kind if not cut off
            starts = np.zeros(3 * len(codes) + 1, bool)
            starts[[a for _, (a, _) in cut("".join(f"\n{kind}{chr(c)}" for c in codes))]] = True
            alike[kind] = ~starts[2 : 3 * len(codes) : 3]
        codes = np.array(codes)
        letters, digits = _ranges(codes[alike["a"]]), _ranges(codes[alike["0"]])
        spaces = _ranges(codes[~(alike["a"] | alike["0"] | alike["!"])])
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def split(self, text):
        """The pieces of ``text``, which holds no added token; together they are the text."""
        if self.odd(text):
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def _merge(self, word):
        ids = [t.id for t in self.whole.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def ids(self, words):
        out, known = [], self.known
        for w in words:
            out += known.get(w) or self._merge(w)
        return out

    def encode(self, text):
        """Ids of a whole text, as the tokenizer gives them."""
        if not self.by_word or self.special(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.ids(self.split(text))

    def decode(self, ids):
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def chunk(self, text):
        """(ids, [tail character, tail id, head character, head id, ...]): boundaries of a chunk encoded alone."""
        words, at, heads, tail = self.split(text), 0, [0, 0], (0, 0)
        ids = []
        for w in words:
            ids += self.known.get(w) or self._merge(w)
            at += len(w)
            if at <= len(text) - MARGIN:
                tail = (at, len(ids))
                if len(heads) < 2 * HEADS:
                    heads += tail
        return ids, [*tail, *heads]

    def assemble(self, text, shared):
        """Ids of ``text`` and how many of its characters came from ``shared``: (start, end, ids, marks) in order.

        ``p`` is always a boundary of the whole text up to which the ids are out. A window from there into the next
        shared chunk is encoded; at the first boundary that it has in common with the chunk alone, the chunk's ids
        take over, up to its last sure boundary.
        """
        out, p, reused = [], 0, 0
        for start, end, ids, marks in shared:
            if start < p:
                continue
            tail_at, tail_ids = marks[0], marks[1]
            found = (start, 0, 0) if p == start else None
            if not found:
                stop = min(end, start + REACH)
                heads = {start + marks[i]: marks[i + 1] for i in range(2, len(marks), 2)}
                words, at = self.split(text[p:stop]), p
                sure = stop if stop == len(text) else stop - MARGIN
                for n, w in enumerate(words):
                    at += len(w)
                    if at > sure:
                        break
                    if at in heads:
                        found = (at, heads[at], n + 1)
                        break
            if not found or found[0] - start >= tail_at:
                continue  # no agreement: the chunk is encoded with what follows
            if p < start or found[2]:
                out += self.ids(words[: found[2]])
            out += ids[found[1] : tail_ids]
            reused += start + tail_at - found[0]
            p = start + tail_at
        return (out + self.ids(self.split(text[p:]))) if p < len(text) else out, reused


@functools.lru_cache(maxsize=2)
def encoder(path):
    return ByteEncoder(path)


_POWERS = np.array([pow(0x9E3779B1, n, 2**32) for n in (1, 2, 4)], np.uint32)


def cuts(text):
    """Ends of the chunks of ``text``: where the hash of the last 8 characters has its bits zero, within the limits."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    for step, power in zip((1, 2, 4), _POWERS):
        earlier = h[:-step] * power
        h[step:] += earlier
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - ABOUT.bit_length() + 1)
    out, last = [], 0
    for c in (np.flatnonzero(h == 0) + 1).tolist():
        if c - last < LEAST:
            continue
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _chunks(text):
    """(start, end, 128-bit hash) of each chunk."""
    from xxhash import xxh3_128_digest

    start, raw = 0, text.encode()
    plain = len(raw) == len(text)  # ASCII: bytes are cut where characters are
    for end in cuts(text):
        yield start, end, xxh3_128_digest(raw[start:end] if plain else text[start:end].encode())
        start = end


def _may_share(path, bits):
    """A function from a text to its chunks that pass the filter; none where the text must go through the tokenizer whole."""
    enc = encoder(path)

    def of(text):
        if not enc.by_word or enc.special(text):
            return []
        return [x for x in _chunks(text) if bits[(b := int.from_bytes(x[2][:4], "little") >> (32 - FILTER_BITS)) >> 3] >> (b & 7) & 1]

    return of


def _texts(docs, key, text):
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2"), t.alias("text"))


def _marks(texts):
    """(k1, k2, starts, ends, hashes) of every text."""

    def run(batches):
        for b in batches:
            found = [list(_chunks(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int32())), pa.array([[x[1] for x in f] for f in found], pa.list_(pa.int32())), pa.array([[x[2] for x in f] for f in found], pa.list_(pa.binary()))],
                ["k1", "k2", "starts", "ends", "hashes"],
            )

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, starts array<int>, ends array<int>, hashes array<binary>")


def _filter(spark, shared):
    """The bit filter of the shared hashes, as a broadcast of at most 2 ** FILTER_BITS bits, gathered word by word."""
    b = F.shiftrightunsigned(F.conv(F.hex(F.concat(*[F.substring("h", i, 1) for i in (4, 3, 2, 1)])), 16, 10).cast("long"), 32 - FILTER_BITS)
    words = shared.select(F.shiftright(b, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(table.tobytes())


def _encoded(texts, shared, path, bits):
    """(h, n, ids, marks): every shared chunk, encoded once; ids and marks packed in two bytes each (ids in four if need be)."""

    def pick(batches):
        of = _may_share(path, bits.value)
        for b in batches:
            found = {}
            for t in b.column("text").to_pylist():
                for s, e, h in of(t):
                    found.setdefault(h, t[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], ["h", "chunk"])

    def encode(batches):
        enc = encoder(path)
        for b in batches:
            made = [enc.chunk(t) for t in b.column("chunk").to_pylist()]
            pack = lambda i, kind: pa.array([np.array(m[i], kind).tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("n"), pack(0, enc.packed), pack(1, "<u2")], ["h", "n", "ids", "marks"])

    once = texts.select("text").mapInArrow(pick, "h binary, chunk string").groupBy("h").agg(F.min("chunk").alias("chunk")).join(shared, "h")
    return once.select("h", "n", "chunk").mapInArrow(encode, "h binary, n long, ids binary, marks binary")


def _told(ids, enc, whole):
    if whole:
        return [ids, enc.decode(ids)]
    return [len(ids), hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()]


_WHOLE = (["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string")
_DIGEST = (["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs, key="doc_id", text="text", path=None, whole=True):
    """One row a row of ``docs``: key, ``ids`` and ``decoded`` (or, if not ``whole``, their number and SHA-256), ``reused``.

    ``reused`` counts the characters whose ids came from a shared chunk. A null text counts as empty (no ids); null keys
    and repeated rows are encoded like any other; other columns take no part; an empty table gives no rows. Equal texts
    are told by 128 bits of hash, as are chunks. Chunks of one text repeated in it count as shared, too.
    """
    path = path or default_tokenizer()
    spark = docs.sparkSession
    names, kinds, ddl = _WHOLE if whole else _DIGEST
    texts = _texts(docs, key, text)
    one = stage(_marks(texts).groupBy("k1", "k2").agg(F.first(F.struct("starts", "ends", "hashes")).alias("c"), F.count("*").alias("copies")).select("k1", "k2", "c.*", "copies"), "marks")
    each = one.select("k1", "k2", "copies", F.posexplode(F.arrays_zip("starts", "ends", "hashes")).alias("i", "c")).select("k1", "k2", "copies", F.col("c.starts").alias("start"), F.col("c.ends").alias("end"), F.col("c.hashes").alias("h"))
    shared = stage(each.groupBy("h").agg(F.sum("copies").alias("all"), F.count("*").alias("n")).where("all > 1").select("h", "n"), "shared")
    bits = _filter(spark, shared)
    done = stage(_encoded(texts, shared, path, bits), "chunks")
    lists = join_hot(each.select("k1", "k2", "start", "end", "h"), done, ["h"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "ids", "marks"))).alias("shared"))

    def alone(batches):
        enc, of = encoder(path), _may_share(path, bits.value)
        for b in batches:
            made = [None if of(t) else _told(enc.encode(t), enc, whole) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k1"), b.column("k2"), pa.array([m is None for m in made])] + [pa.array([m and m[i] for m in made], k) for i, k in enumerate(kinds)], ["key", "k1", "k2", "open", *names])

    def holds(batches):
        of = _may_share(path, bits.value)
        for b in batches:
            yield b.filter(pa.array([bool(of(t)) for t in b.column("text").to_pylist()], pa.bool_()))

    def join(batches):
        enc = encoder(path)
        for b in batches:
            made = []
            for t, s in zip(b.column("text").to_pylist(), b.column("shared").to_pylist()):
                ids, reused = enc.assemble(t, [(x["start"], x["end"], np.frombuffer(x["ids"], enc.packed).tolist(), np.frombuffer(x["marks"], "<u2").tolist()) for x in s or ()])
                made.append([*_told(ids, enc, whole), reused])
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2")] + [pa.array([m[i] for m in made], k) for i, k in enumerate([*kinds, pa.int64()])], ["k1", "k2", *names, "reused"])

    kind = dict(texts.dtypes)["key"]
    told = texts.mapInArrow(alone, f"key {kind}, k1 long, k2 long, open boolean, {ddl}")
    held = texts.select("k1", "k2", "text").mapInArrow(holds, "k1 long, k2 long, text string").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    joined = held.join(lists, ["k1", "k2"], "left").select("k1", "k2", "text", "shared").mapInArrow(join, f"k1 long, k2 long, {ddl}, reused long")
    told = stage(told, "alone")
    out = told.where("not open").select(F.col("key").alias(key), *names, F.lit(0).cast("long").alias("reused"))
    return out.unionByName(told.where("open").select("key", "k1", "k2").join(joined, ["k1", "k2"]).select(F.col("key").alias(key), *names, "reused"))


def op12_chunk_bpe(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=False)
