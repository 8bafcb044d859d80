"""Byte-level BPE encoding and decoding with tiktoken.

The rank file's path is a parameter; the file must be on every node (it is installed with the tokenizers package), and
each Python worker builds the encoding once. A long text is cut before encoding, but only where no match of the
splitting pattern can span the cut, so the ids are those of the whole text.
"""

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

#: Texts above this many characters are encoded in parts of about this many.
PART = 20_000


def _pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(path, pattern):
    """The encoding of a local rank file (base64 token, rank per line), without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Anything but white space, followed by a blank: no match runs from the one into the other, and nothing in the pattern
#: looks behind, so the text may be cut between them, in any script. In scripts without blanks, a full-width mark followed
#: by an ideograph, kana or hangul: a match of marks ends where letters begin, and none of these marks opens a contraction.
_SAFE = re.compile("\\S(?=[ \n\t])|[。、，！？；：](?=[一-鿿ぁ-ゖァ-ヺ가-힣])")


def parts(text, size=PART):
    """``text`` in pieces of about ``size`` characters, cut at safe places only; where there is none a piece is longer."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(text, enc):
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    return [i for p in parts(text) for i in enc.encode_ordinary(p)]


def add_token_ids(docs, text="text", out="ids", ranks=None, pattern=None):
    """``docs`` plus ``out``: array<int> of token ids of the whole text; a null text counts as empty (no ids)."""
    ranks, pattern = ranks or default_ranks(), pattern or _pattern()

    @F.udf("array<int>", useArrow=True)
    def ids(t):
        return encode(t or "", encoding(ranks, pattern))

    return docs.withColumn(out, ids(F.col(text)))


def add_decoded(df, ids="ids", out="decoded", ranks=None, pattern=None):
    """``df`` plus ``out``: the raw bytes (binary) of an id array; null ids decode to null, no ids to no bytes."""
    ranks, pattern = ranks or default_ranks(), pattern or _pattern()

    @F.udf("binary", useArrow=True)
    def raw(x):
        return None if x is None else encoding(ranks, pattern).decode_bytes(list(x))

    return df.withColumn(out, raw(F.col(ids)))


def round_trip(docs, key="doc_id", text="text", ranks=None, pattern=None):
    """Per row of ``docs``: key, number of ids, SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes.

    Null texts count as empty; repeated rows are encoded each; other columns take no part. The ids stay inside the
    task, so what leaves Python is a few bytes a document.
    """
    ranks, pattern = ranks or default_ranks(), pattern or _pattern()

    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = encode(t or "", enc)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
