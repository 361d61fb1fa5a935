"""Sub-word hashing: FNV-1a of character n-grams, as Column expressions without overflow and as plain Python.

Spark has no unsigned 64-bit type, so a hash is kept as two 32-bit halves. Bytes from 0x80 up enter sign-extended in the default `byte` mode (what training
uses); `codepoint` mode hashes code points of character n-grams instead. Both agree on ASCII.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Offset basis and prime of 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
_LOW = 0xFFFFFFFF
_START_HIGH, _START_LOW = FNV_OFFSET >> 32, FNV_OFFSET & _LOW
_PRIME_LOW = FNV_PRIME - (1 << 40)


def fnv_bucket_py(data: bytes | str, buckets: int) -> int:
    """Bytes: sign-extended byte mode. Text: code points."""
    h = FNV_OFFSET
    for c in data:
        if isinstance(data, bytes):
            c = c | 0xFFFFFFFFFFFFFF00 if c >= 128 else c
        else:
            c = ord(c)
        h = ((h ^ c) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h % buckets


def ngram_buckets_py(word: str, minn: int, maxn: int, buckets: int, mode: str = "byte") -> list[int]:
    s = f"<{word}>"
    data = s.encode() if mode == "byte" else s
    return [fnv_bucket_py(data[i : i + n], buckets) for n in range(minn, maxn + 1) for i in range(len(data) - n + 1)]


def ngram_buckets_many(words: list[str], minn: int, maxn: int, buckets: int, mode: str = "byte") -> tuple[np.ndarray, np.ndarray]:
    """(start, buckets): `ngram_buckets_py` of all words, one after the other, word i having start[i]..start[i + 1] - 1. All n-grams of one length are hashed together, one character at a time."""
    if mode == "byte":
        data = [np.frombuffer(f"<{w}>".encode(), np.uint8).astype(np.int8).astype(np.int64).view(np.uint64) for w in words]  # sign-extended
    else:
        data = [np.frombuffer(f"<{w}>".encode("utf-32-le"), np.uint32).astype(np.uint64) for w in words]
    size = np.array([len(d) for d in data], np.int64)
    flat = np.concatenate(data) if data else np.zeros(0, np.uint64)
    offset = np.cumsum(size) - size
    per = np.stack([np.maximum(size - n + 1, 0) for n in range(minn, maxn + 1)]) if len(words) else np.zeros((maxn - minn + 1, 0), np.int64)
    start = np.concatenate([[0], np.cumsum(per.sum(axis=0))])
    out = np.zeros(int(start[-1]), np.int64)
    put = start[:-1].copy()
    for k, n in enumerate(range(minn, maxn + 1)):
        owner = np.repeat(np.arange(len(words)), per[k])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(per[k]) - per[k], per[k])
        h = np.full(len(owner), FNV_OFFSET, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ flat[offset[owner] + inner + i]) * np.uint64(FNV_PRIME)
        out[put[owner] + inner] = (h % np.uint64(buckets)).astype(np.int64)
        put += per[k]
    return start, out


def codes(text: Column, mode: str = "byte") -> Column:
    """The numbers that are hashed: bytes, or code points."""
    if mode == "codepoint":
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"))
    hexes = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.substring(hexes, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))


def fnv_bucket(numbers: Column, buckets: int, mode: str = "byte") -> Column:
    """FNV-1a over an array of bytes or code points, modulo `buckets`."""
    start = F.struct(F.lit(_START_HIGH).cast("bigint").alias("hi"), F.lit(_START_LOW).cast("bigint").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        signed = F.lit(mode == "byte") & (c >= 128)
        hi = F.when(signed, h["hi"].bitwiseXOR(F.lit(_LOW))).otherwise(h["hi"])
        x = h["lo"].bitwiseXOR(F.when(signed, c.bitwiseOR(F.lit(0xFFFFFF00))).otherwise(c))
        low = x * _PRIME_LOW
        return F.struct(
            (hi * _PRIME_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(_LOW)).alias("hi"),
            low.bitwiseAND(F.lit(_LOW)).alias("lo"),
        )

    return F.aggregate(numbers, start, step, lambda h: ((h["hi"] % buckets) * ((1 << 32) % buckets) + h["lo"]) % buckets)


def ngram_codes(word: Column, minn: int, maxn: int, mode: str = "byte") -> Column:
    """All n-grams of `<word>` as arrays of numbers, shorter ones first, repeats kept."""
    c = codes(F.concat(F.lit("<"), word, F.lit(">")), mode)
    size = F.size(c)
    spans = F.flatten(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in range(minn, maxn + 1)]), lambda n: n <= size),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(n.alias("n"), i.alias("i"))),
        )
    )
    return F.transform(spans, lambda s: F.slice(c, s["i"], s["n"]))


def ngram_buckets(word: Column, minn: int, maxn: int, buckets: int, mode: str = "byte") -> Column:
    """Bucket of every n-gram; repeats kept."""
    return F.transform(ngram_codes(word, minn, maxn, mode), lambda g: fnv_bucket(g, buckets, mode))


def ngram_texts(word: Column, minn: int, maxn: int) -> Column:
    """The n-grams as text, by characters."""
    s = F.concat(F.lit("<"), word, F.lit(">"))
    size = F.length(s)
    return F.flatten(
        F.transform(F.filter(F.array(*[F.lit(n) for n in range(minn, maxn + 1)]), lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(s, i, n)))
    )


def ngram_buckets_udf(minn: int, maxn: int, buckets: int, mode: str = "byte"):
    """The same as an Arrow function: faster where words are long or n-grams many."""

    @pandas_udf("array<bigint>")
    def run(words):
        return words.map(lambda w: ngram_buckets_py(w, minn, maxn, buckets, mode))

    return run


def portable_int(key: Column) -> Column:
    """A 32-bit integer from MD5 that other SQL engines compute alike; the source of every reproducible draw."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
