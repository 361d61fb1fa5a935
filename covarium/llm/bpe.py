"""Byte-level BPE encoding and decoding from a public tokenizer file, by the contiguous rank array.

A short word holds its parts as one array of ids and, beside it, the merge rank of each adjacent pair. The smallest rank is searched again and again; that
pair becomes one part, one boundary goes, and only the two neighbouring ranks are computed anew. Words longer than `SHORT` parts, where the repeated search
would be quadratic, go through a heap of the same ranks over a linked list, which merges the same pairs in the same order (lowest rank, leftmost first).

Texts are cut as the file's byte-level pre-tokenizer cuts them, after its special tokens are taken out. Encoding adds no special tokens and neither
truncates nor pads.

Defined results: null and empty texts give no ids and decode to the empty text; the ids of equal texts are equal; a text of one very long word costs
n log n; ids of a text never depend on its batch. Extra columns pass through unchanged;
an input column named `ids` or `decoded` is replaced where an operator adds one of that name.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import WordCache, append

SHORT = 128
NO_RANK = 1 << 60

#: The pattern by which byte-level pre-tokenizers cut a text; white space is Unicode's property of that name.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "".join(map(chr, WHITE))
def pattern(letter: str, digit: str, rest: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{rest}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


PATTERN = pattern(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]")
#: Below U+0240 all letters and numerals can be listed, and the plain pattern module is twice as fast.
LATIN = re.compile(pattern("[a-zA-ZªµºÀ-ÖØ-öø-ȿ]", "[0-9²³¹¼-¾]", f"[^{SPACE}a-zA-ZªµºÀ-ÖØ-öø-ȿ0-9²³¹¼-¾]"))
BEYOND_LATIN = re.compile(rb"[\xc9-\xf4]")
#: UTF-8 lead bytes of U+0540 and above: only texts with one of them can hold letters that the two libraries' Unicode versions see differently.
LATE = re.compile(rb"[\xd5-\xf4]")


#: Ranges of characters that the `regex` module takes for letters or digits and the tokenizers library, which has an older Unicode version, doesn't.
#: tests/llm compares the cuts of every code point with that library's, so a new version of either shows there.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
NEWER_CLASS = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in NEWER)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: Latin-1's visible characters stand for themselves, the rest are counted up from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Codec:
    """The tables of one tokenizer file."""

    def __init__(self, text: str, newer: str = NEWER_CLASS):
        spec = json.loads(text)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.size = size
        #: pair of ids (left * size + right) -> rank, and rank -> id of the merged part
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] * size + vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.pieces = regex.compile(PATTERN)
        late = pattern(rf"(?:(?![{newer}])\p{{L}})", rf"(?:(?![{newer}])\p{{N}})", rf"(?:[^{SPACE}\p{{L}}\p{{N}}]|[{newer}])")
        self.pieces_late = regex.compile(late)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word = WordCache(self.merge).__getitem__

    def merge(self, word: str) -> tuple[int, ...]:
        ids = [self.first[b] for b in word.encode()]
        if len(ids) < 2:
            return tuple(ids)
        if len(ids) > SHORT:
            return self.merge_long(ids)
        size, get, merged = self.size, self.rank.get, self.merged
        ranks = [get(a * size + b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], NO_RANK)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        size, get, merged, n = self.size, self.rank.get, self.merged, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (x := get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (x, h, ids[h], ids[i]))
        return tuple(x for x in ids if x >= 0)

    def cut_words(self, text: str) -> list[str]:
        raw = text.encode()
        if not BEYOND_LATIN.search(raw):
            return LATIN.findall(text)
        return (self.pieces_late if LATE.search(raw) else self.pieces).findall(text)

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(map(self.word, self.cut_words(text))))
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += chain.from_iterable(map(self.word, self.cut_words(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        out += chain.from_iterable(map(self.word, self.cut_words(text[at:])))
        return out

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(4)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _spec(path: str | None) -> str:
    """What the executors need: the file's text."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1])), kind))


def _encode(texts: list[bytes], spec) -> list:
    c = codec(spec.value)
    return [_lists([c.encode(t.decode()) for t in texts], pa.int32())]


def _decode(ids: list, spec) -> list:
    c = codec(spec.value)
    return [pa.array([c.decode(x or ()) for x in ids], pa.binary()).cast(pa.string())]


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the column `ids` (array of int). The file (1.5 MB whatever the corpus) is read on the driver and broadcast."""
    return append(df, [text_col], _encode, "ids array<int>", drop=drop, args=(df.sparkSession.sparkContext.broadcast(_spec(path)),))


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`df` with the column `decoded` (string)."""
    return append(df, [ids_col], _decode, "decoded string", args=(df.sparkSession.sparkContext.broadcast(_spec(path)),))


def _round_trip(texts: list[bytes], spec) -> list:
    ids, back = [], []
    c = codec(spec.value)
    for t in texts:
        x = np.array(c.encode(t.decode()), np.int32)
        ids.append(x)
        back.append(c.decode(x.tolist()))
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.binary()).cast(pa.string())]


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `ids` and `decoded`, which is decoded from these ids: one pass and one worker where both are wanted."""
    return append(df, [text_col], _round_trip, "ids array<int>, decoded string", drop=drop, args=(df.sparkSession.sparkContext.broadcast(_spec(path)),))


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"), drop=("text",))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
