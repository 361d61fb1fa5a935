"""Language identification by hierarchical discrimination.

A text is a vector of hashed byte bigrams and trigrams of its lower-cased letters. The first step tells families of languages apart (linear machines, one
against the rest); the second tells the languages of the chosen family apart with one-versus-one linear support vector machines, by votes, then by summed margins.
Families aren't given: languages whose mean vectors are most alike are put together (average linkage) until about the square root of their number is left.

Whole texts are counted and scored, and every language is learned. Only the fit uses a bounded sample: `SAMPLE` documents, the same number for each language, but at least
`LEAST` for each; those with the smallest hashes. Each lends its whole text and a short passage, so that short texts are learned too.

Defined results: a text that is null, empty or without any letter is `und` with score 0; equal texts get equal results; votes that tie go by summed margins,
then to the language that comes first by code point; with one learned language everything with a letter is that one; with none everything is `und`;
equal rows are learned from once; extra columns do not take part, and those named `lang_pred` or `score` are replaced.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import append, crc_fold, text_key

DIMS = 1 << 12
SAMPLE, LEAST = 2400, 12
PASSAGE = 80
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case and all bytes of other characters stay; the rest becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: bytes) -> np.ndarray:
    """Hashed bigram and trigram counts of a text already lower-cased."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIMS, np.float32)
    for at in range(0, len(b), 1 << 20):  # long texts by pieces that overlap by two bytes
        p = b[at : at + (1 << 20) + 2]
        two = p[:-1] << 8 | p[1:]
        three = two[:-1] << 8 | p[2:]
        own = slice(None) if at + (1 << 20) + 2 >= len(b) else slice(None, 1 << 20)
        for g, salt in ((two[own], 0x9E3779B1), (three[own], 0x85EBCA6B)):
            out += np.bincount((g * np.uint32(salt)) >> np.uint32(20), minlength=DIMS)
    return out


def vector(text: bytes) -> np.ndarray:
    x = np.sqrt(counts(text))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def machines(x: np.ndarray, y: np.ndarray, c: float = 30.0, steps: int = 120) -> np.ndarray:
    """Linear machines with squared hinge loss for each column of y (+1, -1 or 0 for rows that take no part), by accelerated gradients; the last row is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    used = np.abs(y)
    n = np.maximum(used.sum(axis=0), 1)
    pos, neg = np.maximum((y > 0).sum(axis=0), 1), np.maximum((y < 0).sum(axis=0), 1)
    share = np.where(y > 0, n / (2 * pos), n / (2 * neg)) * used / n * c
    lip = 2 * 2 * float(share.sum(axis=0).max()) + 1
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    v, t = w, 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v)) * share
        w2 = v - ((v - 2 * (x.T @ (gap * y)).astype(np.float32)) / lip).astype(np.float32)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = (w2 + np.float32((t - 1) / t2) * (w2 - w)), w2, t2
    return w


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages by average linkage of their mean vectors' cosines. Sums of similarities between groups are kept and updated at each merge."""
    n = len(means)
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    sums = (unit @ unit.T).astype(float)
    size = np.ones(n)
    groups: list[list[int]] = [[i] for i in range(n)]
    live = np.ones(n, bool)
    for _ in range(n - max(1, math.ceil(math.sqrt(n)))):
        mean = np.where(np.triu(np.outer(live, live), 1), sums / np.outer(size, size), -np.inf)
        a, b = divmod(int(np.argmax(mean)), n)
        groups[a] = sorted(groups[a] + groups[b])
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        size[a] += size[b]
        live[b] = False
    return [g for g, k in zip(groups, live, strict=True) if k]


class Hierarchy:
    def __init__(self, langs: list[str], groups: list[list[int]], top: np.ndarray, pairs: list[tuple[int, int]], low: np.ndarray):
        self.langs, self.groups, self.pairs = langs, groups, pairs
        self.weights = np.concatenate([top, low], axis=1)
        self.n_top = top.shape[1]

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not text:
            return UNKNOWN, 0.0
        s = text.decode()
        if not _LETTER.search(s):
            return UNKNOWN, 0.0
        x = vector(s.lower().encode())
        m = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(2 * (m[: self.n_top] - m[: self.n_top].max()))
        family = int(np.argmax(e))
        score = float(e[family] / e.sum())
        group = self.groups[family]
        if len(group) == 1:
            return self.langs[group[0]], score
        votes, margin, sure = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0), dict.fromkeys(group, 1.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                z = float(m[self.n_top + k])
                votes[a if z > 0 else b] += 1
                margin[a] += z
                margin[b] -= z
                p = 1 / (1 + math.exp(-4 * max(-20, min(20, z))))
                sure[a] = min(sure[a], p)
                sure[b] = min(sure[b], 1 - p)
        best = max(group, key=lambda g: (votes[g], margin[g], -g))
        return self.langs[best], score * sure[best]


def fit(x: np.ndarray, lang: list[str]) -> Hierarchy:
    langs = sorted(set(lang))
    if not langs:
        return Hierarchy([], [], np.zeros((DIMS + 1, 0), np.float32), [], np.zeros((DIMS + 1, 0), np.float32))
    of = np.array([langs.index(v) for v in lang])
    groups = families(np.stack([x[of == i].mean(axis=0) for i in range(len(langs))]))
    fam = np.zeros(len(langs), int)
    for k, g in enumerate(groups):
        fam[g] = k
    top = machines(x, np.where(fam[of][:, None] == np.arange(len(groups)), 1, -1).astype(np.float32))
    pairs, low = [], [np.zeros((DIMS + 1, 0), np.float32)]
    for g in groups:  # a family's machines see its own languages' rows only
        own = list(combinations(g, 2))
        if own:
            rows = np.flatnonzero(np.isin(of, g))
            low.append(machines(x[rows], np.stack([(of[rows] == a).astype(np.float32) - (of[rows] == b) for a, b in own], axis=1).astype(np.float32)))
            pairs += own
    return Hierarchy(langs, groups, top, pairs, np.concatenate(low, axis=1))


def _sparse(texts: list[bytes]) -> list[list]:
    """Whole text and a passage from its middle, as the places and values of what isn't zero, packed: the driver gets bytes, not objects."""
    out: list[list] = [[], [], [], []]
    for t in texts:
        t = t.decode().lower().encode()
        words = t.split()
        mid = len(words) // 2
        short = b" ".join(words[mid : mid + max(1, PASSAGE // 8)])
        for k, v in ((0, vector(t)), (2, vector(short))):
            at = np.flatnonzero(v)
            out[k].append(at.astype(np.int32).tobytes())
            out[k + 1].append(v[at].astype(np.float32).tobytes())
    return out


def training_rows(docs: DataFrame, fold: int = 2, folds: int = 4, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(doc_id, lang, text) of the bounded sample, without a window over a language: a language's rows below a threshold on their hashes, some more than wanted, are gathered and the smallest taken.

    What reaches the driver is one row for each language and some three numbers for each row of the sample.
    """
    spark = docs.sparkSession
    use = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(crc_fold("doc_id", folds) != fold)
    # which rows lend is decided by ids and texts, so equal rows count once, however often they come: in the sizes too, whose estimates leave a wide margin to the number wanted
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    hashed = use.select("doc_id", "lang", text_key().alias("th"), h.alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    each = max(least, sample // max(1, len(sizes)))
    unit = 1 << 62
    limits = [(r.lang, min(unit, unit * (2 * each + 64) // max(1, r.n))) for r in sizes]
    below = hashed.join(F.broadcast(spark.createDataFrame(limits, "lang string, below long")), "lang").filter("h < below")
    found: dict[str, set] = {}
    for r in below.select("lang", "h", "doc_id", "th").distinct().collect():
        found.setdefault(r.lang, set()).add((r.h, r.doc_id, r.th))
    few = [(i, lang, th) for lang, rows in found.items() for _, i, th in sorted(rows)[:each]]
    chosen = spark.createDataFrame(few, "doc_id long, lang string, th long")
    rows = docs.select("doc_id", "text", "lang", text_key().alias("th")).join(F.broadcast(chosen), ["doc_id", "lang", "th"])
    return rows.groupBy("doc_id", "lang", "th").agg(F.first("text").alias("text")).select("doc_id", "text", "lang")


def train(docs: DataFrame, fold: int = 2, folds: int = 4) -> Hierarchy:
    rows = append(training_rows(docs, fold, folds), ["text"], _sparse, "i1 binary, v1 binary, i2 binary, v2 binary", drop=("text",)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.i1)))
    x = np.zeros((2 * len(rows), DIMS), np.float32)
    for k, r in enumerate(rows):
        x[2 * k, np.frombuffer(r.i1, np.int32)] = np.frombuffer(r.v1, np.float32)
        x[2 * k + 1, np.frombuffer(r.i2, np.int32)] = np.frombuffer(r.v2, np.float32)
    keep = x.any(axis=1)
    return fit(x[keep], [v for v, k in zip([r.lang for r in rows for _ in range(2)], keep, strict=True) if k])


def _predict(texts: list[bytes], model) -> list[list]:
    return [list(c) for c in zip(*[model.value.predict(t) for t in texts], strict=True)]


def predict(df: DataFrame, model: Hierarchy, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with lang_pred and score. The model holds DIMS numbers for each family and pair of languages, whatever the corpus."""
    return append(df, [text_col], _predict, "lang_pred string, score double", drop=drop, args=(df.sparkSession.sparkContext.broadcast(model),))


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), train(docs), drop=("text",))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
