"""Removal of passages that repeat across documents, by level-wise doubling of window lengths.

A passage is a window of `WINDOW` consecutive words. Lengths double from a short base to that: 13, 25, 50. At every length a full window is stood for by one
of the shorter windows inside it, that with the smallest hash (its anchor), which is the same one wherever the full window occurs. Level by level:

* base length: anchors of all texts. A full window whose anchor occurs in one document alone can't repeat, so it ends there.
* twice that length: only the windows that are left are extended, that is get an anchor of twice the length; again those whose anchor occurs in one document alone end.
* and so on until nothing survives or half of the full length is reached. All neighbouring windows with one anchor then form a cell. A cell that occurs as a whole in an earlier
  document is settled by one row; where cells differ around a shared anchor, they are opened into their full windows, which are compared one by one.

`longest_repeats` goes on in the same way beyond the full length, from the windows that repeated at the length before, until no candidate survives.

So one short anchor for some 20 words is all that is gathered for the whole corpus; longer ones only where shorter ones repeat, and single windows only around the ends of
repeated passages. Level tables hold one row for each text, counts of anchors are combined before the shuffle.

Window hashes are polynomials modulo 2**64 over XXH64 values of the words; a window's identity is two of them with independent bases (128 bits), and so is
a cell's (its anchor and its words), so that no two of 10**15 are expected to clash. Texts are never cut into blocks: every position is looked at.

A row is known by its id and a hash of its text, never by its id alone, so rows that share an id are judged each by its own words.

Defined results: null and empty texts have no words; a text shorter than the window keeps all; of equal windows those in the document with the smallest id stay (a
window repeated only inside one document, or in several rows with one id, stays); a row with a null id comes after all others: it loses what any document with
an id has, and takes nothing from anyone, another null id included; equal rows are judged alike; empty tables give empty results; extra columns
of the input pass through `remove`, and those named n_words, n_removed or kept are replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import added, append, id_key, text_key
from covarium.session import materialize, release

WINDOW = 50
#: The base length is the half (of a half ...) of the window that is at most this long.
BASE = 16

#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps; longer texts compute theirs anew.
KEEP_POWERS = 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of `base` and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = KEEP_POWERS if n <= KEEP_POWERS else n
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                both.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]))
        have = both[0], both[1]
        if size <= KEEP_POWERS:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of any windows of one text, in constant time each."""

    def __init__(self, h: np.ndarray, base: int):
        p, self.back = powers(base, len(h) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)])])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[hi] - self.sums[lo]) * self.back[lo]
            return _mixed(x)

    def all(self, size: int) -> np.ndarray:
        """Hashes of all windows of `size` words."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            x = self.sums[size:] - self.sums[:n]
            x *= self.back[:n]
            return _mixed(x)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(a: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` neighbours, in passes that double the reach: memory is that of two copies of `a`, whatever the span."""
    reach = 1
    while 2 * reach <= span:
        a = np.minimum(a[:-reach], a[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def lengths(window: int) -> list[int]:
    """The lengths below `window` that are gone through, ascending: each is half of the next, rounded up."""
    out = [-(-window // 2)]
    while out[0] > BASE:
        out.insert(0, -(-out[0] // 2))
    return out


def runs(h: np.ndarray, window: int, size: int, lo: list[int] | None, hi: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi): the maximal runs of neighbouring starts of full windows with one anchor of `size` words, among the starts lo[i]..hi[i] (None: all)."""
    pick = sliding_min(Rolling(h, BASES[0]).all(size), window - size + 1)
    cut = np.empty(len(pick), bool)
    cut[0] = True
    np.not_equal(pick[1:], pick[:-1], out=cut[1:])
    if lo is None:
        first = np.flatnonzero(cut)
        return pick[first], first, np.append(first[1:], len(pick)) - 1
    live = np.zeros(len(pick) + 1, np.int32)
    np.add.at(live, lo, 1)
    np.add.at(live, np.asarray(hi) + 1, -1)
    live = np.cumsum(live[:-1]) > 0
    cut[1:] |= live[1:] != live[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(pick)) - 1
    use = live[first]
    return pick[first[use]], first[use], last[use]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _anchor_rows(texts: list[bytes], window: int, size: int) -> list[list]:
    none = [None] * len(texts)
    return _extended_rows(texts, none, none, window, size)


def _extended_rows(texts: list[bytes], lows: list, highs: list, window: int, size: int) -> list[list]:
    out: list[list] = [[], [], []]
    for t, lo, hi in zip(texts, lows, highs, strict=True):
        words = t.split()
        if len(words) < window or (lo is not None and not lo):
            got = np.zeros(0, np.uint64), [], []
        else:
            got = runs(word_hashes(words), window, size, lo, hi)
        for c, v in zip(out, (_signed(got[0]), got[1], got[2]), strict=True):
            c.append(v)
    return out


def _cell_rows(texts: list[bytes], lows: list, highs: list, window: int, size: int) -> list[list]:
    """As `_extended_rows`, with the hash of all the words of each run, by the other base than the anchor's."""
    out: list[list] = [[], [], [], []]
    for t, lo, hi in zip(texts, lows, highs, strict=True):
        words = t.split()
        if len(words) < window or (lo is not None and not lo):
            for c in out:
                c.append([])
            continue
        h = word_hashes(words)
        a, lo, hi = runs(h, window, size, lo, hi)
        for c, v in zip(out, (_signed(a), _signed(Rolling(h, BASES[1]).of(lo, hi + window)), lo, hi), strict=True):
            c.append(v)
    return out


def _all_cells(texts: list[bytes], window: int, size: int) -> list[list]:
    none = [None] * len(texts)
    return _cell_rows(texts, none, none, window, size)


def _window_rows(texts: list[bytes], lows: list[list[int]], highs: list[list[int]], window: int) -> list[list]:
    out: list[list] = [[], [], []]
    for t, lo, hi in zip(texts, lows, highs, strict=True):
        h = word_hashes(t.split())
        at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
        for c, v in zip(out, (_signed(Rolling(h, BASES[0]).of(at, at + window)), _signed(Rolling(h, BASES[1]).of(at, at + window)), at), strict=True):
            c.append(v)
    return out


ROW = ["kid", "th"]


def keyed(docs: DataFrame) -> DataFrame:
    """(kid, th, text) of the rows that can have windows."""
    return docs.filter(F.col("text").isNotNull()).select(id_key().alias("kid"), text_key().alias("th"), "text")


def _runs_of(rows: DataFrame) -> DataFrame:
    """(kid, th, lo[], hi[]): the runs (kid, th, lo, hi) of each row, as arrays that are no longer than its text."""
    pairs = rows.groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("p"))
    return pairs.select(*ROW, F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))


def survivors(level: DataFrame) -> DataFrame:
    """(kid, th, lo[], hi[]): of one level's rows (kid, th, anchor[], lo[], hi[]) the runs whose anchor occurs in documents with different ids."""
    flat = level.select(*ROW, F.inline(F.arrays_zip("anchor", "lo", "hi")))
    again = flat.groupBy("anchor").agg(F.min("kid").alias("first"), F.max("kid").alias("last")).filter("first < last").select("anchor")
    return _runs_of(flat.join(again, "anchor", "left_semi"))


def windows(docs: DataFrame, window: int = WINDOW, live: DataFrame | None = None, early: bool = True) -> DataFrame:
    """(kid, th, lo, hi, first, late): runs of starts of full windows that occur in documents with different ids; `late` where a smaller id (`first` or less) has them as well.

    `live` (kid, th, lo[], hi[]) restricts the search to these starts: the survivors of the length before. Without `early`, only windows that a smaller id has are wanted.
    """
    rows = keyed(docs)
    sizes = lengths(window)
    for size in sizes[:-1]:
        if live is None:
            level = append(rows, ["text"], _anchor_rows, "anchor array<long>, lo array<int>, hi array<int>", drop=("text",), args=(window, size))
        else:
            level = append(rows.join(live, ROW), ["text", "lo", "hi"], _extended_rows, "anchor array<long>, lo array<int>, hi array<int>", drop=("text",), args=(window, size))
        level = materialize(level, "level")
        live = materialize(survivors(level), "live")
        release(level)
    kind = "anchor array<long>, cell array<long>, lo array<int>, hi array<int>"
    if live is None:
        lists = append(rows, ["text"], _all_cells, kind, drop=("text",), args=(window, sizes[-1]))
    else:
        lists = append(rows.join(live, ROW), ["text", "lo", "hi"], _cell_rows, kind, drop=("text",), args=(window, sizes[-1]))
    found = materialize(lists.select(*ROW, F.inline(F.arrays_zip("anchor", "cell", "lo", "hi"))), "cells")
    kinds = found.groupBy("anchor", "cell").agg(F.min("kid").alias("first"), F.max("kid").alias("last"))
    # anchors of one document alone end here; the others' cells are either alike everywhere or differ
    level = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_kinds"), F.min("first").alias("a"), F.max("last").alias("b")).filter("a < b").select("anchor", "n_kinds")
    both = found.join(kinds.join(level, "anchor"), ["anchor", "cell"])
    decided = materialize(both.filter("kid > first OR n_kinds > 1" + (" OR first < last" if early else "")).select(*ROW, "lo", "hi", "first", F.when(F.col("kid") > F.col("first"), "late").when(F.col("n_kinds") > 1, "open").otherwise("early").alias("state")), "decided")
    release(found)
    whole = decided.filter("state <> 'open'").select(*ROW, "lo", "hi", "first", (F.col("state") == "late").alias("late"))
    again = rows.join(_runs_of(decided.filter("state = 'open'")), ROW)
    lists = append(again, ["text", "lo", "hi"], _window_rows, "w1 array<long>, w2 array<long>, at array<int>", drop=("text", "lo", "hi"), args=(window,))
    opened = materialize(lists.select(*ROW, F.inline(F.arrays_zip("w1", "w2", "at"))), "windows")
    firsts = opened.groupBy("w1", "w2").agg(F.min("kid").alias("first"), F.max("kid").alias("last")).filter("first < last").select("w1", "w2", "first")
    single = opened.join(firsts, ["w1", "w2"]).select(*ROW, F.col("at").alias("lo"), F.col("at").alias("hi"), "first", (F.col("kid") > F.col("first")).alias("late"))
    return whole.unionByName(single)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kid, th, spans): for each row with windows to be removed the runs of starts [lo, hi] of windows that also start in a document with a smaller id."""
    return windows(docs, window, early=False).filter("late").groupBy(*ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] + window for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(texts: list[bytes], spans: list, window: int) -> list[list]:
    n_words, n_removed, kept = [], [], []
    for t, s in zip(texts, spans, strict=True):
        words = t.split()
        n_words.append(len(words))
        if s:
            gone = covered(len(words), s, window)
            n_removed.append(int(gone.sum()))
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        else:
            n_removed.append(0)
        kept.append(b" ".join(words).decode())
    return [n_words, n_removed, kept]


def _judged(docs: DataFrame, window: int) -> DataFrame:
    """Columns of `docs` by position (_d0, _d1, ...), then n_words, n_removed and kept."""
    spans = repeats(docs.select("doc_id", "text"), window).withColumnsRenamed({"kid": "_kid", "th": "_th", "spans": "_spans"})
    at = {n: f"_d{i}" for i, n in enumerate(docs.columns)}
    rows = docs.toDF(*at.values()).withColumns({"_kid": id_key(at["doc_id"]), "_th": text_key(at["text"])})
    both = rows.join(spans, ["_kid", "_th"], "left").drop("_kid", "_th")
    return append(both, [at["text"], "_spans"], _removed, "n_words long, n_removed long, kept string", drop=("_spans",), args=(window,))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_removed and kept (the words that stay, joined by one space)."""
    new = ["n_words", "n_removed", "kept"]
    stay = added(docs.columns, new)
    return _judged(docs, window).select(*[f"_d{i}" for i in stay], *new).toDF(*[docs.columns[i] for i in stay], *new)


def clean_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the repeated passages: texts that lose words become their kept words joined by one space, others stay as they are; n_chars follows. Documents that lose all their words go."""
    names = docs.columns
    lost = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    cols = [F.when(lost, new[n]).otherwise(F.col(f"_d{i}")) if n in new else F.col(f"_d{i}") for i, n in enumerate(names)]
    return _judged(docs, window).filter(~lost | (F.col("n_removed") < F.col("n_words"))).select(*[c.alias(f"_e{i}") for i, c in enumerate(cols)]).toDF(*names)


def _doubled(lows: list[list[int]], highs: list[list[int]], window: int) -> list[list]:
    """Starts from which two repeated windows follow each other: only they can repeat at twice the length."""
    out: list[list] = [[], []]
    for lo, hi in zip(lows, highs, strict=True):
        edge = np.zeros(max(hi) + 2, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.asarray(hi) + 1, -1)
        on = np.cumsum(edge) > 0
        both = np.flatnonzero(on[:-window] & on[window:]) if len(on) > window else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.diff(both, prepend=-2) > 1)
        out[0].append(both[cut] if len(both) else [])
        out[1].append(both[np.append(cut[1:], len(both)) - 1] if len(both) else [])
    return out


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, n_documents): how many texts have windows that a smaller id has too, at `window` words, twice that, and so on until no candidate survives."""
    found, length, live = [], window, None
    while True:
        hit = materialize(windows(docs, length, live), "repeats")
        n = hit.filter("late").select(*ROW).distinct().count()
        if not n:
            break
        found.append((length, n))
        live = materialize(append(_runs_of(hit), ["lo", "hi"], _doubled, "lo array<int>, hi array<int>", args=(length,)).filter(F.size("lo") > 0), "live")
        length *= 2
    return docs.sparkSession.createDataFrame(found, "length int, n_documents long")


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    return remove(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS r FROM hit GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(r), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN r IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(r, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
