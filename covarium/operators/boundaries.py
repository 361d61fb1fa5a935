"""Sentence boundaries learned without labels, by the statistics of Kiss and Strunk (2006) as Spark aggregates.

* A type (a token in lower case without marks at its ends) is an abbreviation if it comes with a full stop far more often than chance: the log-likelihood ratio of "nearly always with a full stop" over "as often as any
  token", times a factor that falls with its length, one that grows with its inner full stops, and one that falls with each time it comes without.
* A type is a starter if it follows a full stop that ends a sentence (not of an abbreviation, an initial or a number) more often than chance, by Dunning's log-likelihood ratio.
* Two types are a collocation if the first is an abbreviation, an initial or a number with a full stop and the second follows it more often than chance.

A full stop before white space ends a sentence unless its token begins a collocation with the next one, or is an abbreviation or an initial whose next token is no starter in upper case, or is a number whose next token
begins in lower case. `!` and `?` always end one.

Learning takes one pass over the texts, combined before it is shuffled; the tables that come out are as small as the vocabulary's part that passes the thresholds. Null and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from covarium.session import materialize, release, ship

#: Thresholds of the published method, and the share of full stops that an abbreviation is expected to have.
ABBREVIATION, STARTER, COLLOCATION, ALWAYS = 0.3, 30.0, 7.88, 0.99
#: Types that a splitter sends to the tasks at most.
MAX_TYPES = 1 << 20
#: Texts and characters that a task cuts at a time, so that it holds Python strings of a few texts, not of an Arrow batch.
PIECE, PIECE_CHARS = 64, 1 << 20
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
NUMBER = r"^[0-9.,:/-]+$"
INITIAL = r"^\p{L}$"


def type_of(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), EDGES, "")


def token_rows(texts: DataFrame, text_col: str) -> DataFrame:
    """(type, stop, next, n): how often a type comes with or without a full stop; with one, before which type behind it in its text (null: none).

    Tokens are counted as they stand first, so types are made once for each different token (or pair) and not for every one.
    """
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    behind = F.transform("w", lambda x, i: F.struct(x.alias("token"), F.when(x.endswith("."), F.get("w", i + 1)).alias("behind")))
    tokens = texts.select(words.alias("w")).select(F.explode_outer(behind).alias("t")).filter(F.col("t").isNotNull())
    tokens = tokens.groupBy("t.token", "t.behind").agg(F.count(F.lit(1)).alias("n"))
    typed = tokens.select(type_of(F.col("token")).alias("type"), F.col("token").endswith(".").alias("stop"), type_of(F.col("behind")).alias("next"), "n")
    return typed.groupBy("type", "stop", "next").agg(F.sum("n").alias("n"))


def _ll(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at p, with 0 ln 0 = 0."""
    safe = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    return safe(k, p) + safe(n - k, 1 - p)


def abbreviation_score(n: Column, k: Column, share: Column, kind: Column) -> Column:
    """Of a type with n tokens, k of them with a full stop, where `share` of all tokens have one."""
    share = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    size = F.length(F.regexp_replace(kind, r"\.", "")).cast("double")
    raw = 2 * (_ll(k, n, F.lit(ALWAYS)) - _ll(k, n, share))
    return raw * F.exp(-size) * (F.length(kind) - size + 1) * F.pow(size, k - n)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio that what comes `second` times of `total` is more (or less) frequent among the `first`, where it comes `both` times."""
    p, p1, p2 = second / total, both / first, F.try_divide(second - both, total - first)
    return 2 * (_ll(both, first, p1) + _ll(second - both, total - first, F.coalesce(p2, F.lit(0.0))) - _ll(both, first, p) - _ll(second - both, total - first, p))


@dataclass
class Boundaries:
    """abbreviations (type, score), starters (type, score), collocations (type, next, score)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def learn(texts: DataFrame, text_col: str = "TEXT") -> Boundaries:
    rows = materialize(token_rows(texts, text_col), "tokens")
    types = materialize(rows.groupBy("type").agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).cast("double").alias("k")), "types")
    pairs = rows.filter("stop AND next IS NOT NULL").select("type", "next", F.col("n").cast("double").alias("both"))
    sums = types.agg(F.sum("n").alias("tokens"), F.sum("k").alias("stops"))  # one row
    word = F.col("type").rlike(r"\p{L}") & ~F.col("type").rlike(INITIAL)
    scored = types.filter(word & (F.col("k") > 0)).join(F.broadcast(sums)).withColumn("score", abbreviation_score(F.col("n"), F.col("k"), F.col("stops") / F.col("tokens"), F.col("type")))
    short = materialize(scored.filter(F.col("score") >= ABBREVIATION).select("type", "score"), "abbreviations")
    known = pairs.join(short.select("type", F.lit(True).alias("short")), "type", "left")
    known = known.withColumn("open", F.coalesce("short", F.lit(False)) | F.col("type").rlike(INITIAL) | F.col("type").rlike(NUMBER))  # its full stop may end nothing
    ends = known.filter("NOT open").groupBy("next").agg(F.sum("both").alias("both"))
    breaks = ends.agg(F.sum("both").alias("breaks"))  # one row
    facts = F.broadcast(sums.select("tokens"))
    freq = types.select(F.col("type").alias("next"), F.col("n").alias("second"))
    starts = ends.join(freq, "next").join(F.broadcast(breaks)).join(facts).filter("next <> '' AND both / breaks > second / tokens")
    starts = starts.withColumn("score", association(F.col("both"), F.col("breaks"), F.col("second"), F.col("tokens"))).filter(F.col("score") >= STARTER).select(F.col("next").alias("type"), "score")
    first = known.filter("open").groupBy("type").agg(F.sum("both").alias("first"))
    together = known.filter("open AND next <> ''").join(first, "type").join(freq, "next").join(facts).filter("both > 1 AND both / first > second / tokens")
    together = together.withColumn("score", association(F.col("both"), F.col("first"), F.col("second"), F.col("tokens"))).filter(F.col("score") >= COLLOCATION).select("type", "next", "score")
    out = Boundaries(short, materialize(starts, "starters"), materialize(together, "collocations"))
    release(types, rows)
    return out


_TYPE_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER, _PIECE = re.compile(NUMBER), re.compile(r"[^ \t\n\x0B\f\r]+")


def ends_sentence(token: str, behind: str, short: set, starters: set, together: set) -> bool:
    """Whether a token that ends in a mark ends a sentence, before the token `behind`."""
    if token[-1] != ".":
        return True
    kind, after = _TYPE_EDGE.sub("", token.lower()), _TYPE_EDGE.sub("", behind.lower())
    if (kind, after) in together:
        return False
    if kind in short or len(kind) == 1 and kind.isalpha():
        return after in starters and behind[:1].isupper()
    return not (_NUMBER.match(kind) and behind[:1].islower())


def cut(text: str, short: set, starters: set, together: set) -> list[str]:
    out, begin, last = [], 0, None
    for m in _PIECE.finditer(text):
        if last is not None and last.group()[-1] in ".!?" and ends_sentence(last.group(), m.group(), short, starters, together):
            out.append(text[begin : last.end()])
            begin = m.start()
        last = m
    return [*out, text[begin:]] if last is not None else []


class Pairs:
    """A set of pairs by their first; equal strings are held once."""

    def __init__(self, firsts: list[str], seconds: list[str]):
        same: dict[str, str] = {}
        self.behind: dict[str, set[str]] = {}
        for a, b in zip(firsts, seconds, strict=True):
            self.behind.setdefault(a, set()).add(same.setdefault(b, b))

    def __contains__(self, pair: tuple[str, str]) -> bool:
        return pair[1] in self.behind.get(pair[0], ())


def cut_all(texts: pa.Array, short: set, starters: set, together: set | Pairs) -> pa.Array:
    """The sentences of each text, a few texts at a time; none of a null or empty one."""
    kind, out, some, chars = pa.list_(pa.string()), [], [], 0
    for t in texts:
        text = t.as_py()
        some.append(cut(text, short, starters, together) if text else [])
        chars += len(text or "")
        if len(some) >= PIECE or chars >= PIECE_CHARS:
            out.append(pa.array(some, kind))
            some, chars = [], 0
    return pa.concat_arrays([*out, pa.array(some, kind)])


def splitter(found: Boundaries) -> Callable[[Column], Column]:
    """For `sentence_table`: cuts texts by what was learned. The tables are sent to the tasks after a check of their size."""
    spark = found.abbreviations.sparkSession
    tables = [t.select(*c).limit(MAX_TYPES + 1).toArrow() for t, c in ((found.abbreviations, ["type"]), (found.starters, ["type"]), (found.collocations, ["type", "next"]))]
    if max(t.num_rows for t in tables) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types passed a threshold")
    ship(spark)
    columns = [[c.to_pylist() for c in t.columns] for t in tables]
    sent = spark.sparkContext.broadcast([set(columns[0][0]), set(columns[1][0]), Pairs(*columns[2])])

    @arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = cut_all(texts, *sent.value)
        pa.default_memory_pool().release_unused()
        return out

    return run
