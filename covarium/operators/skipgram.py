"""Skip-gram pairs: each word with the words around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.hashing import portable_int
from covarium.operators.resample import draw


# Odd multipliers below 2**32 and the shifts between them.
STEP, MIX = 0x9E3779B1, ((0x2C1B3C6D, 15), (0x297A2D39, 12))
_LOW = (1 << 32) - 1


def mixed(seed: Column, pos: Column) -> Column:
    """32 bits from a text's 32-bit seed and a position. No product reaches 2**63, so it is plain arithmetic here and in other engines."""
    x = (seed + pos.cast("bigint") * STEP).bitwiseAND(_LOW)
    for m, r in MIX:
        x = (x.bitwiseXOR(F.shiftright(x, r)) * m).bitwiseAND(_LOW)
    return x.bitwiseXOR(F.shiftright(x, 15))


def window(size: int, seed: Column, pos: Column) -> Column:
    """1 to `size`, drawn for each centre."""
    return (F.pmod(mixed(seed, pos), F.lit(size)) + 1).cast("int")


def centres(samples: DataFrame, keys: list[str], size: int = 5, seed: int = 42, words: str = "words", around: bool = True) -> DataFrame:
    """(keys, pos, lo, hi) for each centre: its position and the first and last of its window; with `around` also `word` and the window's words, so that no row carries a whole text.

    A text's seed is hashed once, its positions are mixed with it by arithmetic on narrow rows. With `around` one small struct for each position is exploded; pairs come from these rows, never as one array for a text.
    """
    w, n = F.col(words), F.size(words)
    own = portable_int(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    lo, hi = (lambda pos, win: F.greatest(F.lit(0), pos - win)), (lambda pos, win, n: F.least(n - 1, pos + win))
    if not around:
        each = samples.select(*keys, own.alias("_seed"), n.alias("_n"))
        each = each.select(*keys, "_seed", "_n", F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1))).alias("pos")).filter(F.col("pos").isNotNull())
        win = window(size, F.col("_seed"), F.col("pos"))
        return each.select(*keys, "pos", lo(F.col("pos"), win).alias("lo"), hi(F.col("pos"), win, F.col("_n")).alias("hi"))

    def of(pos: Column) -> Column:
        win = window(size, own, pos)
        return F.struct(pos.alias("pos"), lo(pos, win).alias("lo"), hi(pos, win, n).alias("hi"))

    each = F.transform(F.sequence(F.lit(0), n - 1), of)
    each = F.transform(each, lambda s: F.struct(s["pos"].alias("pos"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.get(w, s["pos"]).alias("word"), F.slice(w, s["lo"] + 1, s["hi"] - s["lo"] + 1).alias("near")))
    fields = ["pos", "lo", "hi", "word", "near"]
    return samples.select(*keys, F.explode_outer(F.when(n > 0, each)).alias("p")).filter(F.col("p").isNotNull()).select(*keys, *[F.col(f"p.{f}").alias(f) for f in fields])


def positions(samples: DataFrame, keys: list[str], size: int = 5, seed: int = 42, words: str = "words") -> DataFrame:
    """(keys, pos, ctx_pos) of all pairs, without their words."""
    c = centres(samples, keys, size, seed, words, around=False)
    return c.select(*keys, "pos", F.explode(F.sequence("lo", "hi")).alias("ctx_pos")).filter("ctx_pos <> pos")


def pairs(samples: DataFrame, keys: list[str], size: int = 5, seed: int = 42, words: str = "words") -> DataFrame:
    """(keys, pos, ctx_pos, word, context) for each centre and each other word at most its drawn window away.

    A centre's window travels with it, so there is no self-join and no row carries a whole text.
    """
    c = centres(samples, keys, size, seed, words)
    p = c.select(*keys, "pos", "lo", "word", F.posexplode("near").alias("_k", "context")).withColumn("ctx_pos", F.col("lo") + F.col("_k"))
    return p.filter("ctx_pos <> pos").select(*keys, "pos", "ctx_pos", "word", "context")


def kept(pairs_: DataFrame, vocab: DataFrame, keys: list[str], seed: int = 42, epoch: int = 0) -> DataFrame:
    """Pairs that survive subsampling: a centre is dropped once for all its pairs, a context is drawn anew for each pair; words outside the vocabulary go. `vocab`: token, discard_prob."""
    chance = lambda *k: draw(F.lit(1 << 30), *k) / F.lit(float(1 << 30))
    v = vocab.select("token", "discard_prob")
    p = pairs_.join(v.withColumnsRenamed({"token": "word", "discard_prob": "_dw"}), "word").join(v.withColumnsRenamed({"token": "context", "discard_prob": "_dc"}), "context")
    k = [F.col(x) for x in keys]
    centre = chance(F.lit(f"{seed}-{epoch}-centre"), *k, F.col("pos")) >= F.col("_dw")
    context = chance(F.lit(f"{seed}-{epoch}-context"), *k, F.col("pos"), F.col("ctx_pos")) >= F.col("_dc")
    return p.filter(centre & context).select(*keys, "pos", "ctx_pos", "word", "context")
