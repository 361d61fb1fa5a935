"""Near copies with an exact check: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, whatever their fingerprints.

Shingles are cut as SimHash cuts them (A-Z lower-cased; the whole sequence of a shorter text is its only shingle), hashed to 64 bits, and counted once a text.
Texts with equal sets are one node from the start.

Candidates come in steps, and every one is checked on whole sets before it becomes a link. SimHash links within op9's radius come first, then in each
group of nodes that share a shingle those with one centre, then those of small blocks into which a group is dealt, so that large groups of near copies become one component
without their pairs, whether or not they have a text that all are similar to. These steps only save work. The last one is complete: if two sets of sizes a and b are similar enough, then in any fixed order of all shingles they share one of their first
a - ceil(0.8 a) + 1 and b - ceil(0.8 b) + 1. Pairs of nodes of different components that share one are counted; a pair goes unchecked only if sizes, parities or the
number shared rule 0.8 out (a bitmap of the parities of hashed shingles bounds the difference of two sets from below; larger sets have larger ones, as a small bitmap of a large set
tells nothing). The order puts shingles that a sample finds common last, which changes the work, never the links. Shingles that the same nodes have, known by 128 bits of hashes of these nodes and their number, are joined as one and counted as many.

Defined results: a null text counts as empty, and all texts without words are alike; rows are known by id and text, so rows that share an id are compared like any others, and a
row with a null id comes after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm import simhash
from covarium.llm.common import append, id_key, text_key
from covarium.session import materialize, release, tidy

SHINGLE, SEED = 5, 42
#: Documents in the sample that finds common shingles, and how many of these are put last.
SAMPLE, COMMON = 20_000, 50_000
#: Rounds before the complete join: one in which every node is compared with the likeliest of its groups' centres, and others in blocks.
ROUNDS = 3
#: Nodes of a block, about: the largest group of each node is dealt into so many blocks, and anew in each round.
BLOCK = 64
#: Rows of ids (16 bytes each) that are broadcast to find their texts; more go through a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one node, as the second of a pair, that are compared in one place.
DEALT = 256
#: 64-bit words of a set's parities; of a set with more shingles than these have bits, up to so many more words come after them.
MAP_WORDS, WIDE_WORDS = 16, 256


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending."""
    words = text.translate(simhash._LOWER).split()
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[:-n].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begin, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), SEED)).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first a - ceil(0.8 a) + 1 of a shingles: rare ones by hash, then the common ones (ascending hashes with their ranks) by rank."""
    size = len(own) - (4 * len(own) + 4) // 5 + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    hot = common[at] == own
    return np.concatenate([own[~hot], own[hot][np.argsort(rank[at[hot]])]])[:size]


def parities(own: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """Bit i: whether the number of shingles whose hash is i modulo the number of bits is odd."""
    odd = np.bincount((own & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def maps(own: np.ndarray) -> np.ndarray:
    """The parities; of a set with more shingles than bits, those modulo the next power of two that isn't below its size follow."""
    if len(own) <= 64 * MAP_WORDS:
        return parities(own)
    return np.concatenate([parities(own), parities(own, min(WIDE_WORDS, 1 << (-(-len(own) // 64) - 1).bit_length()))])


def _sets(texts: list[bytes]) -> list[list]:
    sets = [shingles(t) for t in texts]
    return [[node_of(s) for s in sets], [s.view(np.int64) for s in sets]]


def _rows(texts: list[bytes], common) -> list[list]:
    out: list[list] = [[], [], [], [], []]
    for t in texts:
        own = shingles(t)
        fp = simhash.fingerprint(t, SHINGLE)
        for c, v in zip(out, (node_of(own), len(own), fp - (1 << 64) if fp >> 63 else fp, prefix(own, *common.value).view(np.int64), maps(own)), strict=True):
            c.append(v)
    return out


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled sets, ascending, and their ranks by number of sets."""
    step = max(1, docs.count() // SAMPLE)
    some = append(docs.filter(F.pmod(F.xxhash64("kid", "th"), F.lit(step)) == 0), ["text"], _sets, "node long, own array<long>", drop=("kid", "th", "text"))
    per = some.dropDuplicates(["node"]).select(F.explode("own").alias("key")).groupBy("key").count().filter("count > 2")
    found = np.array([r.key for r in per.orderBy(F.desc("count"), "key").limit(COMMON).collect()][::-1], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def _may(c: Column) -> Column:
    """Whether nodes of sizes n1 and n2 that share c of their first shingles can have a similarity of 0.8."""
    low, high = F.least("n1", "n2"), F.greatest("n1", "n2")
    return (5 * low >= 4 * high) & (9 * (c + F.floor((4 * high + 4) / 5) - 1) >= 4 * (low + high))


def check(pairs: DataFrame, small: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (written ones) that have a Jaccard similarity of 0.8 or more. Sets are made of the texts of these pairs' nodes and no others.

    Sets meet in the JVM. A node that many pairs have as `b` is dealt out: DEALT pairs, and a copy of its set, come to one place.
    """
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = materialize(small.join(used, "node", "left_semi").select("least.kid", "least.th"), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, ["kid", "th"], "left_semi").groupBy("kid", "th").agg(F.first("text").alias("text"))
    sets = materialize(append(texts, ["text"], _sets, "node long, own array<long>", drop=("kid", "th", "text")), "sets")
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("parts"))
    right = sets.toDF("b", "right").join(parts, "b").select("b", "right", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    both = dealt.join(sets.toDF("a", "left"), "a").join(right, ["b", "part"])
    near = 9 * F.size(F.array_intersect("left", "right")) >= 4 * (F.size("left") + F.size("right"))
    out = materialize(both.filter(near).select("a", "b"), "links")
    release(ids, sets, pairs)
    tidy(pairs.sparkSession)
    return out


def merged(roots: DataFrame | None, links: DataFrame, small: DataFrame) -> DataFrame:
    """(node, root) of all nodes, with new links taken in: components found before are contracted, so that only links between them are followed."""
    if roots is None:
        return materialize(small.select("node").join(simhash.components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    between = links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = simhash.components(between).toDF("root", "up")
    out = materialize(roots.join(found, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
    release(roots)
    return out


def folded(shared: DataFrame) -> DataFrame:
    """Rows (node, n, key, w): of the keys of `shared` (node, n, key) that the same nodes have one stays, with their number w. What two nodes share is the sum of w, as before."""
    groups = shared.groupBy("key").agg(F.count(F.lit(1)).alias("k"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)])
    one = groups.groupBy("k", "h1", "h2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w")).select("key", "w")
    return shared.join(one, "key").select("node", "n", "key", "w")


def centred(rows: DataFrame, roots: DataFrame | None, k: int) -> DataFrame:
    """Rows (node, n, key, w) with their components so far, the centre (the k-th choice) of their shingle's group, and its size; shingles whose nodes lie in one component go.

    Groups are aggregated before anything is shuffled, never gathered.
    """
    r = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node")
    groups = r.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many"), F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("x"), "node", "n", "root")).alias("top"))
    out = materialize(r.join(groups.filter("lo < hi").select("key", "top", "many"), "key"), "centred")
    tidy(rows.sparkSession)
    return out


def _to_centres(rows: DataFrame) -> DataFrame:
    """Each node with that centre of its groups with which it shares most shingles, if sizes and their number don't rule the pair out: one pair a node and round."""
    star = rows.filter("root <> top.root").groupBy(F.col("node").alias("a"), F.col("top.node").alias("b"), F.col("n").alias("n1"), F.col("top.n").alias("n2"))
    likely = star.agg(F.sum("w").alias("c")).filter(_may(F.col("c")))
    return likely.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b")


def _apart(x: Column, y: Column) -> Column:
    """Places in which wide parities differ. One of twice the other's words is folded to these: parities modulo half as many bits are its halves, one XOR the other."""
    k = F.least(F.size(x), F.size(y))
    xor = lambda p, q: p.bitwiseXOR(q)
    x, y = (F.when(F.size(v) > k, F.zip_with(F.slice(v, 1, k), F.slice(v, k + 1, k), xor)).otherwise(v) for v in (x, y))
    return F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda s, v: s + F.bit_count(v))


def _pairs(one: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Pairs (a, b, n1, n2, w; a < b) of rows of `one` (node, n, root, keys, w, most) of different components with equal keys, but for pairs that sizes or parities rule out.

    `most` is one root a group, the same for all its rows (or null: none is known). Of two rows of different components one at least lies outside of that root, so only rows outside of it are compared with
    all others: where one component has most of a group, its rows are never compared among themselves.

    Sets whose parities differ in d places differ in at least d shingles; where that is too many, the join drops the pair as it finds it, so of a group of many texts that
    have a passage in common only pairs come out that are about as similar as wanted.
    """
    own = nodes.select("node", *[F.element_at("map", i + 1).alias(f"m{i}") for i in range(MAP_WORDS)], F.slice("map", MAP_WORDS + 1, WIDE_WORDS).alias("wide"))
    two = one.select("node", "n", "root", *keys, "most").join(own, "node")
    two = two.toDF(*[f"a_{c}" for c in two.columns])
    one = one.filter(~F.col("root").eqNullSafe(F.col("most"))).select("node", "n", "root", *keys, "w").join(own, "node")
    apart = sum((F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"a_m{i}"))) for i in range(1, MAP_WORDS)), F.bit_count(F.col("m0").bitwiseXOR(F.col("a_m0"))))
    fit = (5 * F.least("n", "a_n") >= 4 * F.greatest("n", "a_n")) & (9 * apart <= F.col("n") + F.col("a_n"))
    fit &= (F.size("wide") == 0) | (F.size("a_wide") == 0) | (9 * _apart(F.col("wide"), F.col("a_wide")) <= F.col("n") + F.col("a_n"))
    for c in keys:
        fit &= F.col(c) == F.col(f"a_{c}")
    once = F.col("a_root").eqNullSafe(F.col("a_most")) | (F.col("node") < F.col("a_node"))
    found = one.join(two, fit & once & (F.col("root") != F.col("a_root")))
    return found.select(F.least("node", "a_node").alias("a"), F.greatest("node", "a_node").alias("b"), F.least("n", "a_n").alias("n1"), F.greatest("n", "a_n").alias("n2"), "w")


def _in_blocks(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of different components within blocks of each node's largest group: work in proportion to the nodes, and in a group in which a share of the pairs is similar
    every node meets some of its likes."""
    own = rows.groupBy("node", "n", "root").agg(F.max(F.struct("many", "key", F.col("top.root").alias("most"))).alias("m"))
    block = F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("m.many") / BLOCK))
    return _pairs(own.select("node", "n", "root", "m.key", block.alias("block"), F.lit(1).alias("w"), "m.most"), nodes, "key", "block").select("a", "b")


def _rest(rows: DataFrame, nodes: DataFrame, most: Column | None = None, w: Column | None = None) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of `rows` (node, n, key, root), which stands for w (or one), and that neither sizes, nor parities, nor the number shared rule out."""
    rows = rows.withColumns({"most": F.lit(None).cast("long") if most is None else most, "w": F.lit(1) if w is None else w})
    counted = _pairs(rows, nodes, "key").groupBy("a", "b", "n1", "n2").agg(F.sum("w").alias("c"))
    return counted.filter(_may(F.col("c"))).select("a", "b")


def cluster(docs: DataFrame) -> DataFrame:
    """(node, root, least): the nodes of `docs` (doc_id, text), their components, and the least (kid, th) of each node: its smallest id, and the hash of that row's text."""
    spark = docs.sparkSession
    docs = docs.select(id_key().alias("kid"), text_key().alias("th"), "text")
    common = spark.sparkContext.broadcast(common_shingles(docs))
    made = append(docs, ["text"], _rows, "node long, n int, fp long, prefix array<long>, map array<long>", drop=("text",), args=(common,))
    nodes = made.groupBy("node").agg(F.min(F.struct("kid", "th")).alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "prefix", "map")])
    nodes = materialize(nodes, "nodes")
    tidy(spark)
    small = nodes.select("node", "least", "n", "fp")

    of = materialize(small.groupBy("fp").agg(F.min("node").alias("top")), "distinct")
    alike = small.join(of, "fp").filter("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b"))
    near = simhash.links(of.select("fp")).distinct().join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = materialize(alike.union(near), "pairs")
    release(of)

    keys = nodes.select("node", "n", F.explode("prefix").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key")
    shared = materialize(keys.join(several, "key", "left_semi"), "shared")
    tidy(spark)

    roots, rows = None, materialize(folded(shared), "folded")
    release(shared)
    for k in range(ROUNDS):
        old, rows = rows, centred(rows.select("node", "n", "key", "w"), roots, k)
        release(old)
        pairs = _to_centres(rows).union(first) if roots is None else _in_blocks(rows, nodes, k)
        more = check(materialize(pairs, "pairs"), small, docs)
        if roots is not None and more.isEmpty():
            break
        roots = merged(roots, more, small)
    else:
        old, rows = rows, centred(rows.select("node", "n", "key", "w"), roots, ROUNDS)
        release(old)
    roots = merged(roots, check(materialize(_rest(rows, nodes, F.col("top.root"), F.col("w")), "pairs"), small, docs), small)
    release(rows, first)
    return small.join(roots, "node").select("node", "root", "least")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component of `docs` one row, with all its columns: that with the smallest id (a null id comes last), among rows of one id that with the smallest hash of its text, among
    rows with equal ids and texts that with the smallest hash of all its columns. No row goes unless another of its component stays, whatever its id."""
    keep = cluster(docs).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.kid").alias("_kid"), F.col("least.th").alias("_th"))
    names = docs.columns
    rows = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    own = rows.columns
    hashed = [f.name for f in rows.schema if "map" not in f.dataType.simpleString()]
    rows = rows.withColumns({"_kid": id_key(f"_d{names.index('doc_id')}"), "_th": text_key(f"_d{names.index('text')}")}).join(keep, ["_kid", "_th"], "left_semi")
    one = rows.groupBy("_kid", "_th").agg(F.min_by(F.struct(*own), F.xxhash64(*hashed)).alias("r"))
    return one.select("r.*").toDF(*names)
