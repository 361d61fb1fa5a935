"""SimHash near-duplicates: fingerprints within a Hamming radius are linked by self-joins of binary tries.

Fingerprint: A-Z are lower-cased, words are cut, each four-word shingle (repeats included; the whole sequence of a shorter text) is hashed with XXH64, and a
bit is set if it is set in over half of the hashes. A text without words has fingerprint zero and is linked like any other.

Linking. Equal fingerprints are one class from the start, so copies cost one row. With a radius of k, two fingerprints agree on at least one of k + 1 bit
blocks. For each block there is one trie, over the fingerprints rotated so that this block comes first; its top levels are traversed only along equal nodes,
which makes the subtrees below them independent groups and so the key by which the work is dealt out. Below, node pairs are traversed together:
the bits in which two nodes differ are added up, and a pair goes as soon as it has more than k. A group with more rows than `group_rows` is not given
to one task: its node pairs are descended by six levels in the cluster, each row going to the child pairs that keep within the budget, until the groups fit.
Within a task only a forest of links comes out: pairs of nodes that already lie wholly in one class are skipped, so thousands of near copies give
thousands of rows, not millions.

Components: the forests' edges are contracted with alternating large and small stars, each round a written table; no edge reaches the driver.

Defined results: a null text counts as empty; rows repeated with one id count once in the class and are returned as often as they came in; an empty table gives an
empty result; all classes are named by their smallest id, so ties can't occur. Rows with a null id are linked, but name a class only if no other row does (then its name is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import append, give_back
from covarium.session import materialize, release, ship

BITS, SHINGLE, SEED, RADIUS = 64, 4, 42, 4
#: Rows of one group that a task takes at most; larger groups are descended in the cluster first.
GROUP_ROWS = 200_000
DESCENT = 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[: -n].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(begin, (ends[n - 1 :] - 1).tolist(), strict=True)]
    raw = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def _fingerprints(texts: list[bytes]) -> list[list[int]]:
    return [[x - (1 << 64) if x >= 1 << 63 else x for x in map(fingerprint, texts)]]


def fingerprints(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the column `fp`: the fingerprint as a signed 64-bit number."""
    return append(df, [text_col], _fingerprints, "fp long", drop=drop)


# ---------------------------------------------------------------- linking within a task


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(rotation to the left, width) of the radius + 1 blocks."""
    k = radius + 1
    edge = [BITS * i // k for i in range(k + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(k)]


class Forest:
    """Classes of the rows of one task: labels are the smallest row of a class."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)
        self.stale = False

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the classes of a[i] and b[i]."""
        label = self.label
        a, b = label[a], label[b]
        todo = a != b
        if not todo.any():
            return
        a, b = a[todo], b[todo]
        while True:
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:  # shorten the paths
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
            a, b = label[a], label[b]
            todo = a != b
            if not todo.any():
                break
            a, b = a[todo], b[todo]
        self.stale = True

    def one_class(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        if self.stale:
            self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
            self.stale = False
        c = self.changes
        return (c[hi1 - 1] == c[lo1]) & (c[hi2 - 1] == c[lo2]) & (self.label[lo1] == self.label[lo2])


def _pairs(n1: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks of n1[i] x n2[i] cells: the block, row and column of each cell."""
    size = n1 * n2
    block = np.repeat(np.arange(len(size)), size)
    cell = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
    return block, cell // n2[block], cell % n2[block]


def trie_links(code: np.ndarray, starts: list[tuple[int, int, int, int, int, int]], radius: int, forest: Forest, leaf: int = 24, chunk: int = 1 << 17) -> None:
    """Link all rows within `radius` of each other, between the two nodes of each start (lo1, hi1, lo2, hi2, depth, differing bits).

    code: unsigned rotated fingerprints, ascending within each node. Frontiers of node pairs are arrays; a frontier longer than `chunk` is
    halved, so memory is bounded. The pairs of a frontier stand at one depth.
    """
    if not starts:
        return
    by_depth: dict[int, list] = {}
    for s in starts:
        by_depth.setdefault(s[4], []).append((*s[:4], s[5]))
    stack = [(d, np.array(v, np.int64).T) for d, v in sorted(by_depth.items())]
    while stack:
        depth, f = stack.pop()
        if f.shape[1] > chunk:
            cut = f.shape[1] // 2
            stack += [(depth, f[:, :cut]), (depth, f[:, cut:])]
            continue
        f = f[:, ~forest.one_class(*f[:4])]
        if not f.shape[1]:
            continue
        lo1, hi1, lo2, hi2, err = f
        small = ((hi1 - lo1) * (hi2 - lo2) <= leaf) | (depth >= BITS)
        if small.any():
            s = f[:, small]
            block, i, j = _pairs(s[1] - s[0], s[3] - s[2])
            a, b = s[0][block] + i, s[2][block] + j
            near = (a != b) & (np.bitwise_count(code[a] ^ code[b]) <= radius)
            forest.link(a[near], b[near])
            f = f[:, ~small]
            if not f.shape[1]:
                continue
            lo1, hi1, lo2, hi2, err = f
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        mid1, mid2 = _split(code, lo1, hi1, bit), _split(code, lo2, hi2, bit)
        same = (lo1 == lo2) & (hi1 == hi2)
        parts = [
            (lo1, mid1, lo2, mid2, err, np.ones(len(lo1), bool)),
            (mid1, hi1, mid2, hi2, err, np.ones(len(lo1), bool)),
            (lo1, mid1, mid2, hi2, err + 1, np.ones(len(lo1), bool)),
            (mid1, hi1, lo2, mid2, err + 1, ~same),
        ]
        nxt = []
        for p in parts:
            ok = p[5] & (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= radius)
            nxt.append(np.stack([x[ok] for x in p[:5]]))
        stack.append((depth + 1, np.concatenate(nxt[2:], axis=1)))
        stack.append((depth + 1, np.concatenate(nxt[:2], axis=1)))  # nearest first: what they link prunes the rest


def _split(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first row of each node [lo, hi) that has the bit: a binary search in all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (code[np.minimum(mid, len(code) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def link_rows(group: np.ndarray, side: np.ndarray, rot: np.ndarray, depth: np.ndarray, err: np.ndarray, radius: int) -> np.ndarray:
    """The class label (a row number) of each row; rows come sorted by group, side and rotated fingerprint."""
    n = len(rot)
    forest = Forest(n)
    edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1])]))
    ends = np.append(edge[1:], n)
    first = np.arange(n - 1)
    near = first[(group[1:] == group[:-1]) & (side[1:] == side[:-1]) & (np.bitwise_count(rot[1:] ^ rot[:-1]) <= radius) & (np.bitwise_count(rot[1:] ^ rot[:-1]) > 0)]
    forest.link(near, near + 1)
    starts = []
    k = 0
    while k < len(edge):
        lo, hi = int(edge[k]), int(ends[k])
        if side[lo] == 0:  # a node with itself
            if hi - lo > 1:
                starts.append((lo, hi, lo, hi, int(depth[lo]), int(err[lo])))
        elif k + 1 < len(edge) and group[edge[k + 1]] == group[lo]:
            starts.append((lo, hi, int(edge[k + 1]), int(ends[k + 1]), int(depth[lo]), int(err[lo])))
            k += 1
        k += 1
    trie_links(rot, starts, radius, forest)
    return forest.label


# ---------------------------------------------------------------- dealing the work out


def _rotate(fp: Column, left: int) -> Column:
    return F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, BITS - left)) if left else fp


def _bits(code: Column, depth: int, width: int) -> Column:
    """Bits [depth, depth + width) of the code, from the top."""
    return F.shiftrightunsigned(F.shiftleft(code, depth), BITS - width) if depth + width <= BITS else F.lit(0)


def _descend(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """Node pairs one step of `width` levels deeper: a row goes to each child pair that its node's child is part of and that keeps within the budget."""
    at = F.shiftrightunsigned(F.expr("shiftleft(rot, depth)"), BITS - width).cast("int")
    masks = F.array(*[F.lit(m) for m in range(1 << width)])
    ones = F.bit_count("mask")
    r = rows.withColumn("x", at).withColumn("mask", F.explode(masks)).filter(F.col("err") + ones <= radius)
    other = F.col("x").bitwiseXOR(F.col("mask"))
    left = (F.col("side") == 1) | ((F.col("side") == 0) & (F.col("x") <= other))
    a, b = F.when(left, F.col("x")).otherwise(other), F.when(left, other).otherwise(F.col("x"))
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("mask") == 0, F.lit(0)).when(left, F.lit(1)).otherwise(F.lit(2))
    return r.select("fp", "rot", F.concat_ws(".", "key", a, b).alias("key"), side.cast("int").alias("side"), (F.col("depth") + width).alias("depth"), (F.col("err") + ones).cast("int").alias("err"))


def _groups(distinct: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """(fp, rot, key, side, depth, err): every pair of rows that can be within the radius shares a key, and no key has over `group_rows` rows unless its bits are used up."""
    fp = F.col("fp")
    each = [F.struct(_rotate(fp, left).alias("rot"), F.concat_ws("/", F.lit(left).cast("string"), _bits(_rotate(fp, left), 0, width).cast("string")).alias("key"), F.lit(width).alias("depth")) for left, width in _blocks(radius)]
    rows = distinct.select("fp", F.explode(F.array(*each)).alias("g")).select("fp", "g.rot", "g.key", F.lit(0).alias("side"), "g.depth", F.lit(0).alias("err"))
    done = None
    while True:
        hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).filter((F.col("n") > group_rows) & (F.col("d") + DESCENT <= BITS)).select("key")
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cool = rows.join(hot, "key", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        rows = materialize(_descend(rows.join(hot, "key", "left_semi"), radius, DESCENT), "descent")


def links(distinct: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints of the column `fp`, whose components are those of all links within the radius."""
    ship(distinct.sparkSession)
    rows = _groups(distinct, radius, group_rows)
    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "side", F.col("rot").bitwiseXOR(F.lit(-(1 << 63))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(p: pd.DataFrame) -> pd.DataFrame:
            fp = p["fp"].to_numpy()
            label = link_rows(pd.factorize(p["key"])[0], p["side"].to_numpy(), p["rot"].to_numpy().view(np.uint64), p["depth"].to_numpy(), p["err"].to_numpy(), radius)
            moved = label != np.arange(len(label))
            return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

        held: list[pd.DataFrame] = []
        rows_held = 0
        for f in frames:  # whole groups at a time: the last group of a batch waits for its rest
            last = f["key"].iloc[-1]
            cut = int((f["key"] != last).sum())
            if cut and rows_held + cut >= 50_000:
                yield solve(pd.concat([*held, f.iloc[:cut]]))
                held, rows_held, f = [], 0, f.iloc[cut:]
            held.append(f)
            rows_held += len(f)
        if held:
            yield solve(pd.concat(held))
        give_back()

    return dealt.mapInPandas(run, "a long, b long").filter("a <> b")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of its component (as signed numbers).

    Large star: each node hands its larger neighbours to its smallest one. Small star: each node hands its smaller neighbours to the smallest. When a
    round changes nothing, every component is a star. Rounds grow with the logarithm of the longest path; each is a written table.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _digest(pairs)
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = materialize(small, "edges")
        release(pairs)
        pairs, old, before = after, before, _digest(after)
        if before == old:
            break
    else:
        raise RuntimeError("components did not settle")
    star = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())


#: Parts into which the rows of one component are dealt when they get its name.
SALTS = 16


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fp, component_id) for every row of `df`."""
    fps = materialize(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), drop=("text",)), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = materialize(components(links(distinct.select("fp"), radius, group_rows)).withColumnRenamed("node", "fp"), "components")
    rooted = distinct.join(comp, "fp")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # one component may hold a third of all fingerprints: its rows are dealt by salt as well
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"]).select("fp", "component_id")
    of = of.unionByName(distinct.join(comp, "fp", "left_anti").select("fp", F.col("least").alias("component_id")))
    return fps.join(of, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    return cluster(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
