"""Ranked lexical search over an index clustered by recursive graph bisection, with exact stopping.

1. Order. Documents get a place by recursive graph bisection (`bisection`), fitted on a bounded sample of `SAMPLE` documents and applied to all.
2. Postings. One pass over all texts finds each document's length and how often it has the terms of the items; what the scores need of the whole corpus (documents, terms, documents with a term) is counted from these.
3. Index. Neighbours in the order form shards of at most about `SHARD_ROWS` documents and `SHARD_POSTINGS` postings; a shard is one row: its documents, its inverted lists with each posting's share of a score, and for
   each term the highest share in the shard.
4. Search. An item's bound for a shard is the sum of its terms' highest shares there, weighted; no document of the shard scores more. Every item visits the `FIRST` shards with the highest bounds, which gives it a k-th
   best score, and then only shards whose bound reaches that score: the shards are visited in the order of their bounds, and the rest of that order can't hold a better document, nor one that ties.

Places in the order never leave the index: results name documents by doc_id, and ties go by it. Items are worked off in blocks whose terms, `TERMS` at most unless one group of `TOGETHER` items alone has more, are known to every task.

Defined results: terms are those of `terms.cut`; null and empty texts have none, so they are neither counted nor found, and an item without terms finds nothing. Repeated rows are documents of their own; rows that share an id
are ordered by the hash of their text, rows without an id come after all others. Items with equal id and text are answered once; other items that repeat an id are answered each for itself. Fewer than k documents with a
score above zero are all returned; empty tables give empty results. Ids are whole numbers or null. Very long texts are counted whole; a row of the index holds whole documents, so a single very long one may exceed the
bound of postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covarium.llm import bisection
from covarium.llm.common import LAST_ID, append, documents, give_back, text_key
from covarium.llm.terms import cut
from covarium.operators.ranking import dense_index
from covarium.session import materialize, release, ship, spread

K, SAMPLE, TERMS = 20, 2048, 200_000
#: Of a sampled document that many hashed terms at most are used, those with the lowest numbers.
SAMPLE_TERMS = 2048
SHARD_ROWS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Shards that every item visits first; items that are answered together in a task.
FIRST, TOGETHER = 4, 64


# ---------------------------------------------------------------- order


def _sample_buckets(texts: list[bytes]) -> list[list]:
    return [[sorted({bisection.bucket(w) for w in set(cut(t))})[:SAMPLE_TERMS] for t in texts]]


def fit_order(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> bisection.Bisection:
    """Fitted on the texts of the `sample` distinct ids with the smallest hashes (of an id's texts that with the smallest hash): that many rows at most, whatever repeats."""
    few = docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(few), "id")  # `sample` rows at most
    texts = texts.withColumn("h", text_key("text")).groupBy("id").agg(F.min_by("text", "h").alias("text"))
    got = append(texts, ["text"], _sample_buckets, "buckets array<int>", drop=("text",)).orderBy("id").select("buckets").toArrow()["buckets"].to_pylist()
    start = np.cumsum([0, *map(len, got)])
    return bisection.fit(start, np.fromiter((b for x in got for b in x), np.int64, int(start[-1])))


# ---------------------------------------------------------------- postings


def _postings(texts: list[bytes], sent) -> list:
    """Leaf and length of each document, and the numbers and counts of the terms in the vocabulary."""
    known, order = sent.value
    n, tids, tfs, start, buckets = [], [], [], [0], []
    for t in texts:
        count = Counter(cut(t))
        n.append(sum(count.values()))
        hit = [(known[w], f) for w, f in count.items() if w in known]
        tids.append(np.array([x for x, _ in hit], np.int32))
        tfs.append(np.array([x for _, x in hit], np.int32))
        buckets += {bisection.bucket(w) for w in count}
        start.append(len(buckets))
    return [order.leaves(np.array(start), np.array(buckets, np.int64)).tolist(), n, tids, tfs]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], order: bisection.Bisection, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, tie, leaf, n, tids, tfs) of every row with a term: `n` of all its terms, `tids` and `tfs` of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, order))  # bounded by TERMS and by the tree's size
    rows = spread(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_key(text_col).alias("tie"), F.col(text_col).alias("text")))
    return append(rows, ["text"], _postings, "leaf int, n long, tids array<int>, tfs array<int>", drop=("text",), args=(sent,)).filter("n > 0")


def weights(posts: DataFrame, stats) -> DataFrame:
    """(tid, w): the weight of each term that a document holds."""
    df = posts.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    return df.select("tid", F.floor(1000 * F.log((2.0 * stats.N + 2) / (2.0 * F.col("df") + 1))).alias("w"))


# ---------------------------------------------------------------- index

_INDEX = "shard long, ids binary, ties binary, terms array<int>, tops array<int>, starts binary, members binary, shares binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row of the index from the documents of a shard: inverted lists in the order of term numbers, members as places among the shard's documents."""
    ids, ties, m = (table[c].to_numpy() for c in ("id", "tie", "m"))
    tids, tfs = (table[c].combine_chunks() for c in ("tids", "tfs"))
    size = np.diff(tids.offsets.to_numpy())
    tid, tf = (x.flatten().to_numpy().astype(np.int64) for x in (tids, tfs))
    member = np.repeat(np.arange(len(ids)), size)
    share = 1_000_000_000 * tf // (1000 * tf + 12 * m[member])
    by = np.argsort(tid, kind="stable")
    tid, member, share = tid[by], member[by], share[by]
    first = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
    row = [table["shard"][0].as_py(), ids.tobytes(), ties.tobytes(), tid[first].tolist(), np.maximum.reduceat(share, first).tolist(), np.append(first, len(tid)).tobytes(), member.astype(np.int32).tobytes(), share.astype(np.int32).tobytes()]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])


def build(posts: DataFrame, stats) -> DataFrame:
    """The index: one row for each shard."""
    some = posts.filter(F.size("tids") > 0).withColumn("m", F.expr(f"100 - 25 + ((25 * n * {stats.N}L) div {stats.L}L)"))
    leaves = some.groupBy("leaf").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_ROWS), F.ceil(F.sum(F.size("tids")) / SHARD_POSTINGS)).alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each leaf of a tree of fixed depth
    dealt = some.join(F.broadcast(leaves.select("leaf", "parts", before.alias("base"))), "leaf")
    # a copy's place within its leaf is dealt by its content and its id, and copies without an id by chance of their row's place in the written table, so no group of copies meets in one shard
    spot = F.when(F.col("id") < LAST_ID, F.xxhash64("id", "tie")).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.withColumn("shard", F.col("base") + F.pmod(spot, F.col("parts")))
    return dealt.select("shard", "id", "tie", "m", "tids", "tfs").groupBy("shard").applyInArrow(_pack, _INDEX)


# ---------------------------------------------------------------- search


def _visit(k: int):
    """Scores the items of a row in its shard: for each the k best documents, and all that tie with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                asked, ids, ties, terms, starts, members, shares = (b.column(i)[r] for i in range(7))
                ids, ties = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, ties))
                starts, members, shares = np.frombuffer(starts.as_buffer(), np.int64), np.frombuffer(members.as_buffer(), np.int32), np.frombuffer(shares.as_buffer(), np.int32)
                terms = terms.values.to_numpy()
                out = []
                for item in asked.as_py():
                    tids, w = np.array(item["tids"], np.int64), np.array(item["ws"], np.int64)
                    at = np.searchsorted(terms, tids)
                    ok = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == tids)
                    score = np.zeros(len(ids), np.int64)
                    for t, x in zip(at[ok].tolist(), w[ok].tolist(), strict=True):
                        lo, hi = starts[t], starts[t + 1]
                        score[members[lo:hi]] += x * shares[lo:hi].astype(np.int64)  # a document is once in a list
                    found = np.flatnonzero(score >= max(1, item["least"]))
                    if len(found) > k:
                        found = found[np.lexsort((ties[found], ids[found], -score[found]))[:k]]
                    out.append((np.full(len(found), item["item"]), ids[found], ties[found], score[found]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["item", "id", "tie", "score"])
        give_back()

    return run


def _found(visits: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Documents of the shards in `visits` (item, shard, least) that may be among the k best."""
    rows = visits.join(asked, "item").groupBy("shard", F.floor(F.col("item") / TOGETHER).alias("block"))
    rows = rows.agg(F.collect_list(F.struct("item", "tids", "ws", "least")).alias("asked")).join(index, "shard")  # TOGETHER items at most
    return rows.select("asked", "ids", "ties", "terms", "starts", "members", "shares").mapInArrow(_visit(k), "item long, id long, tie long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id", "tie"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _search(docs: DataFrame, terms: DataFrame, order: bisection.Bisection, k: int, text_col: str, id_col: str) -> DataFrame:
    """(item, rank, id, score) of one block of items, given by their (item, term, times)."""
    numbered = materialize(dense_index(terms.select("term").distinct(), [F.col("term")], "tid"), "terms")
    vocabulary = {r.term: r.tid for r in numbered.toLocalIterator()}  # bounded by TERMS
    posts = materialize(postings(docs, {bytes(t): i for t, i in vocabulary.items()}, order, text_col, id_col), "postings")
    stats = posts.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    index = materialize(build(posts, stats), "index")
    weighed = terms.join(numbered, "term").join(weights(posts, stats), "tid").select("item", "tid", (F.col("w") * F.col("times")).alias("w"))
    weighed = materialize(weighed.filter("w > 0"), "weights")
    tops = index.select("shard", F.explode(F.arrays_zip("terms", "tops")).alias("x")).select("shard", F.col("x.terms").alias("tid"), F.col("x.tops").cast("long").alias("top"))
    bounds = weighed.join(tops, "tid").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    bounds = materialize(bounds.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))), "bounds")
    asked = weighed.groupBy("item").agg(F.collect_list("tid").alias("tids"), F.collect_list("w").alias("ws"))
    first = materialize(_best(_found(bounds.filter(F.col("turn") <= FIRST).select("item", "shard", F.lit(1).cast("long").alias("least")), asked, index, k), k), "first")
    least = first.filter(F.col("rank") == k).select("item", F.col("score").alias("least"))
    left = bounds.filter(F.col("turn") > FIRST).join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).filter("bound >= least")
    rest = _found(left.select("item", "shard", "least"), asked, index, k)
    out = materialize(_best(first.drop("rank").unionByName(rest), k), "best")
    release(numbered, posts, index, weighed, bounds, first)
    return out


def _terms(texts: list[bytes]) -> list[list]:
    return [[list(Counter(cut(t)).items()) for t in texts]]


def search(docs: DataFrame, items: DataFrame, k: int = K, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above zero."""
    spark = docs.sparkSession
    ship(spark)
    each = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    cut_items = append(each, ["text"], _terms, "terms array<struct<term:binary,times:long>>")
    known = dense_index(cut_items.filter(F.size("terms") > 0), [F.col("item_id"), text_key("text"), F.col("text")], "item").select("item", "item_id", "terms")
    known = materialize(known.withColumn("size", F.size("terms").cast("long")), "items")
    # items in blocks of TERMS terms, cut between groups of TOGETHER items
    group = F.floor(F.col("item") / TOGETHER)
    ends = np.cumsum([r.size for r in known.groupBy(group.alias("g")).agg(F.sum("size").alias("size")).orderBy("g").toLocalIterator()])
    edges = [0]
    while edges[-1] < len(ends):
        before = ends[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, before + TERMS, side="right"))))
    order = fit_order(docs, text_col, id_col)
    out = None
    for a, b in zip(edges, edges[1:]):
        terms = known.filter((group >= a) & (group < b)).select("item", F.explode("terms").alias("t")).select("item", "t.term", "t.times")
        got = _search(docs, terms, order, k, text_col, id_col)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = out.join(known.select("item", "item_id"), "item")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(id, {LAST_ID}L)").alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS terms FROM documents),
facts AS (SELECT count(*) AS total_docs, sum(len(terms))::BIGINT AS total_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, facts GROUP BY term, total_docs),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * total_docs) // total_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), facts GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
