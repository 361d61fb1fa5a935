"""Document fingerprints: Merkle trees over sections and paragraphs, in DataFrame functions only.

A text is cut into sections at empty lines, these into paragraphs at line ends, and these into leaves: up to `LEAF` characters that end no sentence, with the
marks that follow. Nothing is dropped, so equal trees mean equal texts. A leaf is hashed with XXH64, a paragraph over its leaves, a section over its
paragraphs, and the root is the MD5 of the sections' hashes: roots test equality, and where two roots differ, the branches below them
(sections, then paragraphs, then leaves) that differ locate the edit. The fingerprint string holds the whole tree:

    <root>|<section>:<paragraph>=<leaf>.<leaf>,<paragraph>=...;<section>:...

Likeness of two fingerprints: 1 if the roots are equal, else the Dice measure of their sets of leaves.

Neighbours in the order of ids are brought together without a global sort: bounds are quantiles of the ids (a list of fixed length), a row is dealt to its range, and
the first row of each range also goes to the range before it, so one shuffle of the texts serves.

Defined results: a null text counts as empty; the empty text has one section with one empty paragraph; a null id comes before all others; rows repeated with one id follow
each other in the order of their texts' hashes; the only document of a table is its own next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 48
LEAF_RE = rf"[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+"
LEAVES = "array<array<array<bigint>>>"
MAX_RANGES = 20_000


def tree(text: Column) -> Column:
    """sections -> paragraphs -> leaf hashes."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF_RE), F.lit(0)), lambda x: F.xxhash64(x))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def section_hashes(t: Column) -> Column:
    return F.transform(t, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))


def root(t: Column) -> Column:
    return F.md5(F.array_join(F.transform(section_hashes(t), lambda x: F.hex(x)), ".").cast("binary"))


def fingerprint(t: Column, r: Column) -> Column:
    """The string of a tree `t` with root `r`."""
    hexes = lambda xs: F.array_join(F.transform(xs, lambda x: F.hex(x)), ".")
    paragraph = lambda p: F.concat(F.hex(F.xxhash64(p)), F.lit("="), hexes(p))
    section = lambda s: F.concat(F.hex(F.xxhash64(F.transform(s, lambda p: F.xxhash64(p)))), F.lit(":"), F.array_join(F.transform(s, paragraph), ","))
    return F.concat(r, F.lit("|"), F.array_join(F.transform(t, section), ";"))


def leaf_set(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(t)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    both = F.size(leaves_a) + F.size(leaves_b)
    dice = F.when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(leaves_a, leaves_b)) / both)
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(dice)


def parse(fp: str) -> dict:
    """A fingerprint string as root and {section: [(paragraph, [leaf, ...])]} in order; for tools outside Spark."""
    r, _, rest = fp.partition("|")
    sections = []
    for s in rest.split(";"):
        node, _, ps = s.partition(":")
        sections.append((node, [(p.partition("=")[0], [x for x in p.partition("=")[2].split(".") if x]) for p in ps.split(",")]))
    return {"root": r, "sections": sections}


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of `a` at which the trees differ: only branches whose hashes differ are entered."""
    x, y = parse(a), parse(b)
    if x["root"] == y["root"]:
        return []
    out = []
    for i, (node, ps) in enumerate(x["sections"]):
        other = y["sections"][i] if i < len(y["sections"]) else (None, [])
        if node != other[0]:
            out += [(i, j) for j, (p, _) in enumerate(ps) if j >= len(other[1]) or p != other[1][j][0]]
    return out


def with_next(docs: DataFrame, cols: list[str], key: str, tie: str) -> DataFrame:
    """`docs` with `next`, a struct of `cols` of the row that follows in the order of (key, tie); after the last row comes the first."""
    spark = docs.sparkSession
    n = min(MAX_RANGES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 100_000).alias("cuts")).first()
    if cuts["least"] is None:
        bounds = [0]
    else:
        bounds = sorted({cuts["least"], *cuts["cuts"]})
    lits = F.lit(bounds) if len(bounds) > 1 else F.array(F.lit(bounds[0]))
    lits = lits.cast("array<bigint>")
    steps = F.lit([1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] + [0]).cast("array<int>")
    reach = lambda pos, step: (pos + step <= len(bounds)) & (F.try_element_at(lits, pos + step) <= F.col(key))
    part = F.aggregate(steps, F.lit(0), lambda pos, step: F.when((step > 0) & reach(pos, step), pos + step).otherwise(pos))
    head = F.try_element_at(lits, F.col("_part")) == F.col(key)
    before = F.when(F.col("_part") == 1, F.lit(len(bounds))).otherwise(F.col("_part") - 1)
    own, extra = F.struct(F.col("_part").alias("part"), F.lit(0).alias("late")), F.struct(before.alias("part"), F.lit(1).alias("late"))
    dealt = docs.withColumn("_part", part).withColumn("_to", F.explode(F.when(head, F.array(own, extra)).otherwise(F.array(own))))
    w = Window.partitionBy("_to.part").orderBy("_to.late", key, tie)
    return dealt.withColumn("next", F.lead(F.struct(*cols)).over(w)).filter("_to.late = 0").drop("_part", "_to")


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    return fingerprints(documents(spark, sf_dir))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness to that and to the next document's."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), text.alias("text"))
    base = base.withColumn("tree", tree(F.col("text"))).withColumn("root", root(F.col("tree"))).withColumn("tie", F.xxhash64("text"))
    pairs = with_next(base, ["text", "tree", "root"], "key", "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    e = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text")
    e = e.select("doc_id", "n_chars", "root", "tree", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("edited")).alias("edited_tree"), F.col("next.tree").alias("next_tree"), F.col("next.root").alias("next_root"))
    e = e.withColumn("edited_root", root(F.col("edited_tree")))
    e = e.withColumns({"own": leaf_set(F.col("tree")), "changed": leaf_set(F.col("edited_tree")), "following": leaf_set(F.col("next_tree"))})
    return e.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("tree"), F.col("root")).alias("fingerprint"),
        fingerprint(F.col("edited_tree"), F.col("edited_root")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("own"), F.col("edited_root"), F.col("changed")).alias("near_edited"),
        likeness(F.col("root"), F.col("own"), F.col("next_root"), F.col("following")).alias("near_next"),
    )
