"""Operators on whole texts, each against a brute-force version or an installed public library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from covarium.llm import bpe, merkle, mixing, rules, simhash, substring, wordpiece

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " ", "\n\n", "a", "a b c", "word " * 300, "<|endoftext|>x<|endoftext|>", "naïve Größe ñandú 日本語 　x y", "it's 123 we'll\t\n  tabs \x85 \x1c z", "x" * 3000, "A b\r\nC d\x0bE", "é" * 200 + "!!! ???"]


def table(spark, texts, **extra):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")


def prose(rng, n, vocab=60):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_bpe_matches_the_public_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = EDGE + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(300)) for _ in range(40)]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, texts))).collect()}
    assert got[0].n_words == 5
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids, (i, x)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
    both = {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(table(spark, texts)).collect()}
    assert both == {i: (r.ids, r.decoded) for i, r in got.items()}


def test_bpe_pre_tokenizer_on_every_character():
    from tokenizers import pre_tokenizers

    c = bpe.Codec(bpe._spec(None))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    bad = []
    for lo in range(0, 0x110000, 0x40):
        chars = [chr(x) for x in range(lo, lo + 0x40) if not 0xD800 <= x < 0xE000]
        text = "".join(f"a{x}1{x}!{x} {x}" for x in chars)
        if c.cut_words(text) != [text[a:b] for _, (a, b) in split(text)]:
            bad.append(hex(lo))
    assert not bad, bad[:40]


def test_bpe_long_words_equal_short_ones():
    c = bpe.codec(bpe._spec(None))
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choice("abethr ionś") for _ in range(rng.randrange(2, 120)))
        assert c.merge(w) == c.merge_long([c.first[b] for b in w.encode()])


def test_token_counts_match_greedy_longest_match(spark):
    rng = random.Random(3)
    initial = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(14)}
    inner = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 4))) for _ in range(8)}
    a = wordpiece.Automaton(initial, inner)

    def greedy(w):
        n, at = 0, 0
        while at < len(w):
            size = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in (inner if at else initial)), 0)
            if not size:
                return 0
            n, at = n + 1, at + size
        return n

    for _ in range(5000):
        w = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        assert a.walk(w) == greedy(w), w
    got = {r.doc_id: r for r in wordpiece.count_tokens(table(spark, EDGE).drop("n_words")).collect()}
    assert (got[0].n_words, got[0].n_tokens) == (0, 0) and got[5].n_words == 3 and got[6].n_words == 300


def test_token_counts_on_the_public_vocabulary():
    spec = bpe._spec(None)
    initial, inner = map(set, wordpiece.pieces_of(spec))
    a = wordpiece.automaton(spec)
    rng = random.Random(4)
    for _ in range(500):
        w = "".join(rng.choice("thernadoisßé") for _ in range(rng.randrange(1, 20))).encode()
        n, at = 0, 0
        while at < len(w):
            size = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in (inner if at else initial)), 0)
            if not size:
                n = 0
                break
            n, at = n + 1, at + size
        assert a.walk(w) == n


def slow_rules(t):
    words = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    c = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in t), len(lines), len(lines) - len(set(lines)), len(hit), sum(bool(re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) for w in words)


def test_quality_rules(spark):
    rng = random.Random(5)
    texts = EDGE + [prose(rng, rng.randrange(200), rng.choice([2, 5, 60])).replace(" w1 ", "\n#w1*\n") for _ in range(60)] + [" ".join(f"u{i}" for i in range(9000)) + " u1 u2 u3 u4 u5 u6"]
    got = {r.doc_id: r for r in rules.ledger(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.n_letter_words) == slow_rules(t or ""), i
    kept = rules.filter_documents(table(spark, texts))
    assert kept.columns == ["doc_id", "text", "source", "n_words"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.failed & rules.POLICIES[rules.PRODUCTION] == 0}
    ab = {r["rule"]: r for r in rules.ablations(rules.ledger(table(spark, texts))).collect()}
    assert ab["few_words"].n_failed == sum(r.failed & 1 > 0 for r in got.values()) and ab["few_words"].n_only == sum(r.failed == 1 for r in got.values())
    assert rules.ledger(table(spark, []).limit(0)).count() == 0


def slow_substring(docs, window):
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window", [4, 10, 50])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    shared = [prose(rng, rng.randrange(window - 2, 3 * window), 500) for _ in range(6)]
    texts = list(EDGE)
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, window), 500 if window > 4 else 4)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared).split()
            parts += [" ".join(s[rng.randrange(3) : len(s) - rng.randrange(3)])] * rng.randrange(1, 3) + [prose(rng, rng.randrange(3), 500)]
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21], texts[21]]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove(table(spark, texts).drop("n_words"), window).collect()}
    assert got == slow_substring(docs, window)


def test_substring_dedup_edges(spark):
    t = table(spark, EDGE)
    assert substring.remove(t.drop("n_words").limit(0)).count() == 0
    twice = t.union(t)
    assert substring.clean_documents(twice).columns == t.columns and substring.clean_documents(twice).count() == 2 * t.count()
    long = spark.createDataFrame([(i, prose(random.Random(9), 150, 999) + f" end{i}") for i in range(3)], "doc_id long, text string")
    levels = {r.length: r.n_documents for r in substring.longest_repeats(long).collect()}
    assert levels == {50: 2, 100: 2}


def slow_clusters(texts, radius=4):
    fps = {}
    for i, t in enumerate(texts):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = SPACE.findall(w)
        sh = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return fps, slow_components(fps, radius)


def slow_components(fps, radius):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_simhash_components(spark):
    rng = random.Random(6)
    texts = list(EDGE)
    for _ in range(12):
        base = prose(rng, rng.randrange(1, 120), 400).split()
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            w[rng.randrange(len(w))] = "Changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    fps, comp = slow_clusters(texts)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.cluster(table(spark, texts)).collect()}
    assert got == {i: (fps[i], comp[i]) for i in fps}
    assert simhash.cluster(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [10**6, 20])
def test_trie_join_finds_every_link(spark, group_rows):
    """Random fingerprints with planted neighbours, chains and one dense ball; small groups force the descent in the cluster."""
    rng = random.Random(group_rows)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(4):
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    ball = rng.getrandbits(64)
    for _ in range(150):
        f = ball
        for _ in range(3):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    exp = slow_components(dict(enumerate(fps)), 4)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df, 4, group_rows)).collect()}
    groups, mine = defaultdict(set), defaultdict(set)
    for i, f in enumerate(fps):
        groups[exp[i]].add(f)
        mine[roots.get(f, ("alone", f))].add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_mixing_edges(spark):
    t = table(spark, EDGE)
    rows, sources = mixing.plan(t)
    assert {r.none for r in sources.collect()} == {True, False}
    assert mixing.mix(t).columns == t.columns
    assert mixing.mix(t.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, "a b", None), (1, "a b", None), (2, None, "x")], "doc_id long, text string, source string")
    assert mixing.mix(nulls).count() == 3  # the equal rows are one unit, too large for what is left
    taken = {r.doc_id: r["count"] for r in mixing.mix(t).groupBy("doc_id").count().collect()}
    assert max(taken.values()) <= 2


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice("abcdefgh" if i % 3 else "a")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    goal, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        goal |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if goal[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2 * size[s]
            left -= goal[s]
        open_ -= over
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r.source] += len(r.text.split())
    for s in size:
        assert abs(got[s] - goal[s]) <= 30, (s, got[s], goal[s])
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def slow_tree(t):
    x = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)

    def fold(xs):
        h = 42
        for v in xs:
            h = x(v.to_bytes(8, "little"), h)
        return h

    hexa = lambda v: f"{v:X}"
    out, nodes, leaves = [], [], set()
    for s in t.split("\n\n"):
        ps = []
        for p in s.split("\n"):
            ls = [x(m.encode()) for m in re.findall(merkle.LEAF_RE, p)]
            leaves |= set(ls)
            ps.append((fold(ls), ls))
        nodes.append(fold([p[0] for p in ps]))
        out.append(f"{hexa(nodes[-1])}:" + ",".join(f"{hexa(p)}=" + ".".join(map(hexa, ls)) for p, ls in ps))
    r = hashlib.md5(".".join(map(hexa, nodes)).encode()).hexdigest()
    return f"{r}|" + ";".join(out), leaves


def test_merkle_fingerprints(spark):
    rng = random.Random(7)
    texts = EDGE + [prose(rng, rng.randrange(1, 200)).replace(" w3 ", ". ").replace(" w5 ", "\n").replace(" w7 ", "\n\n") for _ in range(30)]
    ids = rng.sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    for k, at in enumerate(order):
        t, nxt = texts[at] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        r = got[ids[at]]
        (f, a), (g, b), (h, c) = slow_tree(t), slow_tree(e), slow_tree(nxt)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g)
        dice = lambda p, q, u, v: 1.0 if p[:32] == q[:32] else 2 * len(u & v) / (len(u) + len(v)) if u or v else 0.0
        assert r.near_edited == pytest.approx(dice(f, g, a, b)) and r.near_next == pytest.approx(dice(f, h, a, c))
    plan = merkle.fingerprints(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
    a, b = got[ids[20]].fingerprint, got[ids[20]].edited_fingerprint
    assert merkle.differing(a, a) == [] and (a == b or merkle.differing(a, b))


def test_merkle_edges(spark):
    schema = "doc_id long, text string"
    assert merkle.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = merkle.fingerprints(spark.createDataFrame([(3, "only one. text")], schema)).first()
    assert one.near_next == 1.0
    same = merkle.fingerprints(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None), (2, "")], schema)).collect()
    assert len(same) == 4 and same[0] is not None
    assert len({r.fingerprint for r in same if r.doc_id == 1}) == 1
