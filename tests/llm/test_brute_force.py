"""The queries of the learned operators and of token counts, every row of the smallest table, against slow and plain scorers over the fitted parameters."""

import math
import re

import numpy as np
import pytest

from covarium.llm import bpe, langid, quality_model, toxicity, wordpiece
from covarium.llm.common import documents, labels

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, D).select("doc_id", "text").collect()}


# ---------------------------------------------------------------- token counts


def test_token_counts_of_every_row(spark, texts):
    initial, inner = map(set, wordpiece.pieces_of(bpe._spec(None)))
    known = {}

    def pieces(word):
        w = word.encode()
        n, at, some = 0, 0, initial
        while at < len(w) or n == 0:
            k = next((k for k in range(min(len(w) - at, 64), -1, -1) if w[at : at + k] in some and (k or some is initial)), None)
            if k is None:
                return 0
            n, at, some = n + 1, at + k, inner
        return n

    got = {r.doc_id: r for r in wordpiece.query(spark, D).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = WORD.findall(t)
        n = [known.setdefault(w, pieces(w)) for w in words]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(n) + n.count(0), n.count(0))


# ---------------------------------------------------------------- quality


def slow_statistics(t):
    words = WORD.findall(t)
    if not words:
        return [0.0] * len(quality_model.STATS)
    n, chars = len(words), "".join(words)
    size = len(chars.encode())
    share = lambda p: len(re.findall(p, chars)) / size
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(n - 4)]
    often = {g for g in grams if grams.count(g) > 1} if n < 3000 else {g for g, c in __import__("collections").Counter(grams).items() if c > 1}
    hit = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    bare, punct = re.compile(r"^[#*$%&|<>{}\[\]^~_=\\]*$"), r"#*$%&|<>{}[]^~_=\.,;:!?'\"()-0123456789"
    return [
        math.log1p(n), size / n, share(r"[#*$%&|<>{}\[\]^~_=\\]"), share("[A-Z]"), share("[0-9]"), share(r"[.,;:!?'\"()-]"), share("!"), sum(bool(bare.match(w)) for w in words) / n, 1 - len(set(lines)) / len(lines),
        len(set(words)) / n, len(hit) / n, sum(a == b for a, b in zip(words, words[1:])) / n, n / len(lines), sum(any(c not in punct for c in w) for w in words) / n,
        sum(len(w.encode()) > 1 and w[-1] in "#*$%&|<>!" for w in words) / n,
    ]


def test_quality_scores_of_every_row(spark, texts):
    model = quality_model.train(documents(spark, D), labels(spark, D))
    got = {r.doc_id: r for r in quality_model.query(spark, D).collect()}
    assert set(got) == set(texts) and model.rules
    for i, t in texts.items():
        x = slow_statistics(t)
        z = model.bias + sum(w for r, w in zip(model.rules, model.weights, strict=True) if all((x[j] > cut) == above for j, above, cut in r))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), i
        assert got[i].predicted == int(got[i].score >= 0.5)


# ---------------------------------------------------------------- language


def slow_language(model, t):
    low = t.lower()
    if not any(c.isalpha() for c in t):
        return "und", 0.0
    b = low.encode()
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b)
    b = b" " + b" ".join(b.split()) + b" "
    x = np.zeros(langid.DIMS)
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for k in range(len(b) - n + 1):
            x[(int.from_bytes(b[k : k + n], "big") * salt % (1 << 32)) >> 20] += 1
    x = np.sqrt(x)
    x /= np.linalg.norm(x)
    m = [float(np.dot(x, w[:-1]) + w[-1]) for w in model.weights.T.astype(float)]
    top = m[: model.n_top]
    family = max(range(len(top)), key=lambda k: top[k])
    score = 1 / sum(math.exp(2 * (v - top[family])) for v in top)
    group = model.groups[family]
    votes = {g: [0, 0.0, 1.0] for g in group}
    for k, (a, c) in enumerate(model.pairs):
        if a in votes:
            z = m[model.n_top + k]
            p = 1 / (1 + math.exp(-4 * z))
            for g, v, q in ((a, z, p), (c, -z, 1 - p)):
                votes[g][0] += v > 0 or (v == 0 and g == c)
                votes[g][1] += v
                votes[g][2] = min(votes[g][2], q)
    best = max(group, key=lambda g: (votes[g][0], votes[g][1], -g))
    return model.langs[best], score * (votes[best][2] if len(group) > 1 else 1)


def test_languages_of_every_row(spark, texts):
    model = langid.train(documents(spark, D))
    got = {r.doc_id: r for r in langid.query(spark, D).collect()}
    assert set(got) == set(texts) and len(model.langs) > 2
    for i, t in texts.items():
        lang, score = slow_language(model, t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), i


def test_language_votes_that_tie(spark):
    """Three languages that beat each other in a circle: margins decide, then the code point."""
    low = np.zeros((langid.DIMS + 1, 3), np.float32)
    model = langid.Hierarchy(["aa", "bb", "cc"], [[0, 1, 2]], np.zeros((langid.DIMS + 1, 1), np.float32), [(0, 1), (1, 2), (0, 2)], low)
    for margins, want in (((0.1, 0.2, -0.9), "cc"), ((0.5, 0.5, -0.5), "aa"), ((0.1, 0.8, -0.2), "bb")):
        model.weights[-1, 1:] = margins
        assert model.predict(b"abc")[0] == want, margins
        assert slow_language(model, "abc")[0] == want
    empty = langid.predict(spark.createDataFrame([], "doc_id long, text string"), model)
    assert empty.count() == 0 and wordpiece.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- toxicity


def slow_window(net, x):
    """The logit of one window of inputs x (words, d), one step after the other."""
    h, p = net.h, {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for k, order in enumerate((range(len(x)), range(len(x) - 1, -1, -1))):
        s, out = np.zeros(h), [None] * len(x)
        for t in order:
            g, u = x[t] @ p["W"][k] + p["b"][k, 0], s @ p["U"][k]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            c = np.tanh(g[2 * h :] + r * (u[2 * h :] + p["c"][k, 0]))
            s = out[t] = z * s + (1 - z) * c
        states.append(out)
    att = [sum(float(states[k][t] @ p["v"][k]) for k in (0, 1)) for t in range(len(x))]
    val = [sum(float(states[k][t] @ p["w"][k]) for k in (0, 1)) for t in range(len(x))]
    a = np.exp(np.array(att) - max(att))
    return float((a * val).sum() / a.sum() + p["o"][0])


def slow_toxicity(model, t):
    words = [w.strip(toxicity._EDGE) or w for w in t.encode().translate(toxicity._FOLD).split()]
    if not words:
        return 0.0
    odd, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    inputs = {}
    low = (1 << toxicity.LEARNED_BITS) - 1
    for w in set(words):
        b = b"\x01" + w + b"\x02\x03"
        total = 0
        for i, c in enumerate(b):
            m = (c + 1) * (odd * (2 * i + 1) & mask) & mask
            total += ((m ^ m >> 31) * odd) & mask
        code = ((total & mask) * odd & mask) >> (64 - toxicity.WORD_BITS)
        grams = [[((int.from_bytes(b[i : i + n], "little") + n) * odd & mask) >> (64 - toxicity.GRAM_BITS) for i in range(len(b) - n + 1)] for n in toxicity.GRAMS]
        v = [float(model.grams[g]) for gs in grams for g in gs]
        chars = np.mean([model.net.p["EC"][g & low].astype(float) for g in grams[0]], axis=0)
        inputs[w] = np.concatenate([[model.words[code], max(v), np.mean(v), np.mean([x > toxicity.STRONG for x in v])], model.net.p["EW"][code & low], chars])
    size, step = toxicity.WINDOW, toxicity.STRIDE
    starts = list(range(0, max(1, len(words) - size + 1), step))
    if len(words) > size and starts[-1] != len(words) - size:
        starts.append(len(words) - size)
    z = [slow_window(model.net, np.stack([inputs[w] for w in words[s : s + size]])) for s in starts]
    top = int(np.argmax(z))
    apart = [v for v, s in zip(z, starts, strict=True) if abs(s - starts[top]) >= size]
    a, b, c = model.scale
    return 1 / (1 + math.exp(-(a * z[top] + b * max(max(apart, default=z[top]), toxicity.APART) + c)))


def test_toxicity_of_every_row(spark, texts):
    model = toxicity.train(documents(spark, D), labels(spark, D))
    got = {r.doc_id: r for r in toxicity.query(spark, D).collect()}
    assert set(got) == set(texts) and model.net is not None
    for i, t in texts.items():
        if len(t) < 20_000:  # the plain scorer takes one word after the other; longer texts differ in nothing but their number of windows
            assert got[i].score == pytest.approx(slow_toxicity(model, t), abs=2e-4), i
        assert got[i].predicted == int(got[i].score >= toxicity.THRESHOLD)
