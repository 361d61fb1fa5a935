"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is read in overlapping windows of `WINDOW` words, a new one every `STRIDE` words and a last one that ends with the text. Each word gives word inputs (how much more
often it occurs in toxic training documents, and a learned vector of its hash) and character inputs (the same for its character 4- to 6-grams, pooled by
maximum, mean and share of strong ones, and a learned vector pooled over them). Two gated recurrent layers read a window from either end, attention pools their states into one
logit. A document's logit joins its highest window's and that of the highest window apart from it: one chance word makes one suspicious window, an insulting text several.
The weights of the two are fitted on the training documents.

Only whole documents have labels. So training alternates: each toxic document lends the window that the model so far finds most toxic, each other
document its two most suspicious windows and one by chance; then the network is trained on these windows.

The fit uses at most `SAMPLE` labelled documents of each label, those with the smallest hashes of their ids. None is left out for its length: a text longer than `TRAIN_CHARS`
lends passages that are spread evenly over it, so what reaches the driver is bounded. All documents are scored, all their windows. The evidence that a training document's own words
get leaves that document out, so that words which one document has alone teach nothing. The model is a few megabytes, whatever the corpus.

Defined results: a null or empty text, or one without words, scores 0; shorter texts than a window are one window; a last window repeats words of the one before
it; with no toxic or no other training documents the score is the share of toxic ones for all texts with words; equal texts score alike, whatever their batch, up to
rounding at the sixth digit; repeated labels count once, and of several texts with one id one is learned from; extra columns do not take part, and one named `score` is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import append, crc_fold, labelled

WINDOW, STRIDE = 24, 12
SAMPLE = 1500
#: Characters that a training text lends, whatever its label, and those of one passage of a longer one.
TRAIN_CHARS = 100_000
PASSAGE = 2_000
GRAMS = (4, 5, 6)
HIDDEN, LEARNED = 12, 6
#: The least logit of a second window that counts.
APART = -8.0
#: One of so many training documents is kept from the network that the scale is fitted with.
FOLDS = 4
WORD_BITS, GRAM_BITS, LEARNED_BITS = 18, 20, 10
CHANNELS = 4
STRONG = 0.5
THRESHOLD = 0.7
CHUNK = 2048

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_EDGE = b".,;:!?\"'()[]{}#*$%&|<>-_~"
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- words and their hashes


class Hashes:
    """Hashes of a list of distinct words: one for each word, and those of its character n-grams with the number of the word."""

    def __init__(self, words: list[bytes]):
        marked = b"\x01" + b"\x02\x03\x01".join(words) + b"\x02\x03"  # so every word has a 4-gram
        size = np.fromiter(map(len, words), np.int64, len(words)) + 3
        start = np.cumsum(size) - size
        b = np.frombuffer(marked, np.uint8).astype(np.uint64)
        wid = np.repeat(np.arange(len(words)), size)
        with np.errstate(over="ignore"):
            place = (np.arange(len(b)) - start[wid]).astype(np.uint64)
            mixed = (b + np.uint64(1)) * (_ODD * (np.uint64(2) * place + np.uint64(1)))
            mixed ^= mixed >> np.uint64(31)
            self.word = (np.add.reduceat(mixed * _ODD, start) * _ODD) >> np.uint64(64 - WORD_BITS)
            self.grams: list[tuple[np.ndarray, np.ndarray]] = []
            code = b
            for n in range(2, GRAMS[0]):
                code = code[:-1] | b[n - 1 :] << np.uint64(8 * (n - 1))
            for n in GRAMS:
                if len(b) < n:
                    break
                code = code[: len(b) - n + 1] | b[n - 1 :] << np.uint64(8 * (n - 1))
                ok = wid[: len(b) - n + 1] == wid[n - 1 :]
                h = ((code[ok] + np.uint64(n)) * _ODD) >> np.uint64(64 - GRAM_BITS)
                self.grams.append((wid[: len(b) - n + 1][ok], h.astype(np.int64)))
        self.word = self.word.astype(np.int64)
        self.n = len(words)


def fold_words(text: bytes) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in text.translate(_FOLD).split()]


def z_scores(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How surely a feature is more frequent in toxic documents: the two-proportion z value, squashed."""
    p = (pos + neg) / max(1, n_pos + n_neg)
    se = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1, n_pos) + 1 / max(1, n_neg)))
    z = np.where(pos + neg > 0, (pos / max(1, n_pos) - neg / max(1, n_neg)) / se, 0)
    return np.tanh(z / 8).astype(np.float32)


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters are float32 arrays in `p`; axis 0 of the recurrent ones is the direction."""

    def __init__(self, d: int, h: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[-1])).astype(np.float32)
        self.h = h
        self.p = {
            "W": init(2, d, 3 * h), "U": init(2, h, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "c": np.zeros((2, 1, h), np.float32),
            "v": init(2, h), "w": init(2, h), "o": np.zeros(1, np.float32),
            "EW": 0.1 * rng.standard_normal((1 << LEARNED_BITS, LEARNED)).astype(np.float32), "EC": 0.1 * rng.standard_normal((1 << LEARNED_BITS, LEARNED)).astype(np.float32),
        }

    def logits(self, gates: np.ndarray, idx: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Window logits without keeping what training needs. gates: (2, words, 3h), each word's input to the gates; idx: (T, B) words; mask: (T, B) or None if all are there."""
        h, (t_max, n) = self.h, idx.shape
        u, c, vw = self.p["U"], self.p["c"], np.stack([self.p["v"], self.p["w"]], axis=-1)
        state = np.zeros((2, n, h), np.float32)
        seen = np.zeros((2, t_max, n, 2), np.float32)
        g = np.empty((2, n, 3 * h), np.float32)
        for t in range(t_max):
            back = t_max - 1 - t
            np.take(gates[0], idx[t], axis=0, out=g[0])
            np.take(gates[1], idx[back], axis=0, out=g[1])
            hu = state @ u
            zr = g[..., : 2 * h] + hu[..., : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            m = hu[..., 2 * h :]
            m += c
            m *= zr[..., h:]
            m += g[..., 2 * h :]
            np.tanh(m, out=m)
            new = state - m
            new *= zr[..., :h]
            new += m
            if mask is not None:
                new = np.where(np.stack([mask[t], mask[back]])[..., None], new, state)
            state = new
            out = state @ vw
            seen[0, t], seen[1, back] = out[0], out[1]
        s = seen.sum(axis=0)
        att = s[..., 0] if mask is None else np.where(mask, s[..., 0], -1e9)
        a = np.exp(att - att.max(axis=0))
        return (a * s[..., 1]).sum(axis=0) / a.sum(axis=0) + self.p["o"][0]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the weighted log loss, the gradient of x, and the logits. x: (T, B, d)."""
        h, p = self.h, self.p
        t_max, n, d = x.shape
        xs = np.stack([x, x[::-1]])
        ms = np.stack([mask, mask[::-1]])[..., None]
        gx = (xs.reshape(2, t_max * n, d) @ p["W"] + p["b"]).reshape(2, t_max, n, 3 * h)
        state = np.zeros((2, n, h), np.float32)
        kept, hs = [], np.zeros((2, t_max, n, h), np.float32)
        for t in range(t_max):
            hu = state @ p["U"]
            z, r = _sigmoid(gx[:, t, :, :h] + hu[..., :h]), _sigmoid(gx[:, t, :, h : 2 * h] + hu[..., h : 2 * h])
            m = hu[..., 2 * h :] + p["c"]
            c = np.tanh(gx[:, t, :, 2 * h :] + r * m)
            kept.append((state, z, r, m, c))
            state = np.where(ms[:, t], c + z * (state - c), state)
            hs[:, t] = state
        own = np.stack([hs[0], hs[1, ::-1]])
        s = np.where(mask, np.einsum("ktbh,kh->tb", own, p["v"]), -1e9)
        q = np.einsum("ktbh,kh->tb", own, p["w"])
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a * q).sum(axis=0)
        logit = pooled + p["o"][0]
        dl = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        dq, ds = dl * a, dl * a * (q - pooled)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"][0] = dl.sum()
        g["w"], g["v"] = np.einsum("ktbh,tb->kh", own, dq), np.einsum("ktbh,tb->kh", own, ds)
        dh_own = dq[None, ..., None] * p["w"][:, None, None] + ds[None, ..., None] * p["v"][:, None, None]
        dhs = np.stack([dh_own[0], dh_own[1, ::-1]])
        carry = np.zeros((2, n, h), np.float32)
        dgx = np.zeros_like(gx)
        for t in range(t_max - 1, -1, -1):
            prev, z, r, m, c = kept[t]
            dh = dhs[:, t] + carry
            live = np.where(ms[:, t], dh, 0)
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (prev - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            dm = dc * r
            dhu = np.concatenate([dz, dr, dm], axis=-1)
            dgx[:, t] = np.concatenate([dz, dr, dc], axis=-1)
            g["U"] += prev.transpose(0, 2, 1) @ dhu
            g["c"] += dm.sum(axis=1, keepdims=True)
            carry = np.where(ms[:, t], live * z, dh) + dhu @ p["U"].transpose(0, 2, 1)
        flat = dgx.reshape(2, t_max * n, 3 * h)
        g["W"] = xs.reshape(2, t_max * n, d).transpose(0, 2, 1) @ flat
        g["b"] = flat.sum(axis=1, keepdims=True)
        dxs = (flat @ p["W"].transpose(0, 2, 1)).reshape(2, t_max, n, d)
        return g, dxs[0] + dxs[1, ::-1], logit


#: Weight decay by parameter.
DECAY = dict.fromkeys(("W", "U", "EW", "EC"), 1e-4)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():
            x = x * scale + DECAY.get(k, 0.0) * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


# ---------------------------------------------------------------- documents


class Model:
    """Evidence tables, network and scale (weights of a document's two windows, and bias); `share` alone if there was nothing to learn from."""

    def __init__(self, words: np.ndarray | None, grams: np.ndarray | None, net: Network | None, scale: tuple[float, float, float] = (1.0, 0.0, 0.0), share: float = 0.0):
        self.words, self.grams, self.net, self.scale, self.share = words, grams, net, scale, share

    def evidence(self, h: Hashes) -> np.ndarray:
        """(words, CHANNELS): the word's own evidence, and the maximum, the mean and the share of strong ones of its character n-grams'."""
        top = np.full(h.n, -1, np.float32)
        total, count, strong = np.zeros(h.n, np.float32), np.zeros(h.n, np.float32), np.zeros(h.n, np.float32)
        for wid, code in h.grams:
            if len(wid):
                first = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
                v = self.grams[code]
                strong[wid[first]] += np.add.reduceat((v > STRONG).astype(np.float32), first)
                top[wid[first]] = np.maximum(top[wid[first]], np.maximum.reduceat(v, first))
                total[wid[first]] += np.add.reduceat(v, first)
                count[wid[first]] += np.diff(np.append(first, len(wid)))
        return np.stack([self.words[h.word], top, total / np.maximum(count, 1), strong / np.maximum(count, 1)], axis=1)

    def inputs(self, h: Hashes, evidence: np.ndarray) -> np.ndarray:
        """(words, CHANNELS + 2 * LEARNED); where `evidence` has several rows for each word, one after all the others, so has the result."""
        wid, code = h.grams[0]
        first = np.flatnonzero(np.concatenate([[True], wid[1:] != wid[:-1]]))
        chars = np.add.reduceat(self.net.p["EC"][code & ((1 << LEARNED_BITS) - 1)], first, axis=0) / np.diff(np.append(first, len(wid)))[:, None]
        learned = np.concatenate([self.net.p["EW"][h.word & ((1 << LEARNED_BITS) - 1)], chars], axis=1)
        return np.concatenate([evidence, np.tile(learned, (len(evidence) // h.n, 1))], axis=1).astype(np.float32)

    def window_logits(self, docs: list[np.ndarray], h: Hashes, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, logit) of every window of documents given as arrays of word numbers, rows of `evidence`."""
        net = self.net
        gates = self.inputs(h, evidence) @ net.p["W"] + net.p["b"]
        who, start = windows(docs)
        out = np.zeros(len(who), np.float32)
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        offset = np.cumsum(sizes) - sizes
        long = sizes[who] >= WINDOW
        for rows, full in ((np.flatnonzero(long), True), (np.flatnonzero(~long), False)):
            for at in range(0, len(rows), CHUNK):
                r = rows[at : at + CHUNK]
                pos = start[r] + np.arange(WINDOW)[:, None]
                mask = None
                if not full:
                    mask = pos < sizes[who[r]]
                    pos = np.minimum(pos, sizes[who[r]] - 1)
                out[r] = net.logits(gates, flat[offset[who[r]] + pos], mask)
        return who, start, out

    def score(self, texts: list[bytes]) -> list[float]:
        split = [fold_words(t) for t in texts]
        if self.net is None:
            return [self.share if w else 0.0 for w in split]
        seen: dict[bytes, int] = {}
        docs = [np.fromiter((seen.setdefault(w, len(seen)) for w in s), np.int64, len(s)) for s in split]
        some = [i for i, d in enumerate(docs) if len(d)]
        out = np.zeros(len(texts))
        if some:
            h = Hashes(list(seen))
            first, second = two_highest(*self.window_logits([docs[i] for i in some], h, self.evidence(h)), len(some))
            a, b, c = self.scale
            out[some] = np.round(_sigmoid(np.clip(a * first + b * second + c, -30, 30)), 6)
        return out.tolist()


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all windows."""
    who, start = [], []
    for i, d in enumerate(docs):
        s = list(range(0, max(1, len(d) - WINDOW + 1), STRIDE))
        if len(d) > WINDOW and s[-1] != len(d) - WINDOW:
            s.append(len(d) - WINDOW)
        who += [i] * len(s)
        start += s
    return np.array(who, np.int64), np.array(start, np.int64)


def two_highest(who: np.ndarray, start: np.ndarray, z: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n documents the highest window's logit, and the highest of those that share no word with it (APART at least); where there is none, the document is one passage, whose logit counts for both."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, who, z)
    at = np.full(n, np.iinfo(np.int64).max)
    is_top = z == top[who]
    np.minimum.at(at, who[is_top], start[is_top])
    apart = np.abs(start - at[who]) >= WINDOW
    second = np.full(n, -np.inf)
    np.maximum.at(second, who[apart], z[apart])
    return top, np.maximum(np.where(np.isinf(second), top, second), APART)


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 5) -> Model:
    split = [fold_words(t) for t in texts]
    keep = [i for i, s in enumerate(split) if s]
    split, y = [split[i] for i in keep], np.asarray(y, np.float32)[keep]
    n_pos = int(y.sum())
    if n_pos in (0, len(y)):
        return Model(None, None, None, share=n_pos / max(1, len(y)))
    seen: dict[bytes, int] = {}
    docs = [np.fromiter((seen.setdefault(w, len(seen)) for w in s), np.int64, len(s)) for s in split]
    h = Hashes(list(seen))
    # evidence: in how many documents of either label a word or n-gram occurs
    words, grams = np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << GRAM_BITS))
    ends = [np.searchsorted(wid, np.arange(h.n + 1)) for wid, _ in h.grams]
    for d, label in zip(docs, y.astype(int), strict=True):
        u = np.unique(d)
        words[label, np.unique(h.word[u])] += 1
        codes = [code[np.concatenate([np.arange(e[i], e[i + 1]) for i in u])] for (_, code), e in zip(h.grams, ends, strict=True)]
        grams[label, np.unique(np.concatenate(codes))] += 1
    n_neg = len(y) - n_pos
    net = Network(CHANNELS + 2 * LEARNED, HIDDEN)
    model = Model(z_scores(words[1], words[0], n_pos, n_neg), z_scores(grams[1], grams[0], n_pos, n_neg), net)
    # a training document sees tables without itself: rows 0..n-1 for the others, rows n..2n-1 for toxic ones
    less = lambda t, label: z_scores(*np.maximum(t[::-1] - np.array([[label], [1 - label]]), 0), n_pos - label, n_neg - 1 + label)
    evidence = np.concatenate([Model(less(words, label), less(grams, label), net).evidence(h) for label in (0, 1)])
    docs = [d + h.n * int(label) for d, label in zip(docs, y, strict=True)]
    who, start = windows(docs)
    first = np.searchsorted(who, np.arange(len(docs) + 1))
    strength = np.array([float(np.maximum(evidence[docs[i][a : a + WINDOW], 0], evidence[docs[i][a : a + WINDOW], 1]).max()) for i, a in zip(who, start, strict=True)])
    spans = h, docs, y, who, start, first, strength, evidence, ends[0]
    # the scale is fitted on documents that a network of its own hasn't seen: what a network says of its own training documents is too sure
    rest = np.arange(len(docs)) % FOLDS == 0
    held = np.flatnonzero(rest)
    if 0 < y[held].sum() < len(held) and 0 < y[~rest].sum() < len(docs) - len(held):
        other = Model(model.words, model.grams, Network(CHANNELS + 2 * LEARNED, HIDDEN))
        seen_by = learn(other, *spans, np.flatnonzero(~rest), rounds, epochs, seed)
        one, two = two_highest(who, start, seen_by, len(docs))
        model.scale = scale(one[held], two[held], y[held])
        learn(model, *spans, np.arange(len(docs)), rounds, epochs, seed)
    else:
        model.scale = scale(*two_highest(who, start, learn(model, *spans, np.arange(len(docs)), rounds, epochs, seed), len(docs)), y)
    return model


def learn(model: Model, h: Hashes, docs: list[np.ndarray], y: np.ndarray, who: np.ndarray, start: np.ndarray, first: np.ndarray, strength: np.ndarray, evidence: np.ndarray, gram_ends: np.ndarray, use: np.ndarray, rounds: int, epochs: int, seed: int) -> np.ndarray:
    """Trains the model's network on windows of the documents `use`, and returns the logits of all windows of all documents."""
    net, rng = model.net, np.random.default_rng(seed)
    code, low = h.grams[0][1], (1 << LEARNED_BITS) - 1
    adam = Adam(net.p, 0.01)
    for _ in range(rounds):
        picked, target = [], []
        for i in use:
            own = np.arange(first[i], first[i + 1])
            best = own[np.argsort(-strength[own], kind="stable")]
            take = best[:1] if y[i] else np.unique(np.append(best[:2], rng.choice(own)))
            picked += take.tolist()
            target += [y[i]] * len(take)
        picked, target = np.array(picked), np.array(target, np.float32)
        share = np.where(target > 0, len(target) / (2 * target.sum()), len(target) / (2 * (len(target) - target.sum()))).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(picked))
            for at in range(0, len(order), 64):
                k = order[at : at + 64]
                size = np.minimum([len(docs[i]) for i in who[picked[k]]], WINDOW)
                mask = np.arange(WINDOW)[:, None] < size
                idx = np.zeros((WINDOW, len(k)), np.int64)
                for col, w in enumerate(picked[k]):
                    idx[: size[col], col] = docs[who[w]][start[w] : start[w] + WINDOW]
                uniq, back = np.unique(idx, return_inverse=True)
                own = uniq % h.n
                at_gram = np.concatenate([np.arange(gram_ends[i], gram_ends[i + 1]) for i in own])
                per = np.diff(gram_ends)[own]
                edge = np.cumsum(per) - per
                ec, ew = code[at_gram] & low, h.word[own] & low
                x = np.concatenate([evidence[uniq], net.p["EW"][ew], np.add.reduceat(net.p["EC"][ec], edge, axis=0) / per[:, None]], axis=1).astype(np.float32)
                g, dx, _ = net.step(x[back.reshape(idx.shape)], mask, target[k], share[k] / len(k))
                du = np.zeros_like(x)
                np.add.at(du, back.reshape(-1), dx.reshape(-1, x.shape[1]))
                np.add.at(g["EW"], ew, du[:, CHANNELS : CHANNELS + LEARNED])
                np.add.at(g["EC"], ec, np.repeat(du[:, CHANNELS + LEARNED :] / per[:, None], per, axis=0))
                adam.update(g)
        strength = model.window_logits(docs, h, evidence)[2]
    return strength


def scale(first: np.ndarray, second: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights (none below zero) and bias of a document's two windows: logistic regression by Newton's method with a small penalty, labels weighing by the
    root of their rarity, half-way between calibrated scores and equal labels; a weight that would be negative is left out."""
    share = np.sqrt(np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum()))))
    for use in ((0, 1), (0,)):
        x = np.stack([(first, second)[k] for k in use] + [np.ones(len(y))], axis=1)
        penalty = np.array([0.01] * len(use) + [1e-6])
        w = np.array([1.0] * len(use) + [0.0])
        for _ in range(200):
            p = _sigmoid(np.clip(x @ w, -30, 30))
            move = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (share * (p - y)) + penalty * w)
            move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
            w = w - move
            if np.abs(move).max() < 1e-8:
                break
        if len(use) == 1 or (w[:-1] >= 0).all():
            break
    return float(max(w[0], 1e-3)), float(w[1]) if len(use) == 2 else 0.0, float(w[-1])


def passages(text: Column, limit: int) -> Column:
    """The text if it has at most `limit` characters, else passages of PASSAGE characters, as many as the limit holds, spread evenly from its start to its end."""
    n = max(2, limit // PASSAGE)
    step = (F.length(text) - PASSAGE) / F.lit(float(n - 1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(PASSAGE)))
    return F.when(F.length(text) <= limit, text).otherwise(F.array_join(parts, " "))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y, text): at most `sample` documents of each label, and of each text at most TRAIN_CHARS characters."""
    rows = labelled(docs, labels, label, allowed, sample, (0,)).unionByName(labelled(docs, labels, label, allowed, sample, (1,)))
    return rows.withColumn("text", passages(F.col("text"), TRAIN_CHARS))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 1, folds: int = 3) -> Model:
    rows = training_rows(docs, labels, label, crc_fold("doc_id", folds) != fold).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.text))
    return fit([r.text.encode() for r in rows], np.array([r.y for r in rows], np.float32))


def _score(texts: list[bytes], model) -> list[list[float]]:
    out: list[float] = []
    for at in range(0, len(texts), 256):
        out += model.value.score(texts[at : at + 256])
    return [out]


def score(df: DataFrame, model: Model, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the column score."""
    return append(df, [text_col], _score, "score double", drop=drop, args=(df.sparkSession.sparkContext.broadcast(model),))


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents, labels

    docs = documents(spark, sf_dir)
    out = score(docs.select("doc_id", "text"), train(docs, labels(spark, sf_dir)), drop=("text",))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
