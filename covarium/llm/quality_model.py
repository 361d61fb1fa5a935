"""Quality classifier: a sparse rule ensemble.

Small boosted trees are grown over document statistics; every path from a root to a node becomes a conjunctive rule; a logistic model with an L1 penalty picks
a few rules and gives them weights; and what is left is compiled into one Spark column expression over the statistics, which scores every document in the JVM.

Statistics cover the whole text. Labels are read only for the rows that `training` lets through; no label, language, source or id is a statistic. The fit uses at most
`SAMPLE` labelled documents (those with the smallest hashes of their ids: a fixed sample, whatever the partitions), so what reaches the driver is bounded
by SAMPLE rows of numbers; scoring covers all rows.

Defined results: a null or empty text has statistics of zero and gets a score like any other; rows with an equal text get equal scores; with no labelled rows,
or labels of one kind, the score is the smoothed share of label 1 for all; a label that is null or not 0 or 1 is not used; repeated labels count once, and of several
texts with one id one is learned from; extra columns do not take part, and columns named as a statistic are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import append, crc_fold, labelled
from covarium.llm.rules import repeat_words

SAMPLE = 20_000
TREES, DEPTH, BINS, MIN_LEAF = 24, 3, 24, 5
LAMBDAS = 12
THRESHOLD = 0.5

STATS = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "bang_share", "bare_symbol_words", "dup_line_share",
    "distinct_share", "repeat_share", "stay_share", "mean_line_words", "letter_word_share", "marked_word_share",
)

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>{}[]^~_=\\"
_PUNCT = b".,;:!?'\"()-"
_BLANK = b" \t\n\x0b\x0c\r"


def statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    joined = b"".join(words)
    size = len(joined)
    without = lambda chars: (size - len(joined.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    bare = sum(not w.strip(_SYMBOL) for w in words)
    marked = sum(w[-1:] in b"#*$%&|<>!" and len(w) > 1 for w in words)
    letters = sum(w.strip(_SYMBOL + _PUNCT + _DIGIT) != b"" for w in words)
    stay = sum(a == b for a, b in zip(words, words[1:]))
    return (
        float(np.log1p(n)), size / n, without(_SYMBOL), without(_UPPER), without(_DIGIT), without(_PUNCT), without(b"!"), bare / n, 1 - len(set(lines)) / len(lines),
        len(set(words)) / n, repeat_words(words) / n, stay / n, n / len(lines), letters / n, marked / n,
    )


def _stats(texts: list[bytes]) -> list:
    return list(zip(*[statistics(t) for t in texts], strict=True))


def with_statistics(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    return append(df, [text_col], _stats, ", ".join(f"{s} double" for s in STATS), drop=drop)


# ---------------------------------------------------------------- rules from boosted trees

#: A rule: (statistic, is_above, cut), ... ; a value is above a cut if it is greater.
Rule = tuple[tuple[int, bool, float], ...]


def cuts_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points between the quantiles of each column."""
    out = []
    for col in x.T:
        v = np.unique(col)
        if len(v) > bins:
            v = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule]) -> np.ndarray:
    """Values of one regression tree's leaves for `rows`; the paths to all its nodes go to `out`."""
    value = np.full(len(rows), -grad[rows].sum() / (hess[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 2 * MIN_LEAF:
        return value
    g, h = grad[rows], hess[rows]
    base, best = g.sum() ** 2 / (h.sum() + 1), (1e-6, None)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = binned[rows, j]
        gl, hl = np.cumsum(np.bincount(b, g, len(cut) + 1))[:-1], np.cumsum(np.bincount(b, h, len(cut) + 1))[:-1]
        n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
        gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), (j, k))
    if best[1] is None:
        return value
    j, k = best[1]
    above = binned[rows, j] > k
    for side in (False, True):
        step = (*path, (j, side, float(cuts[j][k])))
        out.append(step)
        value[above == side] = grow(binned, cuts, grad, hess, rows[above == side], depth - 1, step, out)
    return value


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = cuts_of(x)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(1, len(y) * 7 // 10), replace=False))
        found: list[Rule] = []
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        grow(binned, cuts, grad, hess, rows, DEPTH, (), found)
        if not found:
            break
        leaves = [r for r in found if not any(len(q) > len(r) and q[: len(r)] == r for q in found)]
        for r in leaves:
            m = holds(r, x)
            score[m] += 0.3 * -grad[m].sum() / (hess[m].sum() + 1)
        rules += found
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


# ---------------------------------------------------------------- lasso


def lasso(m: np.ndarray, y: np.ndarray, lam: float, w: np.ndarray, b: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients."""
    n = len(y)
    full = np.concatenate([m, np.ones((n, 1))], axis=1)
    lip = float(np.linalg.eigvalsh(full.T @ full)[-1]) / n / 4
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(m @ v + c, -30, 30))) - y
        w2 = v - m.T @ r / n / lip
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - lam / lip, 0)
        b2 = c - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        if np.abs(w2 - w).max(initial=0) < 1e-5 and abs(b2 - b) < 1e-5:
            w, b = w2, b2
            break
        w, b, t = w2, b2, t2
    return w, float(b)


class Ensemble:
    """The fitted rules. `column()` compiles them into Spark."""

    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * holds(r, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for j, above, cut in r:
                c = F.col(f"`{STATS[j]}`") > F.lit(cut)
                cond = cond & (c if above else ~c)
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[tuple[float, str]]:
        text = lambda r: " and ".join(f"{STATS[j]} {'>' if a else '<='} {c:.4g}" for j, a, c in r)
        return sorted(((w, text(r)) for r, w in zip(self.rules, self.weights, strict=True)), reverse=True)


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from trees, then the lasso path from strong to weak penalties; the penalty is the strongest whose loss on a fifth of the rows is within a hundredth of the best."""
    pos = int(y.sum())
    prior = float(np.log((pos + 1) / (len(y) - pos + 1)))
    if pos in (0, len(y)):
        return Ensemble([], [], prior)
    rules = extract_rules(x, y)
    if not rules:
        return Ensemble([], [], prior)
    m = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    m, first = np.unique(m, axis=1, return_index=True)
    rules = [rules[i] for i in first]
    test = np.arange(len(y)) % 5 == 4
    top = np.abs(m[~test].T @ (y[~test] - y[~test].mean())).max() / max(1, (~test).sum())
    lams = [top * 0.5**k for k in range(1, LAMBDAS + 1)]
    losses = []
    w, b = np.zeros(m.shape[1]), prior
    for lam in lams:
        w, b = lasso(m[~test], y[~test], lam, w, b)
        p = np.clip(1 / (1 + np.exp(-np.clip(m[test] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        losses.append(float(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))) if test.any() else -lam)
    pick = next(i for i, v in enumerate(losses) if v <= min(losses) + 0.01)
    w, b = np.zeros(m.shape[1]), prior
    for lam in lams[: pick + 1]:
        w, b = lasso(m, y, lam, w, b)
    keep = np.abs(w) > 1e-4
    return Ensemble([r for r, k in zip(rules, keep, strict=True) if k], w[keep].tolist(), b)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y, text): at most `sample` labelled rows among those allowed, by the smallest hashes of their ids."""
    return labelled(docs, labels, label, allowed, sample)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 1, folds: int = 3) -> Ensemble:
    rows = with_statistics(training_rows(docs, labels, label, crc_fold("doc_id", folds) != fold), drop=("text",)).toPandas()
    rows = rows.sort_values(["doc_id", "y", *STATS]).reset_index(drop=True)
    return fit(rows[list(STATS)].to_numpy(float), rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row."""
    s = with_statistics(docs.select(F.col(id_col), F.col("text").alias("text")), drop=("text",))
    return s.select(id_col, model.column().alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents, labels

    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, labels(spark, sf_dir)))
    held = crc_fold("doc_id", 3) == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
