"""Recursive graph bisection: an order of documents in which those that share terms stand together.

Documents and terms are a bipartite graph. A set of documents is split into halves, and pairs of documents are swapped between the halves as long as that lowers the cost of the terms' gaps,

    sum over terms of a * log2(|left| / (a + 1)) + b * log2(|right| / (b + 1)),    a, b: documents with the term on either side,

then each half is split in its turn. That is done on a bounded sample, over hashed terms. A node of the tree then keeps, for each hashed term, what it costs more to put a document with that term to the left than to
the right; every document, sampled or not, descends by the sum over its terms, so all are ordered by one rule, in one pass, whatever their number. The order has no influence on what a search finds, only on how
much of the index it must visit.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np

#: Hashed terms, levels of the tree, rounds of swaps at each level.
BUCKETS, DEPTH, ROUNDS = 8192, 6, 12


def bucket(term: bytes) -> int:
    return crc32(term) % BUCKETS


def _cost(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return a * np.log2(left / (a + 1)) + b * np.log2(right / (b + 1))


@dataclass
class Bisection:
    """`more`: a row for each inner node of the tree, in heap order from 1, a column for each bucket. `cut`: above it, a document goes right."""

    more: np.ndarray
    cut: np.ndarray

    def leaves(self, start: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The leaf of each document, from the left; buckets[start[i]:start[i + 1]] are the distinct buckets of document i."""
        n = len(start) - 1
        owner = np.repeat(np.arange(n), np.diff(start))
        node = np.ones(n, np.int64)
        for _ in range(int(np.log2(len(self.cut)))):
            side = np.bincount(owner, self.more[node[owner], buckets], n) > self.cut[node]
            node = 2 * node + side
        return node - len(self.cut)


def fit(start: np.ndarray, buckets: np.ndarray, depth: int = DEPTH) -> Bisection:
    """Bisects the documents given by their distinct buckets, all nodes of a level together."""
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    more, cut = np.zeros((1 << depth, BUCKETS), np.float32), np.zeros(1 << depth)
    node = np.ones(n, np.int64)
    for level in range(depth):
        first, size = 1 << level, 1 << level
        at = node - first
        order = np.argsort(at, kind="stable")
        count = np.bincount(at, minlength=size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        side = 2 * place >= count[at]
        for _ in range(ROUNDS):
            left, right = np.bincount(at[~side], minlength=size), np.bincount(at[side], minlength=size)
            cell = at[owner] * BUCKETS + buckets
            a, b = (np.bincount(cell[m], minlength=size * BUCKETS) for m in (~side[owner], side[owner]))
            own, other = np.where(side[owner], b[cell], a[cell]), np.where(side[owner], a[cell], b[cell])
            mine, theirs = (np.maximum(1, np.where(side[owner], x[at[owner]], y[at[owner]])) for x, y in ((right, left), (left, right)))
            gain = np.bincount(owner, _cost(own, other, mine, theirs) - _cost(own - 1, other + 1, mine, theirs), n)
            swapped = 0
            for k in range(size):
                here = np.flatnonzero(at == k)
                l, r = (x[np.argsort(-gain[x], kind="stable")] for x in (here[~side[here]], here[side[here]]))
                m = min(len(l), len(r))
                good = int((gain[l[:m]] + gain[r[:m]] > 1e-9).sum())  # gains fall, so these come first
                side[l[:good]], side[r[:good]] = True, False
                swapped += good
            if not swapped:
                break
        left, right = (np.maximum(1, np.bincount(at[m], minlength=size))[:, None] for m in (~side, side))
        cell = at[owner] * BUCKETS + buckets
        a, b = (np.bincount(cell[m], minlength=size * BUCKETS).reshape(size, BUCKETS) for m in (~side[owner], side[owner]))
        more[first : 2 * first] = _cost(a + 1, b, left, right) - _cost(a, b + 1, left, right)
        sums = np.bincount(owner, more[node[owner], buckets], n)
        for k in range(size):
            here = np.flatnonzero(at == k)
            cut[first + k] = np.median(sums[here]) if len(here) else 0.0
        node = 2 * node + (sums > cut[node])
    return Bisection(more, cut)
