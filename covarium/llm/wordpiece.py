"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it. When a character can't extend the current
node, the automaton takes that node's failure link: the node reached after the greedy pieces of the text read so far are popped. How many pieces each link
pops is computed with the trie, so a word costs one step for each character and each link, never more than two for each character, and no piece is built.

An empty piece may begin a word: where no longer piece does, it counts as one and the word goes on at the inner root. The blank alone of a byte-level vocabulary
is such a piece, so no word is unknown there. Without it, a word with a part that no piece covers counts as one unknown token, as greedy word-piece tokenizers count it.

Defined results: null and empty texts have no words and no tokens; very long words are linear; every row is counted alone; extra columns pass through
(one named `n_words`, `n_tokens` or `n_unknown` is replaced).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame

from covarium.llm.bpe import byte_letters
from covarium.llm.common import WordCache, append

#: Pops of a failure link that leads nowhere: the word has no segmentation.
DEAD = -1


class Automaton:
    """`initial`: pieces that begin a word, among them perhaps the empty one; `inner`: pieces that continue it. Both as bytes."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]
        self.piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for p in pieces:
                node = root
                for b in p:
                    nxt = self.edges[node].get(b)
                    if nxt is None:
                        nxt = self.edges[node][b] = len(self.edges)
                        self.edges.append({})
                        self.piece.append(False)
                    node = nxt
                if p or root == 0:
                    self.piece[node] = True
        self.link = [DEAD] * len(self.edges)
        self.pops = [0] * len(self.edges)
        self._links()
        self.count = WordCache(self.walk).__getitem__

    def _links(self) -> None:
        """Breadth first. A node that is a piece pops it whole and goes on at the inner root; another node follows its parent's links until the last character fits."""
        if self.piece[0]:
            self.link[0], self.pops[0] = 1, 1
        todo = deque((0, b, n) for b, n in self.edges[0].items())
        todo.extend((1, b, n) for b, n in self.edges[1].items())
        while todo:
            parent, b, node = todo.popleft()
            if self.piece[node]:
                self.link[node], self.pops[node] = 1, 1
            else:
                at, popped = self.link[parent], self.pops[parent]
                while at != DEAD and b not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at != DEAD:
                    self.link[node], self.pops[node] = self.edges[at][b], popped
            todo.extend((node, c, n) for c, n in self.edges[node].items())

    def walk(self, word: bytes) -> int:
        """Number of greedy pieces of the word; 0 if it has none (unknown)."""
        edges, link, pops = self.edges, self.link, self.pops
        node = n = 0
        for b in word:
            while (nxt := edges[node].get(b)) is None:
                n += pops[node]
                node = link[node]
                if node == DEAD:
                    return 0
            node = nxt
        while node != 1:
            n += pops[node]
            node = link[node]
            if node == DEAD:
                return 0
        return n


def pieces_of(spec: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces from a byte-level vocabulary file: tokens with a leading blank begin a word, the others continue one."""
    letters = byte_letters()
    tokens = [bytes(letters[c] for c in t) for t in json.loads(spec)["model"]["vocab"]]
    return [t[1:] for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "]


@lru_cache(4)
def automaton(spec: str) -> Automaton:
    return Automaton(*pieces_of(spec))


def _count(texts: list[bytes], spec) -> list[list[int]]:
    a = automaton(spec.value)
    n_words, n_tokens, n_unknown = [], [], []
    for t in texts:
        got = list(map(a.count, t.split()))
        bad = got.count(0)
        n_words.append(len(got))
        n_tokens.append(sum(got) + bad)
        n_unknown.append(bad)
    return [n_words, n_tokens, n_unknown]


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """`df` with n_words, n_tokens (an unknown word counts as one) and n_unknown. The vocabulary file is of a fixed size and is broadcast."""
    from covarium.llm.bpe import _spec

    return append(df, [text_col], _count, "n_words long, n_tokens long, n_unknown long", drop=drop, args=(df.sparkSession.sparkContext.broadcast(_spec(path)),))


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), drop=("text",))
