"""Training of the grouped skip-gram model in synchronous rounds over a sharded table of parameters.

A word is predicted from z = [word + its n-grams ; mean of patient tokens ; mean of encounter tokens] through a projection h = W z and hierarchical softmax over a Huffman tree.

Parameters are a table (matrix, row, vec). A round gives each of `tasks` tasks `chunk_size` lines; what a task needs, the vocabulary entries of its words, their rows, tree nodes and n-grams, comes to it by joins, so
a task holds the rows it touches and no more, and neither the driver nor a broadcast holds the model. Every task descends over its own lines; the rows that it changed are dealt out by (matrix, row) to the tasks that own
them, which add them up and write the next table: a sparse row moves by the mean over the tasks that changed it, a dense one by the mean over all tasks that had lines. So the number of rounds is that of the lines
divided by those of all tasks together. What a round's tasks need doesn't depend on the epoch and is written once.

Within a task, lines are worked off `batch` at a time with matrix products: centres meet all tree nodes of their contexts at once, in tiles of at most `CELLS` pairs of a centre and a node, whatever a line's length. The
nodes' rows are as old as the batch; a node that many pairs of a batch visit takes a shortened step, as one solved for at its end would be. A batch of one line is nearest to a sequential trainer.
Batches are counted from a task's first line, in whatever pieces its lines arrive: a batch larger than a piece adds up its moves and makes them once it is full.

All draws (initial values, windows, subsampling, which task gets a line) are integer hashes of stable numbers, so they depend neither on partitions nor on batches, a task that is run again after a lost executor gives
the same differences, and other engines can state them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.functions.hashing import ngram_buckets_many, portable_int
from covarium.operators import huffman
from covarium.operators.ranking import dense_index
from covarium.operators.vocabulary import GROUPS, discard_prob, stacked, token_counts, vocabularies
from covarium.session import checkpoint_dir, delete, materialize, release, ship
from covarium.sources.corpus import counting_samples, count_lines, training_samples
from covarium.sources.model_store import Model

SPARSE, DENSE = ("output", "input", "ngram"), ("W_proj", "patient", "encounter")
NAMES = SPARSE + DENSE
CLAMP, EPS = 20.0, 1e-7
#: Pairs of a centre and a node that are worked off at once.
CELLS = 1 << 22
#: Vocabularies of up to so many tokens are sent to the tasks that number the lines' tokens; larger ones are joined.
SENT_TOKENS = 1 << 20

@dataclass
class Config:
    d_word: int = 150
    d_patient: int = 30
    d_encounter: int = 15
    d_out: int = 150
    epoch: int = 5
    lr: float = 0.05
    min_n: int = 3
    max_n: int = 8
    threshold: int = 5
    subsample: float = 1e-4
    grad_clip: float = 1.0
    weight_decay: float = 0.0
    ngram_buckets: int = 2_000_000
    window_size: int = 5
    #: Lines of one task in one round: a round is a Spark job, so it is larger than a shared-memory trainer's chunk.
    chunk_size: int = 50_000
    #: Lines whose centres are worked off together.
    batch: int = 16
    seed: int = 42
    #: 'reference': the step size enters twice on the way back to the inputs; 'standard': once.
    lr_mode: str = "reference"
    #: Whether lines that don't parse count towards the step-size schedule, as they do in `reference` mode.
    count_bad_lines: bool = False
    ngram_mode: str = "byte"
    #: Tasks of a round; 0: as many as the cluster runs at a time. Results depend on it, not on where tasks run.
    tasks: int = 0
    #: 'single' or 'double' numbers in training; a model's tables are single.
    precision: str = "single"

    @property
    def dtype(self) -> type:
        return np.float64 if self.precision == "double" else np.float32

    @property
    def columns(self) -> dict[str, int]:
        return {"output": self.d_out, "input": self.d_word, "ngram": self.d_word, "W_proj": self.d_word + self.d_patient + self.d_encounter, "patient": self.d_patient, "encounter": self.d_encounter}


def clip(v: np.ndarray, limit: float) -> np.ndarray:
    n = float(np.sqrt((v * v).sum()))
    return v * (limit / n) if limit > 0 and n > limit else v


def learning_rate(lr0: float, step: int, total: int) -> float:
    return max(lr0 * 1e-4, lr0 * (1 - step / max(1, total)))


def learning_rate_at(lr0: float, step: Column, total: Column) -> Column:
    """`learning_rate` as a column."""
    return F.greatest(F.lit(lr0 * 1e-4), F.lit(lr0) * (1 - step / F.greatest(F.lit(1), total)))


# Odd multipliers of the draws and of the finalizer that mixes them.
MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
FINAL = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def draws(seed: int, epoch: int, sample: np.ndarray, pos: np.ndarray, use: np.ndarray | int) -> np.ndarray:
    """Unsigned 64-bit draws. `use` is 0 for whether a centre is skipped, 1 for its window, 2 + o for whether the context at position o is."""
    with np.errstate(over="ignore"):
        x = np.uint64((seed << 20) + epoch) * np.uint64(MULT[0]) + sample.astype(np.uint64) * np.uint64(MULT[1]) + pos.astype(np.uint64) * np.uint64(MULT[2]) + np.asarray(use).astype(np.uint64) * np.uint64(MULT[3])
        for m, r in ((FINAL[0], 30), (FINAL[1], 27)):
            x = (x ^ (x >> np.uint64(r))) * np.uint64(m)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


#: Stands for the epoch in the draws of initial values; the matrix's number is added.
INIT = 1 << 19


def initial(cfg: Config, name: str, rows: np.ndarray) -> np.ndarray:
    """Gaussian values of these rows, by two draws and the Box-Muller transform, scaled by one over the square root of a row's length (d_out for the projection)."""
    width = cfg.columns[name]
    at = np.asarray(rows, np.int64)[:, None], np.arange(width)[None, :]
    u, v = (unit(draws(cfg.seed, INIT + NAMES.index(name), *at, k)) for k in (0, 1))
    return (np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v) / np.sqrt(cfg.d_out if name == "W_proj" else width)).astype(cfg.dtype)


class Params:
    """The rows of a task, or of a small model, as arrays; which rows they are, the lexicon knows."""

    def __init__(self, cfg: Config, n_words: int, n_patient: int, n_encounter: int, buckets: np.ndarray):
        sizes = {"output": max(1, n_words - 1), "input": n_words, "W_proj": cfg.d_out, "patient": n_patient, "encounter": n_encounter}
        for k in NAMES:
            setattr(self, k, initial(cfg, k, buckets if k == "ngram" else np.arange(sizes[k])))

    def copy(self) -> Params:
        new = object.__new__(Params)
        new.__dict__ = {k: v.copy() for k, v in self.__dict__.items()}
        return new


class Lexicon:
    """What training needs to know of words, as arrays: paths and n-grams of all words one after the other, with where each word's begin. `grams` are places in `buckets`."""

    def __init__(self, start: np.ndarray, path: np.ndarray, code: np.ndarray, gram_start: np.ndarray, grams: np.ndarray, discard: np.ndarray):
        self.path_start, self.path, self.target = start, path, (1 - code).astype(np.float32)
        self.gram_start, self.discard = gram_start, discard
        self.buckets, self.grams = np.unique(grams, return_inverse=True)

    def paths(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `path`, row of `words`) of all nodes above the words."""
        return spans(self.path_start, words)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spans(self.gram_start, words)


def spans(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[r]..start[r + 1] - 1 of all rows r, one after the other, and the number of the row that each belongs to."""
    size = start[rows + 1] - start[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[rows][owner], owner


def pairs_of(lex: Lexicon, cfg: Config, epoch: int, sample: np.ndarray, start: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, word) of the centres that aren't skipped, and (centre, context word) of the pairs. ids: the words of all lines, -1 outside the vocabulary; start: where each line begins."""
    line = np.repeat(np.arange(len(sample)), np.diff(start))
    pos = np.arange(len(ids)) - start[line]
    at = np.flatnonzero(ids >= 0)
    at = at[unit(draws(cfg.seed, epoch, sample[line[at]], pos[at], 0)) >= lex.discard[ids[at]]]
    reach = 1 + (draws(cfg.seed, epoch, sample[line[at]], pos[at], 1) % np.uint64(cfg.window_size)).astype(np.int64)
    step = np.array([o for o in range(-cfg.window_size, cfg.window_size + 1) if o])
    other = at[:, None] + step
    ok = (np.abs(step) <= reach[:, None]) & (other >= start[line[at]][:, None]) & (other < start[line[at] + 1][:, None])
    centre, k = np.nonzero(ok)
    other = other[centre, k]
    known = ids[other] >= 0
    centre, other = centre[known], other[known]
    stays = unit(draws(cfg.seed, epoch, sample[line[at[centre]]], pos[at[centre]], 2 + pos[other])) >= lex.discard[ids[other]]
    return line[at], ids[at], centre[stays], ids[other[stays]]


def _mean(m: np.ndarray, start: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The mean row of each line's tokens, zero where a line has none."""
    size = np.diff(start)
    out = np.zeros((len(size), m.shape[1]), m.dtype)
    if len(tokens):
        some = np.flatnonzero(size)
        out[some] = np.add.reduceat(m[tokens], start[some], axis=0) / size[some][:, None]
    return out


def _add_rows(m: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> None:
    """m[rows[i]] += moves[i], repeats included."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        m[rows[first]] += np.add.reduceat(moves[order], first, axis=0)


def tiles(visits: np.ndarray, nodes: int) -> Iterator[tuple[int, int]]:
    """Ranges of centres with at most CELLS pairs of a centre and a node (one centre at least), given how many nodes each centre visits and how many there are."""
    ends, a = np.concatenate([[0], np.cumsum(visits)]), 0
    while a < len(visits):
        b = len(visits)
        while b - a > 1 and (b - a) * min(int(ends[b] - ends[a]), nodes) > CELLS:
            b = a + (b - a) // 2
        yield a, b
        a = b


def batch_moves(p: Params, lex: Lexicon, cfg: Config, lr: float, group: tuple, line: np.ndarray, word: np.ndarray, centre: np.ndarray, context: np.ndarray) -> tuple[float, int, dict]:
    """What lines of a batch move, from the rows as they are: (loss, predictions, (rows, moves) by matrix, where rows may repeat and None is all rows). `short`: by how much the steps of tree nodes are shortened.

    group: (start, tokens) of the patient and of the encounter tokens of each line; centre: rising places in `word`.
    """
    if not len(centre):
        return 0.0, 0, {}
    kind = p.output.dtype
    (ps, pt), (es, et) = group
    own, of = np.unique(word, return_inverse=True)
    at, owner = lex.grams_of(own)
    grams = lex.grams[at]
    vec = p.input[own]
    if len(grams):
        some, first = np.unique(owner, return_index=True)
        vec[some] += np.add.reduceat(p.ngram[grams], first, axis=0)
    means = [_mean(p.patient, ps, pt), _mean(p.encounter, es, et)]
    mid = cfg.d_word + cfg.d_patient
    back = kind.type(lr if cfg.lr_mode == "reference" else 1.0)
    begin = np.searchsorted(centre, np.arange(len(word) + 1))
    depth = (lex.path_start[1:] - lex.path_start[:-1])[context]
    parts = list(tiles(np.add.reduceat(np.append(depth, 0), begin[:-1]) * (begin[1:] > begin[:-1]), len(p.output)))
    whole = None if len(parts) == 1 else (np.zeros_like(p.output), np.zeros(len(p.output), kind))  # moves of all nodes, and by how much their steps are shortened
    moved, turn = np.zeros((len(own), cfg.d_word), kind), np.zeros_like(p.W_proj)
    lines = [np.zeros_like(m) for m in means]
    loss, preds = 0.0, 0
    for a, b in parts:
        here, pairs = slice(a, b), slice(begin[a], begin[b])
        z = np.concatenate([vec[of[here]], *[m[line[here]] for m in means]], axis=1)
        h = z @ p.W_proj.T
        at, pair = lex.paths(context[pairs])
        nodes, node = np.unique(lex.path[at], return_inverse=True)
        cell = (centre[pairs][pair] - a) * len(nodes) + node
        shape = (b - a, len(nodes))
        visits = np.bincount(cell, minlength=shape[0] * shape[1]).astype(kind).reshape(shape)
        ones = np.bincount(cell, lex.target[at], shape[0] * shape[1]).astype(kind).reshape(shape)
        rows = p.output[nodes]
        s = 1 / (1 + np.exp(-np.clip(h @ rows.T, -CLAMP, CLAMP)))
        up, down = lr * (1 - s), -lr * s
        grad = (ones * up + (visits - ones) * down) @ rows
        sure = np.clip(s, EPS, 1 - EPS)
        loss -= float((ones * np.log(sure)).sum(dtype=float) + ((visits - ones) * np.log1p(-sure)).sum(dtype=float))
        preds += int(visits.sum(dtype=float))
        size = np.sqrt((h * h).sum(axis=1, keepdims=True))
        if cfg.grad_clip > 0:  # each visit's move is clipped by itself
            up = up * np.minimum(1, cfg.grad_clip / np.maximum(up * size, 1e-30))
            down = down * np.minimum(1, cfg.grad_clip / np.maximum(-down * size, 1e-30))
        move = (ones * up + (visits - ones) * down).T @ h
        short = lr * ((visits * s * (1 - s)).T @ (size * size))[:, 0] if cfg.batch > 1 else np.zeros(len(nodes), kind)
        if whole is None:
            whole = move, short, nodes
        else:
            whole[0][nodes] += move
            whole[1][nodes] += short
        if cfg.grad_clip > 0:
            grad *= np.minimum(1, cfg.grad_clip / np.maximum(np.sqrt((grad * grad).sum(axis=1, keepdims=True)), 1e-30))
        q = back * (grad @ p.W_proj)
        turn += back * (grad.T @ z)
        _add_rows(moved, of[here], q[:, : cfg.d_word])
        for out, part in zip(lines, (q[:, cfg.d_word : mid], q[:, mid:]), strict=True):
            _add_rows(out, line[here], part)
    move, short, *nodes = whole
    nodes = nodes[0] if nodes else None
    found = {"output": (nodes, move), "short": (nodes, short), "W_proj": (None, turn), "input": (own, moved), "ngram": (grams, moved[owner])}
    for name, start, tokens, per_line in (("patient", ps, pt, lines[0]), ("encounter", es, et, lines[1])):
        count = np.diff(start)
        found[name] = tokens, np.repeat(per_line / np.maximum(count, 1)[:, None], count, axis=0)
    return loss, preds, found


class Batch:
    """The batch that lines are being added to. Its moves are made when it is full, so neither tiles nor pieces show in the result."""

    def __init__(self, p: Params, size: int):
        self.p, self.size, self.lines = p, size, 0
        self.one: dict = {}
        self.all: dict = {}

    def add(self, found: dict, lines: int) -> None:
        """Moves of so many more lines."""
        self.lines += lines
        if found and not (self.one or self.all):
            self.one = found
        elif found:
            if not self.all:
                self.all = {k: np.zeros_like(getattr(self.p, k)) for k in NAMES} | {"short": np.zeros(len(self.p.output), self.p.output.dtype)}
                self._sum(self.one)
                self.one = {}
            self._sum(found)
        if self.lines >= self.size:
            self.make()

    def _sum(self, found: dict) -> None:
        for k, (rows, moves) in found.items():
            if rows is None:
                self.all[k] += moves
            else:
                _add_rows(self.all[k], rows, moves)

    def make(self) -> None:
        found = self.one or {k: (None, v) for k, v in self.all.items()}
        self.one, self.all, self.lines = {}, {}, 0
        if not found:
            return
        found["output"][1][:] /= (1 + found.pop("short")[1])[:, None]
        for k, (rows, moves) in found.items():
            m = getattr(self.p, k)
            if rows is None:
                m += moves
            else:
                _add_rows(m, rows, moves)


def train_batch(p: Params, lex: Lexicon, cfg: Config, lr: float, group: tuple, line: np.ndarray, word: np.ndarray, centre: np.ndarray, context: np.ndarray) -> tuple[float, int]:
    """One whole batch in place; returns (loss, predictions). See `batch_moves`."""
    loss, preds, found = batch_moves(p, lex, cfg, lr, group, line, word, centre, context)
    Batch(p, 0).add(found, 0)
    return loss, preds


def train_lines(p: Params, lex: Lexicon, cfg: Config, epoch: int, lr: float, sample: np.ndarray, words: tuple, patient: tuple, encounter: tuple, batch: Batch | None = None) -> tuple[float, int]:
    """All of these lines, batch by batch; returns (loss, predictions). Tokens come as (start, numbers) of all lines. `batch`: the one that earlier lines left open, and that later ones may fill; without it the last batch ends here."""
    line, word, centre, context = pairs_of(lex, cfg, epoch, sample, *words)
    loss, preds, a = 0.0, 0, 0
    now = batch or Batch(p, cfg.batch)
    while a < len(sample):
        b = min(a + cfg.batch - now.lines, len(sample))
        c0, c1 = np.searchsorted(line, (a, b))
        p0, p1 = np.searchsorted(centre, (c0, c1))
        part = [(s[a : b + 1] - s[a], t[s[a] : s[b]]) for s, t in (patient, encounter)]
        x, y, found = batch_moves(p, lex, cfg, lr, part, line[c0:c1] - a, word[c0:c1], centre[p0:p1] - c0, context[p0:p1])
        now.add(found, b - a)
        loss, preds, a = loss + x, preds + y, b
    if batch is None:
        now.make()
    return loss, preds


# ---------------------------------------------------------------- what is known before the first round


def _flat(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(start, values) of a list column."""
    start = column.offsets.to_numpy().astype(np.int64)
    return start - start[0] if len(start) else np.zeros(1, np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _list(start: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(flat, kind))


def entries(words: DataFrame, cfg: Config) -> DataFrame:
    """(key, a, b, c, x): of each word its number, path, code, buckets of n-grams and the probability that it is skipped. `words` has codes."""
    total = words.agg(F.sum("freq").cast("double").alias("_total"))
    rows = words.join(F.broadcast(total)).withColumn("x", discard_prob(F.col("freq"), F.col("_total"), cfg.subsample))  # one row on the right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, grams = ngram_buckets_many(b.column(1).to_pylist(), cfg.min_n, cfg.max_n, cfg.ngram_buckets, cfg.ngram_mode)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), _list(start, grams, pa.int32()), b.column(4)], names=["key", "a", "b", "c", "x"])

    ship(words.sparkSession)
    return rows.select("idx", "token", "path", "code", "x").mapInArrow(run, "key long, a array<int>, b array<int>, c array<int>, x double")


def numbered(samples: DataFrame, vocabs: dict[str, DataFrame], tokens: int) -> DataFrame:
    """(sample, a, b, c): the lines with numbers in place of words (-1 outside the vocabulary), patient and encounter tokens. `tokens`: how many the vocabularies have together."""
    spark = samples.sparkSession
    if tokens <= SENT_TOKENS:
        got = stacked({g: v.select("token", "idx") for g, v in vocabs.items()}).toArrow()
        known: dict[str, dict[str, int]] = {g: {} for g in GROUPS}
        for g, token, i in zip(*[got[c].to_pylist() for c in ("group_name", "token", "idx")], strict=True):
            known[g][token] = i
        sent = spark.sparkContext.broadcast([known[g] for g in GROUPS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [b.column(0)]
                for i, known in enumerate(sent.value, 1):
                    start = b.column(i).offsets.to_numpy()
                    out.append(_list(start - start[:1], np.fromiter((known.get(t, -1) for t in b.column(i).flatten().to_pylist()), np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(out, names=["sample", "a", "b", "c"])

        empty = F.array().cast("array<string>")
        return samples.select("sample", *[F.coalesce(c, empty).alias(c) for c in ("words", "patient", "encounter")]).mapInArrow(run, "sample long, a array<int>, b array<int>, c array<int>")
    out = samples.select("sample")
    for name, column, g in zip("abc", ("words", "patient", "encounter"), GROUPS, strict=True):
        tokens = samples.select("sample", F.posexplode(column).alias("pos", "token")).join(vocabs[g].select("token", "idx"), "token", "left")
        lists = tokens.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(-1)).cast("int").alias("idx")))).alias("l"))
        out = out.join(lists.select("sample", F.transform("l", lambda x: x["idx"]).alias(name)), "sample", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    return out


def slot(cfg: Config, slots: int) -> Column:
    """Which task of which round gets a line."""
    return F.pmod(portable_int(F.concat_ws("-", F.lit(f"slot-{cfg.seed}"), F.col("sample").cast("string"))), F.lit(slots))


def needs(lines: DataFrame, lexicon: DataFrame, cfg: Config) -> DataFrame:
    """(round, task, matrix, row): the rows that each task touches."""
    at = ["round", "task"]
    pick = lambda df, name, row: df.select(*at, F.lit(NAMES.index(name)).alias("matrix"), row.alias("row"))
    known = lambda c: F.explode(F.filter(F.col(c).cast("array<bigint>"), lambda x: x >= 0))
    out = pick(lexicon, "input", F.col("key")).unionByName(pick(lexicon, "output", known("a"))).unionByName(pick(lexicon, "ngram", known("c")))
    out = out.unionByName(pick(lines, "patient", known("b"))).unionByName(pick(lines, "encounter", known("c")))
    return out.unionByName(pick(lines.select(*at).distinct(), "W_proj", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.d_out - 1).cast("bigint"))))).distinct()


def first_params(spark: SparkSession, cfg: Config, sizes: dict[str, int], words: DataFrame) -> DataFrame:
    """The parameters before training; n-gram rows only for buckets that words of the vocabulary touch."""
    keys = words.select(F.lit(NAMES.index("ngram")).alias("matrix"), F.explode(F.col("c").cast("array<bigint>")).alias("row")).distinct()
    for k, n in sizes.items():
        keys = keys.unionByName(spark.range(n).select(F.lit(NAMES.index(k)).alias("matrix"), F.col("id").alias("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix, rows = (b.column(i).to_numpy() for i in (0, 1))
            for m in np.unique(matrix).tolist():
                yield _rows(m, rows[matrix == m], initial(cfg, NAMES[m], rows[matrix == m]))

    ship(spark)
    return keys.mapInArrow(run, f"matrix int, row long, {_vec(cfg)}")


def _vec(cfg: Config) -> str:
    return "vec array<double>" if cfg.precision == "double" else "vec array<float>"


def _rows(matrix: int, rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    vec = _list(np.arange(len(rows) + 1) * values.shape[1], np.ascontiguousarray(values).reshape(-1), pa.from_numpy_dtype(values.dtype))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), matrix, np.int32)), pa.array(rows, pa.int64()), vec], names=["matrix", "row", "vec"])


def _none(cfg: Config) -> pa.RecordBatch:
    """One row without values under the matrix number after the last, for facts."""
    kind = pa.from_numpy_dtype(cfg.dtype)
    return pa.RecordBatch.from_arrays([pa.array([len(NAMES)], pa.int32()), pa.array([0], pa.int64()), _list(np.array([0, 0]), np.zeros(0, cfg.dtype), kind)], names=["matrix", "row", "vec"])


# ---------------------------------------------------------------- a round

#: Kinds of rows that come to a task, in this order: vocabulary entries, parameters (the matrix's number is added), lines.
ENTRY, PARAM, LINE = 0, 1, 9
#: Rows of one batch that a task sends.
SEND = 4096


class _Task:
    """What one task of a round holds."""

    def __init__(self, number: int, cfg: Config, epoch: int, lr: float):
        self.number, self.cfg, self.epoch, self.lr = number, cfg, epoch, lr
        self.entries, self.params, self.p = [], {}, None
        self.loss, self.preds, self.lines = 0.0, 0, 0
        self.batch = None  # open until it is full or the task's lines end

    def take(self, kind: int, b: pa.RecordBatch) -> None:
        key = b.column(2).to_numpy()
        if kind == ENTRY:
            self.entries.append((key, *[_flat(b.column(i)) for i in (3, 4, 5)], b.column(6).to_numpy()))
        elif kind < LINE:
            name = NAMES[kind - PARAM]
            self.params.setdefault(name, []).append((key, _flat(b.column(7), self.cfg.dtype)[1].reshape(len(key), -1)))
        else:
            self._learn(key, *[_flat(b.column(i)) for i in (3, 4, 5)])

    def _build(self) -> None:
        join = lambda parts: (np.concatenate([[0], *[s[1:] + o for (s, _), o in zip(parts, np.cumsum([0, *[len(v) for _, v in parts[:-1]]]), strict=True)]]).astype(np.int64), np.concatenate([v for _, v in parts]))
        none = (np.zeros(1, np.int64), np.zeros(0, np.int64))
        paths, codes, grams = (join([e[i] for e in self.entries]) if self.entries else none for i in (1, 2, 3))
        self.words = np.concatenate([e[0] for e in self.entries]) if self.entries else np.zeros(0, np.int64)
        skip = np.concatenate([e[4] for e in self.entries]) if self.entries else np.zeros(0)
        self.rows, self.p = {}, object.__new__(Params)
        for k in NAMES:
            got = self.params.pop(k, [])
            self.rows[k] = np.concatenate([r for r, _ in got]) if got else np.zeros(0, np.int64)
            setattr(self.p, k, np.concatenate([v for _, v in got]) if got else np.zeros((0, self.cfg.columns[k]), self.cfg.dtype))
        self.old, self.batch = self.p.copy(), Batch(self.p, self.cfg.batch)
        self.lex = Lexicon(paths[0], np.searchsorted(self.rows["output"], paths[1]), codes[1], grams[0], grams[1], skip)

    def _learn(self, sample: np.ndarray, words: tuple, patient: tuple, encounter: tuple) -> None:
        if self.p is None:
            self._build()
        ids = np.where(words[1] < 0, -1, np.searchsorted(self.words, words[1]))

        def known(tokens: tuple, rows: np.ndarray) -> tuple:
            start, v = tokens
            ok = v >= 0
            return np.concatenate([[0], np.cumsum(ok)])[start], np.searchsorted(rows, v[ok])

        loss, preds = train_lines(self.p, self.lex, self.cfg, self.epoch, self.lr, sample, (words[0], ids), known(patient, self.rows["patient"]), known(encounter, self.rows["encounter"]), self.batch)
        self.loss, self.preds, self.lines = self.loss + loss, self.preds + preds, self.lines + len(sample)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.p is None:
            return
        self.batch.make()
        yield self._with(_none(self.cfg), self.loss, self.preds, self.lines)
        for m, k in enumerate(NAMES):
            d = getattr(self.p, k) - getattr(self.old, k)
            some = np.flatnonzero(d.any(axis=1))
            for at in range(0, len(some), SEND):
                part = some[at : at + SEND]
                yield self._with(_rows(m, self.rows[k][part], d[part]), 0.0, 0, 0)

    def _with(self, b: pa.RecordBatch, loss: float, preds: int, lines: int) -> pa.RecordBatch:
        n = b.num_rows
        more = [pa.array(np.full(n, self.number, np.int32)), pa.array(np.full(n, loss)), pa.array(np.full(n, preds, np.int64)), pa.array(np.full(n, lines, np.int64))]
        return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "task", "loss", "preds", "lines"])


def run_round(lines: DataFrame, lexicon: DataFrame, needed: DataFrame, params: DataFrame, cfg: Config, epoch: int, lr: float, tasks: int) -> DataFrame:
    """(matrix, row, vec, task, loss, preds, lines): what each task changed, and one row of its facts, under a matrix number after the last."""
    ints, vec = F.lit(None).cast("array<int>"), F.lit(None).cast(_vec(cfg).split()[1])
    x = F.lit(None).cast("double")
    kind = lambda k: F.lit(k).alias("kind")
    rows = lexicon.select("task", kind(ENTRY), "key", "a", "b", "c", "x", vec.alias("vec"))
    rows = rows.unionByName(needed.join(params, ["matrix", "row"]).select("task", (F.col("matrix") + PARAM).alias("kind"), F.col("row").alias("key"), ints.alias("a"), ints.alias("b"), ints.alias("c"), x.alias("x"), "vec"))
    rows = rows.unionByName(lines.select("task", kind(LINE), F.col("sample").alias("key"), "a", "b", "c", x.alias("x"), vec.alias("vec")))
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            task, sort = (b.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (sort[1:] != sort[:-1]), [True]])) if len(task) else [0]
            for a, e in zip(cuts, cuts[1:]):
                if now is None or task[a] != now.number:
                    if now is not None:
                        yield from now.sent()
                    now = _Task(int(task[a]), cfg, epoch, lr)
                now.take(int(sort[a]), b.slice(a, e - a))
        if now is not None:
            yield from now.sent()

    return rows.repartition(tasks, "task").sortWithinPartitions("task", "kind", "key").mapInArrow(run, f"matrix int, row long, {_vec(cfg)}, task int, loss double, preds long, lines long")


#: What a round's table of parameters has beside them: the sums of loss and predictions since the epoch began, in rows of a matrix number after the last.
_FACTS = ("loss", "preds")


def moved(params: DataFrame, deltas: DataFrame, active: int, cfg: Config, facts: bool = False) -> DataFrame:
    """The parameters after a round: rows of sparse matrices move by the mean over the tasks that changed them, those of dense ones by the mean over the `active` tasks; then the projection decays.

    With `facts`, both tables have loss and preds, and so has the result: what the tasks report is added up in the same job, and nobody need ask for it after each round.
    """
    more = _FACTS if facts else ()
    if not facts:
        params, deltas = params.select("matrix", "row", "vec"), deltas.filter(F.col("matrix") < len(NAMES))
    rows = params.select("matrix", "row", F.lit(-1).alias("task"), "vec", *more).unionByName(deltas.select("matrix", "row", "task", "vec", *more))
    dense, shrink = [NAMES.index(k) for k in DENSE], 1 - cfg.weight_decay

    def with_facts(b: pa.RecordBatch, loss: float = 0.0, preds: int = 0) -> pa.RecordBatch:
        if not facts:
            return b
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, loss)), pa.array(np.full(b.num_rows, preds, np.int64))], names=[*b.schema.names, *_FACTS])

    def done(m: int, row: np.ndarray, base: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = base + sums / np.maximum(1, active if m in dense else n)[..., None]
        return with_facts(_rows(m, row, (new * shrink if NAMES[m] == "W_proj" else new).astype(cfg.dtype)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of a batch, which the next one may go on with
        for b in batches:
            matrix, row, task = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.concatenate([[True], matrix[1:] != matrix[:-1], [True]])) if len(matrix) else [0]
            for a, e in zip(cuts, cuts[1:]):
                m, r, own = int(matrix[a]), row[a:e], task[a:e] < 0
                if m == len(NAMES):
                    yield with_facts(_none(cfg), *[b.column(i).slice(a, e - a).to_numpy().sum() for i in (4, 5)])
                    continue
                v = _flat(b.column(3).slice(a, e - a), float)[1].reshape(e - a, -1)
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                base, sums, n = (np.add.reduceat(x, first, axis=0) for x in (v * own[:, None], v * ~own[:, None], (~own).astype(np.int64)))
                if held is not None:
                    if held[0] == m and held[1][0] == r[0]:
                        base[0], sums[0], n[0] = base[0] + held[2][0], sums[0] + held[3][0], n[0] + held[4][0]
                    else:
                        yield done(*held)
                keys = r[first]
                if len(keys) > 1:
                    yield done(m, keys[:-1], base[:-1], sums[:-1], n[:-1])
                held = m, keys[-1:], base[-1:], sums[-1:], n[-1:]
        if held is not None:
            yield done(*held)

    return rows.repartition("matrix", "row").sortWithinPartitions("matrix", "row", "task").mapInArrow(run, f"matrix int, row long, {_vec(cfg)}" + (", loss double, preds long" if facts else ""))


def health(params: DataFrame) -> list[tuple[str, int, int]]:
    """(matrix, NaN, infinite) of the matrices that have any."""
    bad = lambda test: F.sum(F.size(F.filter("vec", test)))
    got = params.groupBy("matrix").agg(bad(lambda x: F.isnan(x)).alias("nan"), bad(lambda x: F.abs(x.cast("double")) == float("inf")).alias("inf")).filter("nan > 0 OR inf > 0")
    return [(NAMES[r.matrix], r.nan, r.inf) for r in got.orderBy("matrix").collect()]  # one row for each matrix


def check_health(params: DataFrame, epoch: int) -> None:
    if bad := health(params):
        raise FloatingPointError("parameters are not finite after epoch %d: %s" % (epoch, "; ".join(f"{m}: {x} NaN, {y} infinite" for m, x, y in bad)))


@dataclass
class Trained:
    """vocabs: tables (idx, token, freq; words also code and path); params: (matrix number, row, vec); metrics: (epoch, avg_loss, predictions, seconds, lr) of each epoch."""

    vocabs: dict[str, DataFrame]
    params: DataFrame
    metrics: list[tuple]


def train(lines: DataFrame, cfg: Config, value: str = "value", key: str | None = None) -> Trained:
    """See `fit`."""
    spark = lines.sparkSession
    vocabs = vocabularies(materialize(token_counts(counting_samples(lines, value)), "counts"), cfg.threshold)
    others = materialize(stacked({g: vocabs[g] for g in GROUPS if g != "word"}), "groups")
    vocabs = {g: materialize(huffman.with_codes(v), g) if g == "word" else others.filter(F.col("group_name") == g).drop("group_name") for g, v in vocabs.items()}
    count = dict.fromkeys(GROUPS, 0) | {r.group_name: r["count"] for r in stacked({g: v.select("idx") for g, v in vocabs.items()}).groupBy("group_name").count().collect()}
    if not count["word"]:
        raise ValueError("the vocabulary is empty: no word reaches the threshold")
    words = materialize(entries(vocabs["word"], cfg), "entries")
    sizes = {"output": max(1, count["word"] - 1), "input": count["word"], "W_proj": cfg.d_out, "patient": count["patient"], "encounter": count["encounter"]}
    params = materialize(first_params(spark, cfg, sizes, words), "params")
    read = training_samples(lines, value)
    known = read.withColumn("sample", F.col(key).cast("long")) if key else dense_index(read, [F.xxhash64(value), F.col(value)], "sample")
    n, tasks = known.count(), cfg.tasks or spark.sparkContext.defaultParallelism
    rounds = max(1, -(-n // (cfg.chunk_size * tasks)))
    dealt = numbered(known, vocabs, sum(count.values())).withColumn("_slot", slot(cfg, rounds * tasks)).withColumns({"round": F.floor(F.col("_slot") / tasks).cast("int"), "task": F.pmod("_slot", F.lit(tasks)).cast("int")}).drop("_slot")
    folder = f"{checkpoint_dir(spark)}/covarium-{uuid.uuid4().hex}-rounds"

    def by_round(df: DataFrame, name: str) -> None:
        df.write.partitionBy("round").parquet(f"{folder}/{name}")

    by_round(dealt.repartition(tasks, "task"), "lines")
    dealt = spark.read.schema("sample long, a array<int>, b array<int>, c array<int>, task int, round int").parquet(f"{folder}/lines")
    used = dealt.select("round", "task", F.explode(F.filter(F.col("a").cast("array<bigint>"), lambda x: x >= 0)).alias("key")).distinct()
    by_round(used.join(words, "key").select("round", "task", "key", "a", "b", "c", "x").repartition("round", "task"), "lexicon")  # a file for each task, not one for each partition
    lexicon = spark.read.schema("task int, key long, a array<int>, b array<int>, c array<int>, x double, round int").parquet(f"{folder}/lexicon")
    by_round(needs(dealt, lexicon, cfg).repartition("round", "task"), "needs")
    needed = spark.read.schema("task int, matrix int, row long, round int").parquet(f"{folder}/needs")
    per_epoch = count_lines(lines.withColumnRenamed(value, "value")) if cfg.count_bad_lines else n
    total, step = cfg.epoch * per_epoch, 0
    # a round's tasks and lines are known before it, so no round waits for an answer about the last one
    about = {r.round: r for r in dealt.groupBy("round").agg(F.count_distinct("task").alias("active"), F.count(F.lit(1)).alias("lines")).collect()}  # one row for each round
    state = params.withColumns({"loss": F.lit(0.0), "preds": F.lit(0).cast("bigint")})
    metrics = []
    for epoch in range(cfg.epoch):
        began, lr = time.time(), cfg.lr
        for r in range(rounds if n else 0):
            lr = learning_rate(cfg.lr, step, total)
            part = [t.filter(F.col("round") == r) for t in (dealt, lexicon, needed)]
            deltas = run_round(*part, params, cfg, epoch, lr, tasks)
            old, state = params, materialize(moved(state, deltas, about[r].active if r in about else 0, cfg, True), "params")
            release(old)
            params = state.filter(F.col("matrix") < len(NAMES)).select("matrix", "row", "vec")
            params._covarium_path = state._covarium_path
            step += about[r].lines if r in about else 0
        check_health(params, epoch + 1)
        loss, preds = state.agg(*[F.sum(c) for c in _FACTS]).first()
        state = params.withColumns({"loss": F.lit(0.0), "preds": F.lit(0).cast("bigint")})
        metrics.append((epoch + 1, loss / preds if preds else 0.0, preds, time.time() - began, lr))
    delete(spark, folder)
    release(words)
    return Trained(vocabs, params, metrics)


def fit(lines: DataFrame, cfg: Config | None = None, value: str = "value", key: str | None = None) -> tuple[Model, DataFrame]:
    """Trains on corpus lines. Returns the model and one row of metrics for each epoch (epoch, avg_loss, predictions, seconds, lr).

    Raises ValueError on an empty vocabulary and FloatingPointError, naming all bad matrices, when parameters stop being finite.
    `key` names a whole-number column that tells lines apart and numbers them for the draws; without it lines are numbered by their text and repeats by chance of place.
    """
    cfg = cfg or Config()
    got = train(lines, cfg, value, key)
    names = F.array(*[F.lit(k) for k in NAMES])
    tables = got.params.select(F.element_at(names, F.col("matrix") + 1).alias("matrix"), F.col("row").alias("row_idx"), F.col("vec").cast("array<float>").alias("vec"))
    v = None
    empty = F.lit(None).cast("array<int>")
    for g, t in got.vocabs.items():
        if g != "word":
            t = t.withColumns({"code": empty, "path": empty})
        t = t.select(F.lit(g).alias("group_name"), "idx", "token", "freq", "code", "path")
        v = t if v is None else v.unionByName(t)
    out = lines.sparkSession.createDataFrame(got.metrics, "epoch int, avg_loss double, predictions long, seconds double, lr double")
    return Model(asdict(cfg), materialize(v, "vocab"), materialize(tables, "matrices")), out
