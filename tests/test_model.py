"""Composition, search, intervals, training, model files and the command line."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium import cli
from covarium.functions.hashing import ngram_buckets_many, ngram_buckets_py
from covarium.operators import compose, huffman, search, training, uncertainty
from covarium.sources import corpus, model_store


def toy(spark, seed=0, d=(6, 3, 2, 5), buckets=40):
    """(model, arrays): two patient and two encounter tokens, five words."""
    rng = np.random.default_rng(seed)
    dw, dp, de, do = d
    words, pats, encs = ["pain", "chest", "fever", "cough", "rash"], ["elderly", "male"], ["nurse", "icu"]
    a = {"output": rng.normal(size=(4, do)), "ngram": rng.normal(size=(buckets, dw)), "input": rng.normal(size=(5, dw)), "W_proj": rng.normal(size=(do, dw + dp + de)), "patient": rng.normal(size=(2, dp)), "encounter": rng.normal(size=(2, de))}
    a = {k: v.astype(np.float32) for k, v in a.items()}
    rows = [("word", i, w, 5 - i, [0, 1], [3, i % 3]) for i, w in enumerate(words)] + [("patient", i, w, 1, None, None) for i, w in enumerate(pats)] + [("encounter", i, w, 1, None, None) for i, w in enumerate(encs)]
    tables = None
    for k, v in a.items():
        t = model_store.matrix_table(spark, k, v)
        tables = t if tables is None else tables.unionByName(t)
    meta = {"d_word": dw, "d_patient": dp, "d_encounter": de, "d_out": do, "min_n": 3, "max_n": 5, "threshold": 1, "window_size": 5, "ngram_buckets": buckets}
    return model_store.Model(meta, spark.createDataFrame(rows, model_store.VOCAB), tables), a, (words, pats, encs)


def slow_vector(m, a, names, words, pat, enc):
    def raw(w):
        v = a["input"][names[0].index(w)].astype(float) if w in names[0] else np.zeros(m.meta["d_word"])
        return v + sum((a["ngram"][b].astype(float) for b in ngram_buckets_py(w, 3, 5, m.meta["ngram_buckets"])), np.zeros(m.meta["d_word"]))

    mean = lambda mat, known, toks: np.mean([mat[known.index(x)] for x in toks if x in known], axis=0) if any(x in known for x in toks) else np.zeros(mat.shape[1])
    w = sum((raw(x) for x in words), np.zeros(m.meta["d_word"])) / max(1, len(words))
    z = np.concatenate([w, mean(a["patient"], names[1], pat), mean(a["encounter"], names[2], enc)])
    h = a["W_proj"].astype(float) @ z
    n = np.linalg.norm(h)
    return h / n if n > 1e-8 else h


QUERIES = [(0, ["pain"], ["elderly", "male"], ["nurse"]), (1, ["pain", "unseen", "pain"], ["elderly", "elderly", "none"], []), (2, [], ["male"], ["icu", "nurse"]), (3, [], [], [])]


def frame(spark, rows=QUERIES):
    return spark.createDataFrame(rows, "qid long, words array<string>, patient array<string>, encounter array<string>")


def test_composed_vectors(spark):
    m, a, names = toy(spark)
    got = {r.qid: r.vec for r in compose.combined(frame(spark), m).collect()}
    for qid, w, p, e in QUERIES:
        assert got[qid] == pytest.approx(slow_vector(m, a, names, w, p, e), abs=1e-5)
    only = {r.qid: r.vec for r in compose.group_vector(frame(spark), m, ("patient",)).collect()}
    assert only[0] == pytest.approx(slow_vector(m, a, names, [], ["elderly", "male"], []), abs=1e-5)


def test_word_cache_and_search(spark):
    m, a, names = toy(spark)
    cache = {r.token: r for r in compose.word_cache(m).collect()}
    for w in names[0]:
        v = slow_vector(m, a, names, [w], [], [])
        assert np.array(cache[w].vec) / cache[w].norm == pytest.approx(v, abs=1e-5)
    q = slow_vector(m, a, names, ["pain"], ["male"], [])
    want = sorted(((-float(np.dot(q, np.array(r.vec)) / r.norm), r.idx) for r in cache.values()))
    got = search.nearest_one(q.tolist(), compose.word_cache(m), 3).collect()
    assert [r.idx for r in got] == [i for _, i in want[:3]]
    batch = search.nearest(compose.combined(frame(spark), m), compose.word_cache(m), 2).collect()
    assert {r.qid for r in batch} == {0, 1, 2} and len(batch) == 6
    assert search.nearest_one([0.0] * 5, compose.word_cache(m), 3).count() == 0
    plan = search.nearest_one(q.tolist(), compose.word_cache(m), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_ties_go_to_the_smaller_index(spark):
    c = spark.createDataFrame([(i, f"w{i}", [1.0, 0.0], 1.0) for i in range(6)], "idx long, token string, vec array<double>, norm double")
    assert [r.idx for r in search.nearest_one([2.0, 0.0], c, 3).collect()] == [0, 1, 2]
    assert search.nearest_one([2.0, 0.0], c, 0).count() == 1


def test_compare(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = search.compare(df).orderBy(F.col("cosine").desc_nulls_last()).collect()
    assert r[0].cosine == pytest.approx(0.70711, abs=1e-4) and r[0].distance == pytest.approx(1 - r[0].cosine) and r[0].label == "Moderately similar"
    assert r[1].cosine is None and r[1].label is None


def test_block_norms_and_health(spark):
    m, a, _ = toy(spark)
    got = {r.block: r.norm for r in compose.block_norms(m).collect()}
    assert got["word"] == pytest.approx(np.linalg.norm(a["W_proj"][:, :6]), rel=1e-5) and got["all"] == pytest.approx(np.linalg.norm(a["W_proj"]), rel=1e-5)
    bad = spark.createDataFrame([("x", 0, [1.0, float("nan")]), ("x", 1, [float("inf"), 2.0]), ("y", 0, [1.0])], model_store.MATRIX)
    assert {r.matrix: (r.n_values, r.n_nan, r.n_inf) for r in compose.matrix_health(bad).collect()} == {"x": (4, 1, 1), "y": (1, 0, 0)}


def test_percentiles_interpolate(spark):
    s = spark.createDataFrame([(i, "b", "t", v) for i, v in enumerate([0.5, 1.0, 2.0, 3.0, 10.0])], "replicate_id int, base string, target string, similarity double")
    r = uncertainty.formatted(uncertainty.intervals(s)).first()
    assert (r.similarity, r.lo, r.hi, r.n) == pytest.approx((0.5, 1.075, 9.475, 4)) and r.ci_text == "[1.0750, 9.4750]"
    assert uncertainty.formatted(uncertainty.intervals(s.filter("replicate_id = 0"))).first().ci_text == "N/A"


def test_ensemble_intervals(spark):
    models = {i: toy(spark, i)[0] for i in range(3)}
    b, t = frame(spark, [(0, ["chest", "pain"], ["male"], [])]), frame(spark, [(0, ["fever", "cough"], [], ["icu"]), (1, ["rash"], [], [])])
    r = uncertainty.ensemble_intervals(models, b, t).collect()
    assert [(x.base_label, x.target_label) for x in r] == [("chest pain male ", "fever  icu"), ("chest pain male ", "rash  ")]
    want = [np.dot(slow_vector(*toy(spark, i), ["chest", "pain"], ["male"], []), slow_vector(*toy(spark, i), ["rash"], [], [])) for i in range(3)]
    assert r[1].similarity == pytest.approx(want[0], abs=1e-5) and (r[1].lo, r[1].hi) == pytest.approx(tuple(np.percentile(want[1:], [2.5, 97.5])), abs=1e-5)


# ---------------------------------------------------------------- files


def test_binary_round_trip(spark, tmp_path, monkeypatch):
    m, a, names = toy(spark)
    blob = model_store.to_binary(m)
    assert struct.unpack("<8i", blob[:32]) == (6, 3, 2, 5, 3, 5, 1, 5) and struct.unpack("<5i", blob[32:52]) == (5, 2, 2, 40, 4)
    monkeypatch.setattr(model_store, "CHUNK", 100)  # many parts
    model_store.write_binary(m, str(tmp_path / "m.bin"))
    assert (tmp_path / "m.bin").read_bytes() == blob
    back = model_store.from_binary(spark, str(tmp_path / "m.bin"))
    for k, v in a.items():
        rows = {r.row_idx: r.vec for r in back.matrix(k).collect()}
        assert np.array([rows[i] for i in range(len(v))], np.float32) == pytest.approx(v)
    assert [r.token for r in back.words().orderBy("idx").collect()] == names[0]
    assert back.words().filter("idx = 2").first().path == [3, 2]
    assert model_store.to_binary(back) == blob


def test_parquet_round_trip_and_ensemble(spark, tmp_path):
    m, _, names = toy(spark)
    for n in ("m", "m_boot_1", "m_boot_2", "m_boot_4"):
        model_store.save(m, str(tmp_path / n))
    e = model_store.load_ensemble(spark, str(tmp_path), "m")
    assert sorted(e) == [0, 1, 2] and e[1].meta == m.meta
    assert {r.qid: r.vec for r in compose.combined(frame(spark), e[2]).collect()}[0] == pytest.approx({r.qid: r.vec for r in compose.combined(frame(spark), m).collect()}[0])
    with pytest.raises(FileNotFoundError):
        model_store.replicate_ids(["x_boot_1"], "x")
    model_store.write_field_dump(m, str(tmp_path / "fields"))
    assert [r.value for r in spark.read.text(str(tmp_path / "fields/patient")).collect()] == ["elderly", "male"]


# ---------------------------------------------------------------- training

SMALL = training.Config(d_word=8, d_patient=3, d_encounter=2, d_out=8, epoch=3, threshold=1, subsample=1.0, ngram_buckets=500, chunk_size=40, lr=0.1, max_n=4)


def small_lexicon(cfg, words=("a", "bb", "ccc", "dd"), freq=(8, 4, 2, 1)):
    tree = huffman.codes(np.array(freq))
    return training.Lexicon(tree.start, tree.path, tree.code, *ngram_buckets_many(list(words), cfg.min_n, cfg.max_n, cfg.ngram_buckets, cfg.ngram_mode), np.zeros(len(words)))


def forward(p, lex, w, pat, enc):
    grams = lex.grams[lex.gram_start[w] : lex.gram_start[w + 1]]
    return np.concatenate([p.input[w] + p.ngram[grams].sum(axis=0), p.patient[pat].mean(axis=0), p.encounter[enc].mean(axis=0)])


def loss_of(p, lex, w, target, pat, enc):
    a, b = lex.path_start[target], lex.path_start[target + 1]
    h = p.W_proj.astype(float) @ forward(p, lex, w, pat, enc).astype(float)
    s = 1 / (1 + np.exp(-(p.output[lex.path[a:b]].astype(float) @ h)))
    t = lex.target[a:b]
    return -float((t * np.log(s) + (1 - t) * np.log(1 - s)).sum())


MATRICES = ["output", "input", "ngram", "W_proj", "patient", "encounter"]


def run_pairs(p, lex, cfg, lr, pairs, pat, enc, n_lines=1):
    """One batch of these (centre word, context word) pairs, all of line 0."""
    word = np.array(sorted({w for w, _ in pairs}))
    centre = np.array([int(np.searchsorted(word, w)) for w, _ in pairs])
    order = np.argsort(centre, kind="stable")
    group = ((np.array([0, len(pat)]), np.array(pat)), (np.array([0, len(enc)]), np.array(enc)))
    return training.train_batch(p, lex, cfg, lr, group, np.zeros(len(word), np.int64), word, centre[order], np.array([t for _, t in pairs])[order])


@pytest.mark.parametrize("name", MATRICES)
def test_updates_follow_finite_differences(name):
    """Without clipping and with `standard` step sizes, an update is minus lr times the gradient of the summed loss."""
    cfg = training.Config(**{**SMALL.__dict__, "grad_clip": 0.0, "lr_mode": "standard", "batch": 1})
    lex = small_lexicon(cfg)
    base = training.Params(cfg, 4, 2, 1, lex.buckets)
    for k in MATRICES:
        setattr(base, k, getattr(base, k).astype(np.float64))
    new, lr, pairs = base.copy(), 1e-3, [(0, 1), (1, 0), (1, 2), (3, 0), (0, 1)]
    loss, n = run_pairs(new, lex, cfg, lr, pairs, [1, 0, 1], [0])
    pat, enc = np.array([1, 0, 1]), np.array([0])
    whole = lambda: sum(loss_of(base, lex, w, t, pat, enc) for w, t in pairs)
    assert loss == pytest.approx(whole(), rel=1e-4) and n == sum(lex.path_start[t + 1] - lex.path_start[t] for _, t in pairs)
    m = getattr(base, name)
    g = np.zeros_like(m)
    for i in np.ndindex(m.shape):
        keep = m[i]
        m[i] = keep + 1e-5
        up = whole()
        m[i] = keep - 1e-5
        g[i] = (up - whole()) / 2e-5
        m[i] = keep
    assert (getattr(new, name) - m) / lr == pytest.approx(-g, abs=0.02, rel=0.02)


def test_a_batch_of_one_pair_equals_the_step_stated_once():
    """A plain transcript of the documented step: clipped moves, the step size twice on the way back."""
    cfg = training.Config(**{**SMALL.__dict__, "grad_clip": 0.05, "batch": 1})
    lex = small_lexicon(cfg)
    p = training.Params(cfg, 4, 2, 1, lex.buckets)
    want, lr, w, t = p.copy(), 0.3, 1, 2
    z = forward(p, lex, w, np.array([1]), np.array([0]))
    h, grad = p.W_proj @ z, np.zeros(cfg.d_out)
    for k in range(lex.path_start[t], lex.path_start[t + 1]):
        node, target = lex.path[k], lex.target[k]
        s = 1 / (1 + np.exp(-np.clip(p.output[node] @ h, -20, 20)))
        grad += lr * (target - s) * p.output[node]
        want.output[node] += training.clip(lr * (target - s) * h, cfg.grad_clip)
    grad = training.clip(grad, cfg.grad_clip)
    q = p.W_proj.T @ grad
    want.W_proj += lr * np.outer(grad, z)
    want.input[w] += lr * q[:8]
    np.add.at(want.ngram, lex.grams[lex.gram_start[w] : lex.gram_start[w + 1]], lr * q[:8])
    want.patient[1] += lr * q[8:11]
    want.encounter[0] += lr * q[11:]
    run_pairs(p, lex, cfg, lr, [(w, t)], [1], [0])
    for k in MATRICES:
        assert getattr(p, k) == pytest.approx(getattr(want, k), abs=1e-6), k


def test_pairs_equal_a_plain_loop():
    cfg = training.Config(window_size=3, seed=7)
    lex = small_lexicon(SMALL)
    lex.discard = np.array([0.5, 0.2, 0.0, 0.9])
    ids, start, sample = np.array([0, 1, -1, 2, 3, 0, 0, 1, 2, 2, 1]), np.array([0, 6, 6, 11]), np.array([5, 9, 77])
    line, word, centre, context = training.pairs_of(lex, cfg, 1, sample, start, ids)
    one = lambda s, pos, use: int(training.draws(7, 1, np.array([s]), np.array([pos]), use)[0])
    want = []
    for k, s in enumerate(sample):
        row = ids[start[k] : start[k + 1]]
        for c, w in enumerate(row):
            if w < 0 or (one(s, c, 0) >> 11) / 2**53 < lex.discard[w]:
                continue
            win = 1 + one(s, c, 1) % 3
            want += [(k, w, row[o]) for o in range(max(0, c - win), min(len(row), c + win + 1)) if o != c and row[o] >= 0 and (one(s, c, 2 + o) >> 11) / 2**53 >= lex.discard[row[o]]]
    assert list(zip(line[centre], word[centre], context)) == want and want


def params_table(spark, p, schema="matrix int, row long, vec array<double>"):
    return spark.createDataFrame([(m, i, v.tolist()) for m, k in enumerate(training.NAMES) for i, v in enumerate(getattr(p, k))], schema)


def params_back(table, like):
    out = like.copy()
    for r in table.collect():
        getattr(out, training.NAMES[r.matrix])[r.row] = r.vec
    return out


def test_rounds_average_what_tasks_changed(spark):
    """Two of three tasks with lines send differences; a row of theirs that a third never saw is its own mean, a dense one is over all three."""
    cfg = training.Config(**{**SMALL.__dict__, "precision": "double"})
    old = training.Params(cfg, 6, 2, 1, np.arange(5))
    code = {k: m for m, k in enumerate(training.NAMES)}
    ones = lambda k: [1.0] * cfg.columns[k]
    rows = [(code["output"], 1, [2.0] * 8, 0), (code["output"], 1, [4.0] * 8, 1), (code["input"], 3, ones("input"), 1), (code["patient"], 1, ones("patient"), 0), (len(code), 0, [], 0)]
    rows += [(code["W_proj"], i, ones("W_proj"), 0) for i in range(8)]
    deltas = spark.createDataFrame(rows, "matrix int, row long, vec array<double>, task int").repartition(4)
    got = training.moved(params_table(spark, old).repartition(3), deltas, 3, cfg)
    assert got.count() == params_table(spark, old).count()
    new = params_back(got, old)
    assert new.output[1] == pytest.approx(old.output[1] + 3) and new.input[3] == pytest.approx(old.input[3] + 1) and new.patient[1] == pytest.approx(old.patient[1] + 1 / 3)
    assert new.W_proj == pytest.approx(old.W_proj + 1 / 3) and (new.ngram == old.ngram).all() and (new.encounter == old.encounter).all() and (new.output[2:] == old.output[2:]).all()
    decayed = params_back(training.moved(params_table(spark, old), deltas.limit(0), 0, training.Config(**{**cfg.__dict__, "weight_decay": 0.1})), old)
    assert decayed.W_proj == pytest.approx(old.W_proj * 0.9) and (decayed.input == old.input).all()


def test_initial_values_are_gaussian_and_depend_on_their_place_alone():
    cfg = training.Config(d_word=100, precision="double")
    x = training.initial(cfg, "input", np.arange(3000)) * 10
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x**4).mean() - 3) < 0.1 and abs(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 0.06
    assert (training.initial(cfg, "input", np.array([7, 2999])) * 10 == x[[7, 2999]]).all() and not (training.initial(cfg, "ngram", np.array([7])) == x[7] / 10).any()


def test_tiles_do_not_show_and_bound_memory(monkeypatch):
    """A line of 100,000 words over a vocabulary of 20,000 in tiles, and a short one in one tile and in many."""
    import tracemalloc

    cfg = training.Config(**{**SMALL.__dict__, "batch": 4, "precision": "double"})
    rng = np.random.default_rng(1)

    def trained(words, n, cells):
        lex = small_lexicon(cfg, [f"w{i}" for i in range(words)], (10**6 / (1 + np.arange(words))).astype(int))
        p = training.Params(cfg, words, 2, 1, lex.buckets)
        monkeypatch.setattr(training, "CELLS", cells)
        ids = (words * rng.random(n) ** 3).astype(np.int64)
        tracemalloc.start()
        got = training.train_lines(p, lex, cfg, 0, 0.1, np.array([5]), (np.array([0, n]), ids), (np.array([0, 1]), np.array([1])), (np.array([0, 1]), np.array([0])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, p, peak

    rng = np.random.default_rng(1)
    (loss, n), one, _ = trained(50, 60, 1 << 22)
    rng = np.random.default_rng(1)
    (loss2, n2), many, _ = trained(50, 60, 40)
    assert n == n2 and loss == pytest.approx(loss2, rel=1e-12)
    for k in MATRICES:
        assert getattr(one, k) == pytest.approx(getattr(many, k), rel=1e-10, abs=1e-12), k
    (_, n), _, peak = trained(20_000, 100_000, 1 << 18)
    assert n > 4_000_000 and peak < 200 << 20


def test_lines_are_numbered_alike_by_a_sent_vocabulary_and_by_joins(spark, monkeypatch):
    rows = [(i, ["a", "b", "zz", "a"][: i % 5], ["p", "q"] * (i % 2), None if i == 3 else ["e", "none"]) for i in range(9)]
    lines = spark.createDataFrame(rows, "sample long, words array<string>, patient array<string>, encounter array<string>").repartition(3)
    vocabs = {g: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "idx long, token string") for g, ts in (("word", "ab"), ("patient", "qp"), ("encounter", "e"))}
    got = [sorted(tuple(r) for r in training.numbered(lines, vocabs, 5).collect())]
    monkeypatch.setattr(training, "SENT_TOKENS", 2)
    got.append(sorted(tuple(r) for r in training.numbered(lines, vocabs, 5).collect()))
    assert got[0] == got[1] and got[0][4] == (4, [0, 1, -1, 0], [], [0, -1]) and got[0][3][3] == []


def test_training_depends_on_tasks_not_on_partitions(spark, monkeypatch):
    rows = [(i, v) for i, v in enumerate(["old ||| n ||| a b c a b", "young ||| m ||| x y z x y", "old |||  ||| a b c"] * 20)]
    cfg = training.Config(**{**SMALL.__dict__, "tasks": 3, "chunk_size": 10, "epoch": 2, "precision": "double"})
    got = []
    for parts in (1, 5):
        if parts == 5:
            monkeypatch.setattr(training, "SEND", 2)
        t = training.train(spark.createDataFrame(rows, "id long, value string").repartition(parts), cfg, key="id")
        got.append(({(r.matrix, r.row): r.vec for r in t.params.collect()}, [m[1:3] for m in t.metrics]))
    assert got[0][0].keys() == got[1][0].keys() and [m[1] for m in got[0][1]] == [m[1] for m in got[1][1]]
    assert max(abs(np.array(v) - np.array(got[1][0][k])).max() for k, v in got[0][0].items()) < 1e-12


def test_step_size_and_clipping():
    assert training.learning_rate(0.1, 0, 100) == 0.1 and training.learning_rate(0.1, 100, 100) == pytest.approx(1e-5)
    assert np.linalg.norm(training.clip(np.array([3.0, 4.0]), 1.0)) == pytest.approx(1) and training.clip(np.array([3.0, 4.0]), 0.0).tolist() == [3, 4]


def test_training_learns_and_repeats(spark):
    rows = [(i, v) for i, v in enumerate(["old ||| n ||| a b c a b", "young ||| m ||| x y z x y", "bad line", "old |||  ||| a b c"] * 40)]
    df = spark.createDataFrame(rows, "id long, value string").repartition(3)
    model, metrics = training.fit(df, SMALL, key="id")
    m = metrics.orderBy("epoch").collect()
    assert len(m) == 3 and m[-1].avg_loss < m[0].avg_loss and m[0].predictions > 0
    assert {r.matrix for r in compose.matrix_health(model.matrices).collect()} == set(model_store.MATRICES)
    v = compose.combined(frame(spark, [(0, ["a"], ["old"], ["n"])]), model).first().vec
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6)
    near = [r.token for r in search.nearest_one(v, compose.word_cache(model), 6).collect()]
    assert set(near[:3]) == {"a", "b", "c"}  # the words of its lines before those of the others
    with pytest.raises(ValueError, match="empty"):
        training.fit(df, training.Config(threshold=10**6))


def test_health_gate_names_all_bad_matrices(spark):
    p = training.Params(SMALL, 4, 2, 1, np.arange(3))
    p.input[0, 0], p.W_proj[0, 0] = np.nan, np.inf
    table = params_table(spark, p)
    assert training.health(table) == [("input", 1, 0), ("W_proj", 0, 1)]
    with pytest.raises(FloatingPointError, match="input.*W_proj"):
        training.check_health(table, 1)


# ---------------------------------------------------------------- command line


def test_train_arguments():
    cfg, a, b, threads = cli.parse_train(["-lr", "0.5", "in", "-threads", "3", "out", "ignored", "-d-word", "7"])
    assert (cfg.lr, cfg.d_word, a, b, threads) == (0.5, 7, "in", "out", 3)
    for bad in (["-nope", "in", "out"], ["in", "out", "-lr"], ["in"]):
        with pytest.raises(cli.Usage):
            cli.parse_train(bad)


def test_query_arguments():
    assert cli.parse_query(["m", "chest", "--patient", "p", "--k", "0", "pain", "--encounter", "e"]) == ("m", ["chest", "pain"], ["p"], ["e"], 1)
    with pytest.raises(cli.Usage):
        cli.parse_query(["m", "--patient", "p"])


def test_compare_arguments():
    assert cli.parse_compare(["m", "--words1", "a", "--words2", "b", "c"])[1] == [["a"], [], [], ["b", "c"], [], []]
    for bad in (["m", "a", "--words1", "b"], ["m", "--words1", "a"]):
        with pytest.raises(cli.Usage):
            cli.parse_compare(bad)


def test_commands_end_to_end(spark, tmp_path, capsys):
    p = str(tmp_path)
    assert cli.main(["generate", f"{p}/corpus", "--rows", "300"], spark) == 0
    flags = "-d-word 8 -d-patient 3 -d-encounter 2 -d-out 8 -epoch 1 -threshold 2 -ngram-buckets 500 -maxn 4".split()
    for name in ("model", "model_boot_1"):
        assert cli.main(["train", *flags, f"{p}/corpus", f"{p}/{name}"], spark) == 0
    assert cli.main(["query", f"{p}/model", "chest", "pain", "--patient", "elderly", "--k", "3"], spark) == 0
    assert cli.main(["compare", f"{p}/model", "--words1", "pneumonia", "--words2", "sepsis"], spark) == 0
    assert cli.main(["inspect", f"{p}/model", "fever"], spark) == 0
    assert cli.main(["dump-fields", f"{p}/model", f"{p}/fields"], spark) == 0
    (tmp_path / "b.txt").write_text("chest pain ||| elderly ||| \n\n")
    (tmp_path / "t.txt").write_text("fever|||male|||nurse\nrash ||| ||| \n")
    assert cli.main(["compare-bootstrap", f"{p}/b.txt", f"{p}/t.txt", f"{p}/model"], spark) == 0
    assert "chest pain elderly" in capsys.readouterr().out
    assert cli.main(["compare-bootstrap", f"{p}/b.txt", f"{p}/t.txt", f"{p}/none"], spark) == 1
    assert cli.main(["nope"], spark) == 1


def test_corpus_commands(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "ADMISSIONS.csv").write_text("HADM_ID,ADMITTIME,DISCHTIME,ADMISSION_TYPE,INSURANCE,LANGUAGE,RELIGION,MARITAL_STATUS,ETHNICITY,HOSPITAL_EXPIRE_FLAG\n5,2020-01-01 00:00:00,2020-01-09 00:00:00,URGENT,Private,ENGL,JEWISH,SINGLE,WHITE,0\n")
    (tmp_path / "PATIENTS.csv").write_text("ROW_ID,SUBJECT_ID,DOB,GENDER\n9,1,1990-01-01 00:00:00,F\n")
    (tmp_path / "CAREGIVERS.csv").write_text("CGID,LABEL\n3,RN\n")
    assert cli.main(["merge", "--data-dir", p, "--out", f"{p}/merged"], spark) == 1  # a table is missing
    spark.createDataFrame([(i, 1, 5, 3, "The patient was seen today. She feels much better now.") for i in range(4)], corpus.NOTES).write.parquet(f"{p}/NOTEEVENTS.parquet")
    assert cli.main(["merge", "--data-dir", p, "--out", f"{p}/merged"], spark) == 0
    assert cli.main(["sentences", "--input", f"{p}/merged", "--out", f"{p}/sentences"], spark) == 0
    assert cli.main(["sentences", "--input", f"{p}/merged", "--out", f"{p}/learned", "--splitter", "learned"], spark) == 0
    assert spark.read.parquet(f"{p}/learned").count() == 4
    assert cli.main(["corpus", "--input", f"{p}/sentences", "--out", f"{p}/c0"], spark) == 0
    assert cli.main(["corpus", "--input", f"{p}/sentences", "--out", f"{p}/c1", "--bootstrap-seed", "3"], spark) == 0
    got = corpus.training_samples(corpus.read_lines(spark, f"{p}/c0")).collect()
    assert len(got) == 8 and "length_of_stay:extended" in got[0].encounter and "age_group:adult" in got[0].patient
    assert spark.read.text(f"{p}/c1").count() == 8
    flags = "-d-word 4 -d-patient 2 -d-encounter 2 -d-out 4 -epoch 1 -threshold 1 -ngram-buckets 100 -maxn 4".split()
    assert cli.main(["bootstrap-run", "--input", f"{p}/sentences", "--out", f"{p}/e", "--replicates", "1", *flags], spark) == 0
    assert sorted(model_store.load_ensemble(spark, p, "e")) == [0, 1]


def test_corpus_files_are_compressed(spark, tmp_path):
    """By default, with the lines of plain files in their order; what is moved to its place is one string and the keys of its place."""
    p = str(tmp_path)
    rows = [(i % 7, i, f"age_group:adult gender:{'fm'[i % 2]}", "mortality:alive", [f"the patient number {j} was seen on ward {i} today" for j in range(40)]) for i in range(50)]
    spark.createDataFrame(rows, corpus.SENTENCES).write.parquet(f"{p}/sentences")
    for name, more in (("whole", ["--shuffle-seed", "9"]), ("drawn", ["--bootstrap-seed", "7"])):
        assert cli.main(["corpus", "--input", f"{p}/sentences", "--out", f"{p}/{name}", *more], spark) == 0
        stored = sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
        assert cli.main(["corpus", "--input", f"{p}/sentences", "--out", f"{p}/{name}_plain", *more, "--compression", "none"], spark) == 0
        lines = [line for f in sorted((tmp_path / f"{name}_plain").glob("part-*")) for line in f.read_text().splitlines()]
        assert stored < sum(map(len, lines)) / 3
        assert [r.value for r in corpus.placed_lines(spark, f"{p}/{name}").orderBy("place").collect()] == lines
        assert sorted(r.value for r in corpus.read_lines(spark, f"{p}/{name}").collect()) == sorted(lines)


def test_batches_do_not_depend_on_the_pieces_in_which_lines_arrive():
    """A batch that is larger than a piece, and pieces that cut batches anywhere, give what all lines at once do."""
    rng = np.random.default_rng(3)
    words = [rng.integers(-1, 4, rng.integers(1, 8)) for _ in range(23)]

    def task(batch, pieces):
        cfg = training.Config(**{**SMALL.__dict__, "precision": "double", "batch": batch, "grad_clip": 0.05})
        lex = small_lexicon(cfg)
        p = training.Params(cfg, 4, 2, 1, lex.buckets)
        now, got = training.Batch(p, batch), np.zeros(2)
        for a, b in zip([0, *pieces], [*pieces, 23]):
            n = np.cumsum([0, *map(len, words[a:b])])
            line = np.arange(b - a + 1)
            got += training.train_lines(p, lex, cfg, 0, 0.1, np.arange(a, b), (n, np.concatenate(words[a:b])), (line, np.arange(a, b) % 2), (line, np.zeros(b - a, np.int64)), now)
        now.make()
        return got, p

    for batch in (1, 4, 10**9):
        (whole, p), (cut, q) = task(batch, []), task(batch, [1, 7, 8, 17])
        assert cut == pytest.approx(whole, rel=1e-12) and whole[1] > 0
        for k in MATRICES:
            assert getattr(q, k) == pytest.approx(getattr(p, k), rel=1e-10, abs=1e-13), (batch, k)


def test_a_round_does_not_depend_on_arrow_batches(spark):
    """The rows of a task come in Arrow batches of any size; a training batch spans them."""
    lines = [f"p{i % 3} ||| e{i % 2} ||| w{i % 5} w{i % 7} w{i % 11} w{i % 4}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, value string")
    cfg = training.Config(**{**SMALL.__dict__, "precision": "double", "batch": 10**9, "tasks": 2, "epoch": 1, "chunk_size": 10**9})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(size):
        spark.conf.set(key, size)
        return {(r.matrix, r.row): list(r.vec) for r in training.train(df, cfg, key="id").params.collect()}

    try:
        whole, cut = rows("10000"), rows("17")
    finally:
        spark.conf.set(key, before)
    assert whole.keys() == cut.keys()
    for k, v in whole.items():
        assert cut[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k


def test_a_round_adds_up_what_its_tasks_report(spark):
    """Loss and predictions go along with the parameters, so a round is one job: sums of the epoch so far and of all tasks, in one place beside unchanged parameters."""
    cfg = training.Config(**{**SMALL.__dict__, "precision": "double"})
    old, n = training.Params(cfg, 6, 2, 1, np.arange(5)), len(training.NAMES)
    facts = "loss double, preds long"
    rows = params_table(spark, old).selectExpr("*", "0D AS loss", "0L AS preds").unionByName(spark.createDataFrame([(n, 0, [], 1.5, 10)], f"matrix int, row long, vec array<double>, {facts}"))
    deltas = spark.createDataFrame([(n, 0, [], 0, 2.0, 5), (n, 0, [], 1, 0.25, 7), (1, 3, [1.0] * 8, 1, 0.0, 0)], f"matrix int, row long, vec array<double>, task int, {facts}")
    got = training.moved(rows.repartition(3), deltas.repartition(2), 2, cfg, True)
    told = got.filter(f"matrix = {n}").collect()
    assert sum(r.loss for r in told) == 3.75 and sum(r.preds for r in told) == 22
    new = params_back(got.filter(f"matrix < {n}"), old)
    assert new.input[3] == pytest.approx(old.input[3] + 1) and (new.output == old.output).all() and got.filter(f"matrix < {n} AND (loss <> 0 OR preds <> 0)").count() == 0
