"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import random
from collections import Counter

import corpus_pipeline
from test_text_operators import slow_clusters, slow_rules, slow_substring


def documents(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts = [say(rng.randrange(12, 160)) for _ in range(40)]
    shared = say(70)
    texts += [f"{say(30)} {shared} {say(20)}" for _ in range(4)] + [texts[3], texts[4] + " tail", "junk ### " * 30, "too short", None, "", shared]
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, fp string")


def test_stages(spark):
    docs = documents(spark)
    out = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe"]
    seen = [{r.doc_id: r for r in docs.collect()}]
    counts = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        counts = Counter(r.doc_id for r in rows)
        seen.append({r.doc_id: r for r in rows})
        out = spark.createDataFrame(rows, docs.schema)
    m = {i: slow_rules(r.text or "") for i, r in seen[0].items()}
    good = {i for i, (n, chars, sym, lines, dup, rep, let) in m.items() if not (n < 10 or 100 * rep > 20 * n or 10 * sym > n or 2 * dup > lines or chars > 25 * n or chars < 2 * n or 2 * let < n)}
    assert set(seen[1]) == good
    ids = sorted(good)
    comp = slow_clusters([seen[1][i].text for i in ids])[1]
    assert set(seen[2]) == {ids[k] for k, c in comp.items() if k == c}
    want = slow_substring([(i, r.text) for i, r in sorted(seen[2].items())], 50)
    left = {i for i, (n, gone, _) in want.items() if gone < n}
    assert set(seen[3]) == left
    for i in left:
        n, gone, kept = want[i]
        assert seen[3][i].text == (kept if gone else seen[2][i].text) and (not gone or seen[3][i].n_chars == len(kept))
    assert set(counts) <= left and max(counts.values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    assert len(last) == sum(counts.values()) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run_and_empty_table(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    documents(spark).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
