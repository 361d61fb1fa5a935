"""Command line: python -m covarium.cli COMMAND ...

merge, sentences and corpus build a corpus; train builds a model; query, compare, compare-bootstrap, inspect and dump-fields read it; bootstrap-run trains
an ensemble; generate writes the demonstration corpus.
"""

from __future__ import annotations

import argparse
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.functions.text import MIN_SENTENCE, split_sentences
from covarium.functions.vectors import MIN_NORM, norm
from covarium.operators import boundaries, compose, covariates, resample, search, sentences, training, uncertainty
from covarium.session import delete, materialize, session
from covarium.sources import corpus, model_store

TRAIN_FLAGS = {
    "-d-word": ("d_word", int), "-d-patient": ("d_patient", int), "-d-encounter": ("d_encounter", int), "-d-out": ("d_out", int), "-epoch": ("epoch", int), "-lr": ("lr", float),
    "-minn": ("min_n", int), "-maxn": ("max_n", int), "-threshold": ("threshold", int), "-subsample": ("subsample", float), "-grad-clip": ("grad_clip", float),
    "-weight-decay": ("weight_decay", float), "-threads": ("threads", int), "-chunk-size": ("chunk_size", int), "-ngram-buckets": ("ngram_buckets", int), "-window-size": ("window_size", int),
}
USAGE = "usage: train [options] <training text> <output model>\n  " + "  ".join(f"{k} <{t.__name__}>" for k, (_, t) in TRAIN_FLAGS.items())

#: Replicates of an ensemble that are fitted at a time.
FITS = 4

#: Columns of a sentence table that a line begins with.
GROUPS = ["patient_group", "encounter_group"]


class Usage(Exception):
    """A wrong command line; its text goes to standard error and the exit code is 1."""


def parse_train(argv: list[str]) -> tuple[training.Config, str, str, int | None]:
    """Config, input, output, threads. An unknown flag, or one without its value, is an error; positions after the second are ignored."""
    values: dict = {}
    places: list[str] = []
    i = 0
    while i < len(argv):
        a = argv[i]
        if a in ("-help", "--help"):
            raise SystemExit(print(USAGE) or 0)
        if a in TRAIN_FLAGS and i + 1 < len(argv):
            name, kind = TRAIN_FLAGS[a]
            values[name] = kind(argv[i + 1])
            i += 1
        elif not a.startswith("-"):
            places.append(a)
        else:
            raise Usage(f"unknown argument: {a}\n{USAGE}")
        i += 1
    if len(places) < 2:
        raise Usage(f"input and output are required\n{USAGE}")
    threads = values.pop("threads", None)
    return training.Config(**{f.name: values[f.name] for f in fields(training.Config) if f.name in values}), places[0], places[1], threads


def parse_query(argv: list[str]) -> tuple[str, list[str], list[str], list[str], int]:
    """Model, words, patient, encounter, k. Bare arguments are words, also after `--k n`; at least one word; k below 1 counts as 1."""
    if not argv:
        raise Usage("usage: query <model> <words...> [--patient <fields...>] [--encounter <fields...>] [--k <n>]")
    into = {"--words": [], "--patient": [], "--encounter": []}
    at, k, i = "--words", 10, 1
    while i < len(argv):
        if argv[i] == "--k" and i + 1 < len(argv):
            k, at, i = int(argv[i + 1]), "--words", i + 1
        elif argv[i] in into:
            at = argv[i]
        else:
            into[at].append(argv[i])
        i += 1
    if not into["--words"]:
        raise Usage("query: at least one word is required")
    return argv[0], into["--words"], into["--patient"], into["--encounter"], max(1, k)


def parse_compare(argv: list[str]) -> tuple[str, list[list[str]]]:
    """Model and six lists; arguments before the first flag are an error, and so is a side without words."""
    names = ["--words1", "--patient1", "--encounter1", "--words2", "--patient2", "--encounter2"]
    into: dict[str, list[str]] = {n: [] for n in names}
    if not argv:
        raise Usage("usage: compare <model> --words1 ... --words2 ... [--patient1 ...] [--encounter1 ...] [--patient2 ...] [--encounter2 ...]")
    at = None
    for a in argv[1:]:
        if a in into:
            at = a
        elif at is None:
            raise Usage(f"compare: unexpected argument {a}")
        else:
            into[at].append(a)
    if not into["--words1"] or not into["--words2"]:
        raise Usage("compare: --words1 and --words2 are required")
    return argv[0], [into[n] for n in names]


def _query_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "qid long, words array<string>, patient array<string>, encounter array<string>")


def train(spark: SparkSession, argv: list[str]) -> DataFrame:
    cfg, source, target, threads = parse_train(argv)
    lines = corpus.read_lines(spark, source)
    if threads:
        lines = lines.repartition(threads)
    model, metrics = training.fit(lines, cfg)
    model_store.save(model, target)
    return metrics


def query(spark: SparkSession, argv: list[str]) -> DataFrame:
    path, words, patient, encounter, k = parse_query(argv)
    model = model_store.load(spark, path)
    vec = compose.combined(_query_frame(spark, [(0, words, patient, encounter)]), model).first().vec
    return search.nearest_one(vec, compose.word_cache(model), k)


def compare(spark: SparkSession, argv: list[str]) -> DataFrame:
    path, (w1, p1, e1, w2, p2, e2) = parse_compare(argv)
    v = compose.combined(_query_frame(spark, [(1, w1, p1, e1), (2, w2, p2, e2)]), model_store.load(spark, path))
    if v.filter(norm(F.col("vec")) < MIN_NORM).count():
        raise Usage("compare: a vector is near zero")
    a, b = v.filter("qid = 1").select(F.col("vec").alias("a")), v.filter("qid = 2").select(F.col("vec").alias("b"))
    return search.compare(a.join(b)).drop("a", "b")  # one row each


def compare_bootstrap(spark: SparkSession, argv: list[str]) -> DataFrame:
    if len(argv) < 2:
        raise Usage("usage: compare-bootstrap <bases> <targets> [<model folder>/<prefix>]")
    folder, _, prefix = (argv[2] if len(argv) > 2 else "./model").rpartition("/")
    try:
        models = model_store.ensemble(spark, folder or ".", prefix)
    except FileNotFoundError as e:
        raise Usage(str(e)) from e
    sides = []
    for p in argv[:2]:
        q = corpus.query_triples(spark.read.text(p)).coalesce(1)  # query files are short and their order is their number
        sides.append(materialize(q.withColumn("qid", F.monotonically_increasing_id()), "queries"))
    return uncertainty.ensemble_intervals(models, *sides)


def merge(spark: SparkSession, argv: list[str]) -> DataFrame:
    p = argparse.ArgumentParser("merge")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    paths = {n: f"{a.data_dir}/{n}" for n in ("ADMISSIONS.csv", "PATIENTS.csv", "CAREGIVERS.csv", "NOTEEVENTS.parquet")}
    if missing := corpus.missing_files(spark, list(paths.values())):
        raise Usage("missing: " + ", ".join(missing))
    csv = lambda n, s: corpus.read_csv(spark, paths[n], s)
    notes = spark.read.parquet(paths["NOTEEVENTS.parquet"])
    out = covariates.merge_notes(notes, csv("PATIENTS.csv", corpus.PATIENTS), csv("ADMISSIONS.csv", corpus.ADMISSIONS), csv("CAREGIVERS.csv", corpus.CAREGIVERS))
    corpus.write_parquet(out, a.out)
    return spark.read.parquet(a.out).agg(F.count(F.lit(1)).alias("n_notes"))


def sentence_step(spark: SparkSession, argv: list[str]) -> DataFrame:
    p = argparse.ArgumentParser("sentences")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--batch-size", type=int, default=5000, help="accepted and unused: partitions take the place of batches")
    p.add_argument("--workers", type=int, default=None, help="partitions to work in")
    p.add_argument("--min-len", type=int, default=MIN_SENTENCE)
    p.add_argument("--splitter", choices=("rule", "learned"), default="rule", help="learned: boundaries learned from these notes")
    a = p.parse_args(argv)
    merged = spark.read.parquet(a.input)
    if a.workers:
        merged = merged.repartition(a.workers)
    split = split_sentences if a.splitter == "rule" else boundaries.splitter(boundaries.learn(merged))
    corpus.write_parquet(sentences.sentence_table(merged, a.min_len, split), a.out)
    return sentences.totals(spark.read.schema(corpus.SENTENCES).parquet(a.out))


def corpus_step(spark: SparkSession, argv: list[str]) -> DataFrame:
    p = argparse.ArgumentParser("corpus")
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--bootstrap-seed", type=int, default=None)
    p.add_argument("--shuffle-seed", type=int, default=None)
    p.add_argument("--compression", choices=("gzip", "none"), default="gzip", help="of the files of lines; the other commands read either, programs that want plain text need none")
    a = p.parse_args(argv)
    write_corpus(spark.read.parquet(a.input), a.out, a.bootstrap_seed, a.shuffle_seed, a.compression)
    return spark.read.text(a.out).agg(F.count(F.lit(1)).alias("n_lines"))


def write_corpus(table: DataFrame, path: str, bootstrap_seed: int | None = None, shuffle_seed: int | None = None, compression: str = "gzip") -> None:
    """Corpus lines of a sentence table, shuffled; with a bootstrap seed, of a resampled one. What is moved to its place is the line and the keys of its place."""
    if bootstrap_seed is None:
        rows, keys = resample.explode_sentences(table), ["SUBJECT_ID", "ROW_ID", "pos"]
    else:
        drawn = resample.bootstrap_notes(table, bootstrap_seed, "SUBJECT_ID", "ROW_ID")
        rows, keys = resample.expand(drawn, table, near=GROUPS), ["SUBJECT_ID", "ROW_ID", "instance", "draw", "pos"]
    lines = rows.select(*keys, corpus.line(*map(F.col, GROUPS), F.col("sentence")).alias("value"))
    corpus.write_lines(resample.shuffled(lines, resample.shuffle_seed(bootstrap_seed, shuffle_seed), keys), path, F.col("value"), compression)


def bootstrap_run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """An original model (shuffle seed 42) and replicates (seed i for both draws), FITS at a time; step size 0.02 and weight decay 1e-5 unless flags say otherwise."""
    p = argparse.ArgumentParser("bootstrap-run")
    p.add_argument("--input", required=True, help="sentence table")
    p.add_argument("--out", required=True, help="<folder>/<prefix> of the models")
    p.add_argument("--replicates", type=int, default=25)
    a, rest = p.parse_known_args(argv)
    cfg = parse_train(["-lr", "0.02", "-weight-decay", "1e-5", *rest, "in", "out"])[0]
    corpora = write_corpora(spark.read.parquet(a.input), f"{a.out}_corpus_tmp", a.replicates)
    pools = ThreadPoolExecutor(min(FITS, a.replicates + 1))

    def one(i: int) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"replicate-{i % FITS}")
        model, metrics = training.fit(corpus.read_lines(spark, f"{corpora}/replicate_id={i}"), cfg)
        model_store.save(model, a.out + (f"_boot_{i}" if i else ""))
        return metrics.withColumn("replicate_id", F.lit(i))

    with pools:
        made = list(pools.map(inheritable_thread_target(spark)(one), range(a.replicates + 1)))
    delete(spark, corpora)
    return reduce(DataFrame.unionByName, made)


def write_corpora(table: DataFrame, path: str, replicates: int) -> str:
    """The corpus lines of the original (replicate 0, shuffle seed 42) and of all replicates (seed i for both draws), by one job, in a folder for each."""
    whole, drawn = ["SUBJECT_ID", "ROW_ID", "pos"], ["SUBJECT_ID", "ROW_ID", "instance", "draw", "pos"]
    seed = F.when(F.col("replicate_id") == 0, 42).otherwise(F.col("replicate_id"))
    keyed = lambda rows, keys: rows.select("replicate_id", resample.shuffle_key(seed, *map(F.col, keys)).alias("_key"), corpus.line(F.col("patient_group"), F.col("encounter_group"), F.col("sentence")).alias("value"))
    rows = keyed(resample.explode_sentences(table).withColumn("replicate_id", F.lit(0)), whole)
    if replicates:
        sample = resample.bootstrap_notes(table, None, "SUBJECT_ID", "ROW_ID", list(range(1, replicates + 1)))
        rows = rows.unionByName(keyed(resample.expand(sample, table), drawn))
    rows.orderBy("replicate_id", "_key", "value").select("replicate_id", "value").write.mode("overwrite").partitionBy("replicate_id").text(path)
    return path


def inspect(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Block norms of the projection, and with a word its vector and five neighbours."""
    if not argv:
        raise Usage("usage: inspect <model> [word] [--patient ...] [--encounter ...]")
    model = model_store.load(spark, argv[0])
    norms = compose.block_norms(model).select(F.lit("norm").alias("kind"), F.col("block").alias("name"), F.col("norm").alias("value"))
    if len(argv) == 1:
        return norms
    _, words, patient, encounter, _ = parse_query(argv)
    vec = compose.combined(_query_frame(spark, [(0, words, patient, encounter)]), model).first().vec
    near = search.nearest_one(vec, compose.word_cache(model), 5).select(F.lit("neighbour").alias("kind"), F.col("token").alias("name"), F.col("similarity").alias("value"))
    parts = spark.createDataFrame([("vector", str(i), float(x)) for i, x in enumerate(vec)], "kind string, name string, value double")
    return norms.unionByName(parts).unionByName(near)


def dump_fields(spark: SparkSession, argv: list[str]) -> DataFrame:
    if len(argv) != 2:
        raise Usage("usage: dump-fields <model> <out>")
    model = model_store.load(spark, argv[0])
    model_store.write_field_dump(model, argv[1])
    return model.vocab.filter("group_name <> 'word'").select("group_name", "token").orderBy("group_name", "token")


def generate(spark: SparkSession, argv: list[str]) -> DataFrame:
    p = argparse.ArgumentParser("generate")
    p.add_argument("out")
    p.add_argument("--rows", type=int, default=1_000_000)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    corpus.write_lines(corpus.synthetic_corpus(spark, a.rows, a.seed), a.out, F.col("value"))
    return spark.read.text(a.out).agg(F.count(F.lit(1)).alias("n_lines"))


COMMANDS = {
    "train": train, "query": query, "compare": compare, "compare-bootstrap": compare_bootstrap, "merge": merge, "sentences": sentence_step, "corpus": corpus_step,
    "bootstrap-run": bootstrap_run, "inspect": inspect, "dump-fields": dump_fields, "generate": generate,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in COMMANDS:
        print(f"{__doc__}\ncommands: {', '.join(COMMANDS)}", file=sys.stderr)
        return 1
    try:
        COMMANDS[argv[0]](spark or session("covarium-cli"), argv[1:]).show(1000, truncate=False)
    except Usage as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
