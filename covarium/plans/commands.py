"""Named queries that go through files and commands: what is written is read again and compared with SQL over the tables it came from."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium import cli
from covarium.functions import vectors
from covarium.functions.register import register
from covarium.operators import compose, covariates, search, training, uncertainty
from covarium.operators.ranking import dense_index
from covarium.plans.catalogue import _SQL_GROUP, _SQL_ROUND, MERGE_SQL, U_SQL, V_SQL, _candidates, _pair_queries, _round, clinical, part_lines, query, t, toy_model
from covarium.session import checkpoint_dir, delete
from covarium.sources import corpus, model_store
from covarium.streaming import counts


def scratch(spark: SparkSession) -> str:
    """A folder of the shared scratch space, deleted at exit."""
    path = f"{checkpoint_dir(spark)}/covarium-{uuid.uuid4().hex}-files"
    atexit.register(delete, spark, path)
    return path


# ---------------------------------------------------------------- corpus files and commands


def _clinical_files(spark: SparkSession, d: str) -> str:
    """The clinical tables as files: CSV with a header, the notes through CSV to Parquet."""
    at = scratch(spark)
    notes, pat, adm, cg = clinical(spark, d)
    for name, df in (("PATIENTS", pat), ("ADMISSIONS", adm), ("CAREGIVERS", cg), ("NOTES", notes)):
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", None).option("emptyValue", "").csv(f"{at}/{name}.csv")
    corpus.csv_to_parquet(spark, f"{at}/NOTES.csv", f"{at}/NOTEEVENTS.parquet", corpus.NOTES)
    return at


@query(f"WITH {MERGE_SQL} SELECT * FROM merged")
def command_merge(spark: SparkSession, d: str) -> DataFrame:
    """CSV scans, the one-off conversion of notes, the check for missing files, the joins and the compressed Parquet sink, by the `merge` command."""
    at = _clinical_files(spark, d)
    cli.merge(spark, ["--data-dir", at, "--out", f"{at}/merged"])
    return spark.read.parquet(f"{at}/merged")


_NOTE_SQL = f"""{MERGE_SQL}, {U_SQL}, st AS MATERIALIZED (SELECT subject_id, row_id, {_SQL_GROUP(covariates.PATIENT_COLS)} AS p, {_SQL_GROUP(covariates.ENCOUNTER_COLS)} AS e, ss FROM merged JOIN u USING (row_id) WHERE len(ss) > 0)"""


@query(f"""WITH {_NOTE_SQL},
n AS (SELECT subject_id, row_id, row_number() OVER (PARTITION BY subject_id ORDER BY row_id) - 1 AS note FROM st),
pt AS (SELECT subject_id, count(*) AS k, row_number() OVER (ORDER BY subject_id) - 1 AS ord FROM st GROUP BY subject_id),
i AS (SELECT i AS instance, ('0x' || substr(md5('7-' || i), 1, 8))::BIGINT % (SELECT count(*) FROM pt) AS ord FROM (SELECT unnest(range((SELECT count(*) FROM pt))) AS i)),
dj AS (SELECT instance, subject_id, k, unnest(range(k)) AS draw FROM i JOIN pt USING (ord)),
x AS (SELECT subject_id, ('0x' || substr(md5('7-' || instance || '-' || draw), 1, 8))::BIGINT % k AS note FROM dj),
r AS (SELECT p || ' ||| ' || e || ' ||| ' || unnest(ss) AS value FROM x JOIN n USING (subject_id, note) JOIN st USING (subject_id, row_id))
SELECT value, count(*) AS n FROM r GROUP BY value""")
def command_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and a bootstrap corpus of the notes by the `sentences` and `corpus` commands: the lines of the file, whose order is a seeded shuffle, with how often each comes."""
    at = scratch(spark)
    corpus.write_parquet(covariates.merge_notes(*clinical(spark, d)), f"{at}/merged")
    cli.sentence_step(spark, ["--input", f"{at}/merged", "--out", f"{at}/sentences"])
    cli.corpus_step(spark, ["--input", f"{at}/sentences", "--out", f"{at}/corpus", "--bootstrap-seed", "7"])
    return corpus.read_lines(spark, f"{at}/corpus").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NOTE_SQL},
r AS (SELECT p || ' ||| ' || e || ' ||| ' || unnest(ss) AS value, subject_id, row_id, unnest(range(len(ss))) AS pos FROM st)
SELECT row_number() OVER (ORDER BY md5('shuffle-9-' || subject_id || '-' || row_id || '-' || pos), subject_id, row_id, pos) - 1 AS place, value FROM r""")
def command_corpus_order(spark: SparkSession, d: str) -> DataFrame:
    """The corpus of all sentences by the `corpus` command with a shuffle seed: each line with its place in the files."""
    at = scratch(spark)
    corpus.write_parquet(covariates.merge_notes(*clinical(spark, d)), f"{at}/merged")
    cli.sentence_step(spark, ["--input", f"{at}/merged", "--out", f"{at}/sentences"])
    cli.corpus_step(spark, ["--input", f"{at}/sentences", "--out", f"{at}/corpus", "--shuffle-seed", "9"])
    return corpus.placed_lines(spark, f"{at}/corpus")


@query("""WITH l AS (SELECT lower(p_brand) AS p, 'size:' || p_size AS e, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS w FROM part),
k AS (SELECT 'word' AS group_name, unnest(string_split(w, ' ')) AS token FROM l UNION ALL SELECT 'patient', p FROM l UNION ALL SELECT 'encounter', e FROM l),
c AS (SELECT group_name, token, count(*) AS freq FROM k WHERE token <> '' GROUP BY ALL HAVING group_name <> 'word' OR count(*) >= 30)
SELECT group_name, row_number() OVER (PARTITION BY group_name ORDER BY freq DESC, token) - 1 AS idx, token, freq FROM c UNION ALL SELECT 'epoch', i, '', 0 FROM range(1, 3) t(i)""")
def command_train(spark: SparkSession, d: str) -> DataFrame:
    """The `train` command: the vocabularies of the model that it stores, and the epochs of its metrics."""
    at = scratch(spark)
    part_lines(spark, d).select("value").write.text(f"{at}/lines")
    metrics = cli.train(spark, [*"-d-word 4 -d-patient 2 -d-encounter 2 -d-out 4 -epoch 2 -threshold 30 -ngram-buckets 500 -maxn 4".split(), f"{at}/lines", f"{at}/model"])
    vocab = model_store.load(spark, f"{at}/model").vocab.select("group_name", "idx", "token", "freq")
    return vocab.unionByName(metrics.select(F.lit("epoch").alias("group_name"), F.col("epoch").cast("bigint").alias("idx"), F.lit("").alias("token"), F.lit(0).cast("bigint").alias("freq")))


@query("""SELECT count(*) FILTER (length(value) > 0) AS n_lines, count(*) FILTER (len(string_split(value, ' ||| ')) = 3) AS n_grouped
    FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' ||| ' || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'x ||| ' END || c_name END AS value FROM customer)""")
def count_corpus_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a file that aren't empty, whether or not they parse, and those that parse."""
    k = F.col("c_custkey") % 4
    lines = t(spark, d, "customer").select(F.when(k == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" ||| "), F.when(k == 1, "").otherwise("x ||| "), "c_name")).alias("value"))
    at = scratch(spark)
    lines.write.text(f"{at}/lines")
    n = corpus.count_lines(spark.read.text(f"{at}/lines"))
    return corpus.counting_samples(corpus.read_lines(spark, f"{at}/lines")).agg(F.lit(n).cast("long").alias("n_lines"), F.count(F.lit(1)).alias("n_grouped"))


@query("""WITH l AS (SELECT lower(p_brand) AS p, 'size:' || p_size AS e, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS w FROM part),
k AS (SELECT 'word' AS group_name, unnest(string_split(w, ' ')) AS token FROM l UNION ALL SELECT 'patient', unnest(string_split(p, ' ')) FROM l UNION ALL SELECT 'encounter', e FROM l)
SELECT group_name, token, count(*) AS freq FROM k WHERE token <> '' GROUP BY ALL""")
def streaming_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of a corpus folder by a streaming query that takes a file at a time and starts again from its checkpoint."""
    at = scratch(spark)
    part_lines(spark, d).select("value").repartition(3).write.text(f"{at}/lines")
    counts.start_counts_to_parquet(counts.read_corpus(spark, f"{at}/lines", 1), f"{at}/counts", f"{at}/checkpoint", 2).awaitTermination()
    return counts.read_counts(spark, f"{at}/counts")


@query("""SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS draw, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), ',') AS tokens, len(string_split(p_brand || ' ||| ' || p_type, ' ||| ')) AS n_groups,
    round(sqrt((p_size * p_size + 1)::DOUBLE), 6) AS norm, p_size * 2.0::DOUBLE AS dot FROM part""")
def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions under their SQL names."""
    register(spark)
    t(spark, d, "part").createOrReplaceTempView("covarium_part")
    return spark.sql("""SELECT p_partkey, portable_int(p_name) AS draw, array_join(corpus_tokens(p_name), ',') AS tokens, cast(size(corpus_groups(concat(p_brand, ' ||| ', p_type))) AS BIGINT) AS n_groups,
        round(vec_norm(array(cast(p_size AS DOUBLE), 1D)), 6) AS norm, vec_dot(array(cast(p_size AS DOUBLE), 1D), array(2D, 0D)) AS dot FROM covarium_part""")


@query("""WITH w AS (SELECT DISTINCT unnest(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: x <> '')) || CASE WHEN p_size % 2 = 0 THEN 'é' ELSE '' END AS token FROM part),
g AS (SELECT token, n, i AS place, substr('<' || token || '>', i + 1, n) AS gram FROM (SELECT token, n, unnest(range(length(token) + 3 - n)) AS i FROM w, (SELECT unnest([3, 4]) AS n) WHERE length(token) + 2 >= n)),
b AS (SELECT *, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(hex(encode(gram))) // 2 + 1), lambda k: ('0x' || substr(hex(encode(gram)), 2 * k - 1, 2))::UHUGEINT)),
    lambda h, x: (xor(h, CASE WHEN x >= 128 THEN x + 18446744073709551360::UHUGEINT ELSE x END) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 5000)::BIGINT AS bucket FROM g)
SELECT 'gram' AS kind, token AS key, n::BIGINT AS n, (place * 100000 + bucket)::DOUBLE AS value FROM b
UNION ALL SELECT 'mean', label::VARCHAR, j, round(avg(x), 5) + 0.0 FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings) GROUP BY label, j""")
def registered_table_functions(spark: SparkSession, d: str) -> DataFrame:
    """The table function of n-grams, over words with and without a letter beyond ASCII, and the aggregate of vector means, from SQL."""
    register(spark, 3, 4, 5000)
    t(spark, d, "part").createOrReplaceTempView("covarium_part")
    t(spark, d, "embeddings").createOrReplaceTempView("covarium_embeddings")
    return spark.sql("""WITH w AS (SELECT DISTINCT concat(x, CASE WHEN p_size % 2 = 0 THEN 'é' ELSE '' END) AS token FROM (SELECT p_size, corpus_tokens(concat(p_name, ' ', lower(p_type))) AS ts FROM covarium_part) LATERAL VIEW explode(ts) AS x)
        SELECT 'gram' AS kind, token AS key, CAST(g.n AS BIGINT) AS n, CAST(g.at * 100000 + g.bucket AS DOUBLE) AS value FROM w, LATERAL ngrams(w.token) AS g
        UNION ALL SELECT 'mean', CAST(label AS STRING), CAST(j AS BIGINT), round(x, 5) + 0.0 FROM (SELECT label, vec_mean(embedding) AS v FROM covarium_embeddings GROUP BY label) LATERAL VIEW posexplode(v) AS j, x""")


# ---------------------------------------------------------------- guards and small functions


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN list_transform(embedding, lambda x: 0.0) ELSE embedding END::DOUBLE[] AS x FROM embeddings), w AS (SELECT *, sqrt(list_inner_product(x, x)) AS n FROM v),
s AS (SELECT q.vec_id AS qid, c.vec_id AS idx, list_inner_product(q.x, c.x) / (c.n * q.n) AS similarity FROM w q, w c WHERE q.vec_id % 50 = 0 AND q.n >= 1e-8 AND c.n >= 1e-8),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, idx) AS rank FROM s)
SELECT qid, rank, idx, round(similarity, 5) AS similarity FROM r WHERE rank <= 5""")
def knn_with_zero_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A query or a candidate without length gives nothing."""
    c = _candidates(spark, d).withColumn("vec", F.when(F.col("idx") % 7 == 3, F.transform("vec", lambda x: F.lit(0.0))).otherwise(F.col("vec"))).withColumn("norm", vectors.norm(F.col("vec")))
    r = search.nearest(c.filter("idx % 50 = 0").select(F.col("idx").alias("qid"), "vec"), c, 5)
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "idx", F.round("similarity", 5).alias("similarity"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR vec_id % 5 = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) END AS square FROM embeddings""")
def finite_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector with a part that isn't finite becomes zero."""
    bad = F.when(F.col("vec_id") % 3 == 0, F.array_append("embedding", F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 5 == 0, F.array_append("embedding", F.lit(float("-inf")).cast("float"))).otherwise(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", vectors.finite_or_zero(bad).alias("v")).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 5).alias("square"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, {_SQL_ROUND.format("list_transform(x, lambda y: y * CASE WHEN n > 0.9 THEN 0.9::DOUBLE / n ELSE 1.0 END)")} AS clipped, {_SQL_ROUND.format("x")} AS free FROM v""")
def clipped_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors shortened to a length of 0.9; a limit of zero disables it."""
    e = t(spark, d, "embeddings")
    return e.select("vec_id", _round(vectors.clip_norm(F.col("embedding"), 0.9)).alias("clipped"), _round(vectors.clip_norm(F.col("embedding"), 0.0)).alias("free"))


@query("""SELECT o_orderkey, round(greatest(0.05::DOUBLE * 1e-4::DOUBLE, 0.05::DOUBLE * (1 - step / total::DOUBLE)), 9) AS lr
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS step, count(*) OVER () * 3 // 4 AS total FROM orders)""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """The step size at each line of a corpus, by the lines before it; the schedule ends at three quarters, after which the least size holds."""
    steps = dense_index(t(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], "step")
    total = steps.agg((F.count(F.lit(1)) * 3 / 4).cast("long").alias("total"))
    return steps.join(F.broadcast(total)).select("o_orderkey", F.round(training.learning_rate_at(0.05, F.col("step"), F.col("total")), 9).alias("lr"))  # one row on the right


@query("""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
r AS (SELECT vec_id // 10 AS replicate_id, vec_id % 10 AS slot, x FROM v), s AS (SELECT b.replicate_id, b.slot AS base, t.slot AS target, list_inner_product(b.x, t.x) AS similarity FROM r b JOIN r t USING (replicate_id) WHERE b.slot < 3 AND t.slot >= 8),
q AS (SELECT base, target, quantile_cont(similarity::DOUBLE, 0.025) AS lo, quantile_cont(similarity::DOUBLE, 0.975) AS hi FROM s WHERE replicate_id > 0 AND target = 8 GROUP BY ALL)
SELECT 'w' || base || ' x p' || base || ' ' AS base_label, 't' || target || '  e' AS target_label, CASE WHEN q.lo IS NULL THEN 'N/A' ELSE printf('[%.4f, %.4f]', q.lo, q.hi) END AS ci_text
FROM (SELECT base, target FROM s WHERE replicate_id = 0) o LEFT JOIN q USING (base, target)""")
def interval_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of both sides and the interval as text; a pair without replicates has none."""
    v = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("replicate_id"), (F.col("vec_id") % 10).alias("qid"), vectors.normalized(F.col("embedding")).alias("vec"))
    sims = uncertainty.similarities(v.filter("qid < 3"), v.filter("qid >= 8")).filter("replicate_id = 0 OR target = 8")
    ci = uncertainty.formatted(uncertainty.intervals(sims))
    none = F.array().cast("array<string>")
    word = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    base = uncertainty.label(F.array(word("w", "base"), F.lit("x")), F.array(word("p", "base"), F.lit("p")), none)
    target = uncertainty.label(F.array(word("t", "target"), F.lit("more")), none, F.array(F.lit("e")), True)
    return ci.select(base.alias("base_label"), target.alias("target_label"), "ci_text")


# ---------------------------------------------------------------- models and their commands

#: CTEs over the toy model: only the patient token of each query, projected and of unit length.
A_SQL = f"""{V_SQL}, az AS (SELECT vec_id AS qid, list_transform(range(8), lambda j: ((label + j) % 5 - 2) / 4.0::DOUBLE) AS z FROM embeddings),
ah AS (SELECT qid, list(list_inner_product(wrow[65:72], z) ORDER BY r) AS h FROM az, wm GROUP BY qid)"""


@query(f"WITH {A_SQL} SELECT qid, {_SQL_ROUND.format('list_transform(h, lambda x: CASE WHEN sqrt(list_inner_product(h, h)) > 1e-8 THEN x / sqrt(list_inner_product(h, h)) ELSE x END)')} AS vec FROM ah")
def group_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Queries with one of their groups alone."""
    return compose.group_vector(_pair_queries(spark, d), toy_model(spark, d), ("patient",)).select("qid", _round("vec").alias("vec"))


@query("""WITH m AS (SELECT 'input' AS matrix, vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT 'ngram', i, list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) / 64.0::DOUBLE) FROM (SELECT unnest(range(1000)) AS i)
  UNION ALL SELECT 'W_proj', i, list_transform(range(72), lambda j: ((i * 5 + j * 3) % 7 - 3) / 8.0::DOUBLE) FROM (SELECT unnest(range(16)) AS i)
  UNION ALL SELECT 'patient', i, list_transform(range(8), lambda j: ((i + j) % 5 - 2) / 4.0::DOUBLE) FROM (SELECT unnest(range(10)) AS i)
  UNION ALL SELECT 'output', i, list_transform(range(16), lambda j: 0.0::DOUBLE) FROM (SELECT unnest(range((SELECT count(*) - 1 FROM embeddings))) AS i)),
x AS (SELECT matrix AS part, count(*) AS n, round(sum(list_sum(list_transform(v, lambda y: y * (i % 13 + 1)))), 3) AS checked FROM m GROUP BY matrix)
SELECT * FROM x UNION ALL SELECT 'tokens', count(*) + 10, sum(length('w' || vec_id))::DOUBLE + 70 FROM embeddings""")
def model_file(spark: SparkSession, d: str) -> DataFrame:
    """A model through the native binary file, written and read in parts: sums over all matrices, and over the tokens."""
    at = scratch(spark)
    model_store.write_binary(toy_model(spark, d), f"{at}.bin")
    atexit.register(delete, spark, f"{at}.bin")
    m = model_store.from_binary(spark, f"{at}.bin")
    own = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")) * (F.col("row_idx") % 13 + 1)
    sums = m.matrices.groupBy(F.col("matrix").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(own) + 0.0, 3).alias("checked"))
    return sums.unionByName(m.vocab.agg(F.lit("tokens").alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).cast("double").alias("checked")))


@query("""WITH k AS (SELECT n_nationkey AS i FROM nation WHERE n_nationkey > 0 AND n_nationkey % 8 <> 0), g AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM k)
SELECT 0::BIGINT AS replicate_id UNION ALL SELECT i::BIGINT FROM g WHERE i = r""")
def ensemble_members(spark: SparkSession, d: str) -> DataFrame:
    """The original and its replicates up to the first missing number."""
    names = ["m.bin", "other", *[f"m_boot_{r[0]}" for r in t(spark, d, "nation").filter("n_nationkey > 0 AND n_nationkey % 8 <> 0").select("n_nationkey").collect()]]
    return spark.createDataFrame([(i,) for i in model_store.replicate_ids(names, "m")], "replicate_id long")


_KNOWN = "tok AS (SELECT vec_id AS id, 'w' || vec_id AS token, embedding::DOUBLE[] AS own FROM embeddings)"
_AND_OTHERS = _KNOWN[:-1] + " UNION ALL SELECT -1 - vec_id, 'x' || vec_id, list_transform(range(64), lambda j: 0.0::DOUBLE) FROM embeddings)"


@query(f"WITH {V_SQL.replace(_KNOWN, _AND_OTHERS)} SELECT token, list_transform(vec, lambda x: round(x, 6) + 0.0) AS vec FROM wv")
def stored_word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all words of a model that is stored by row, and of as many outside its vocabulary, which are their n-grams alone."""
    at = scratch(spark)
    model_store.save(toy_model(spark, d), f"{at}/model", 16)
    e = t(spark, d, "embeddings")
    words = e.select(F.explode(F.array(F.concat(F.lit("w"), F.col("vec_id")), F.concat(F.lit("x"), F.col("vec_id")))).alias("token"))
    return compose.word_vectors(words, model_store.load(spark, f"{at}/model")).select("token", _round("vec", 6).alias("vec"))  # n-gram sums are 64ths, which six places hold


def _saved(spark: SparkSession, d: str) -> str:
    at = scratch(spark)
    model_store.save(toy_model(spark, d), f"{at}/model")
    return f"{at}/model"


_ONE_SQL = f"""{V_SQL},
qw AS (SELECT list_concat(list_transform(range(1, 65), lambda k: (a.vec[k] + b.vec[k]) / 2), list_transform(range(8), lambda j: ((3 + j) % 5 - 2) / 4.0::DOUBLE)) AS z FROM wv a, wv b WHERE a.token = 'w0' AND b.token = 'w1'),
qh AS (SELECT list(list_inner_product(wrow, z) ORDER BY r) AS h FROM qw, wm),
q AS (SELECT list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS vec FROM qh)"""


@query(f"""WITH {_ONE_SQL} SELECT id AS idx, token, round(list_inner_product(q.vec, pv.vec) / sqrt(list_inner_product(pv.vec, pv.vec)), 5) AS similarity FROM pv, q
ORDER BY list_inner_product(q.vec, pv.vec) / sqrt(list_inner_product(pv.vec, pv.vec)) DESC, id LIMIT 7""")
def command_query(spark: SparkSession, d: str) -> DataFrame:
    """The `query` command on a stored model."""
    r = cli.query(spark, [_saved(spark, d), "w0", "--patient", "label:3", "--k", "7", "w1"])
    return r.withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {_ONE_SQL}, o AS (SELECT list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS vec FROM (SELECT vec AS h FROM pv WHERE token = 'w2')), c AS (SELECT list_inner_product(q.vec, o.vec) AS c, list_distance(q.vec, o.vec) AS e FROM q, o)
SELECT round(c, 5) AS cosine, round(1 - c, 5) AS distance, round(e, 5) AS euclid, CASE WHEN c > 0.8 THEN 'Very similar' WHEN c > 0.5 THEN 'Moderately similar' WHEN c > 0.2 THEN 'Weakly similar' WHEN c > -0.2 THEN 'Unrelated' ELSE 'Opposite' END AS label FROM c""")
def command_compare(spark: SparkSession, d: str) -> DataFrame:
    """The `compare` command on a stored model."""
    r = cli.compare(spark, [_saved(spark, d), "--words1", "w0", "w1", "--patient1", "label:3", "--words2", "w2"])
    return r.select(*[F.round(c, 5).alias(c) for c in ("cosine", "distance", "euclid")], "label")


@query(f"""WITH {_ONE_SQL}, w AS (SELECT r, j, ((r * 5 + j * 3) % 7 - 3) / 8.0::DOUBLE AS x FROM (SELECT unnest(range(16)) AS r), (SELECT unnest(range(72)) AS j)),
b AS (SELECT 'norm' AS kind, block AS name, round(sqrt(sum(x * x)), 5) AS value FROM (SELECT CASE WHEN j < 64 THEN 'word' ELSE 'patient' END AS block, x FROM w UNION ALL SELECT 'all', x FROM w) GROUP BY block),
n AS (SELECT 'neighbour' AS kind, token AS name, round(list_inner_product(q.vec, pv.vec) / sqrt(list_inner_product(pv.vec, pv.vec)), 5) AS value FROM pv, q ORDER BY list_inner_product(q.vec, pv.vec) / sqrt(list_inner_product(pv.vec, pv.vec)) DESC, id LIMIT 5),
p AS (SELECT 'vector' AS kind, (i - 1)::VARCHAR AS name, round(vec[i], 5) + 0.0 AS value FROM q, (SELECT unnest(range(1, 17)) AS i))
SELECT * FROM b UNION ALL SELECT * FROM n UNION ALL SELECT * FROM p""")
def command_inspect(spark: SparkSession, d: str) -> DataFrame:
    """The `inspect` command: block norms, the vector of a query and its neighbours."""
    r = cli.inspect(spark, [_saved(spark, d), "w0", "w1", "--patient", "label:3"])
    return r.select("kind", "name", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"""WITH {V_SQL}, i AS (SELECT unnest([0, 1, 2, 3]) AS rep),
z AS (SELECT rep, list_concat(a.vec, list_transform(range(8), lambda j: (1 + rep) * ((3 + j) % 5 - 2) / 4.0::DOUBLE)) AS z FROM wv a, i WHERE a.token = 'w0'),
h AS (SELECT rep, list(list_inner_product(wrow, z) ORDER BY r) AS h FROM z, wm GROUP BY rep),
s AS (SELECT rep, list_inner_product(h.h, pv.vec) / sqrt(list_inner_product(h.h, h.h)) / sqrt(list_inner_product(pv.vec, pv.vec)) AS s FROM h, pv WHERE pv.token = 'w5'),
q AS (SELECT quantile_cont(s::DOUBLE, 0.025) AS lo, quantile_cont(s::DOUBLE, 0.975) AS hi, count(*) AS n FROM s WHERE rep > 0)
SELECT 'w0 label:3 ' AS base_label, 'w5  ' AS target_label, round(s.s, 4) AS similarity, round(lo, 4) AS lo, round(hi, 4) AS hi, n FROM s, q WHERE rep = 0""")
def command_compare_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The `compare-bootstrap` command over an original and three replicates, whose patient vectors are longer the later they come."""
    at, m = scratch(spark), toy_model(spark, d)
    for i in range(4):
        scaled = m.matrices.withColumn("vec", F.when(F.col("matrix") == "patient", F.transform("vec", lambda x: (x * (1 + i)).cast("float"))).otherwise(F.col("vec")))
        model_store.save(model_store.Model(m.meta, m.vocab, scaled), f"{at}/model" + (f"_boot_{i}" if i else ""))
    for name, line in (("bases", "w0 ||| label:3 ||| "), ("targets", "w5 ||| ||| ")):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{at}/{name}")
    r = cli.compare_bootstrap(spark, [f"{at}/bases", f"{at}/targets", f"{at}/model"])
    return r.select("base_label", "target_label", *[F.round(c, 4).alias(c) for c in ("similarity", "lo", "hi")], "n")


@query("SELECT 'patient' AS group_name, 'label:' || label AS token FROM (SELECT DISTINCT label FROM embeddings)")
def command_dump_fields(spark: SparkSession, d: str) -> DataFrame:
    """The `dump-fields` command: the file's lines."""
    at = _saved(spark, d)
    cli.dump_fields(spark, [at, f"{at}-fields"])
    return spark.read.text(f"{at}-fields/patient").select(F.lit("patient").alias("group_name"), F.col("value").alias("token"))


@query("""WITH st AS MATERIALIZED (SELECT p_size AS subject_id, p_partkey AS row_id, lower(p_brand) AS p, 'size:' || p_size AS e, [p_name, lower(p_type)] AS ss FROM part),
n AS (SELECT subject_id, row_id, row_number() OVER (PARTITION BY subject_id ORDER BY row_id) - 1 AS note FROM st), k AS (SELECT subject_id, count(*) AS k, row_number() OVER (ORDER BY subject_id) - 1 AS ord FROM st GROUP BY subject_id),
i AS (SELECT rep, i AS instance, ('0x' || substr(md5(rep || '-' || i), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS ord FROM (SELECT unnest([1, 2]) AS rep), (SELECT unnest(range((SELECT count(*) FROM k))) AS i)),
j AS (SELECT rep, instance, subject_id, k, unnest(range(k)) AS draw FROM i JOIN k USING (ord)),
x AS (SELECT rep, subject_id, ('0x' || substr(md5(rep || '-' || instance || '-' || draw), 1, 8))::BIGINT % k AS note FROM j),
l AS (SELECT 0 AS rep, p, e, unnest(ss) AS s FROM st UNION ALL SELECT rep, p, e, unnest(ss) FROM x JOIN n USING (subject_id, note) JOIN st USING (subject_id, row_id)),
g AS (SELECT rep, 'word' AS group_name, unnest(string_split(s, ' ')) AS token FROM l UNION ALL SELECT rep, 'patient', p FROM l UNION ALL SELECT rep, 'encounter', e FROM l)
SELECT rep::BIGINT AS replicate_id, group_name, token, count(*) AS freq FROM g WHERE token <> '' GROUP BY ALL""")
def command_bootstrap_run(spark: SparkSession, d: str) -> DataFrame:
    """The `bootstrap-run` command with two replicates, read back as one ensemble: the vocabularies that each model was trained on."""
    at, p = scratch(spark), t(spark, d, "part")
    table = p.select(F.col("p_size").alias("SUBJECT_ID"), F.col("p_partkey").alias("ROW_ID"), F.lower("p_brand").alias("patient_group"), F.concat(F.lit("size:"), F.col("p_size")).alias("encounter_group"), F.array("p_name", F.lower("p_type")).alias("Sentences"))
    table.write.parquet(f"{at}/sentences")
    flags = "-d-word 4 -d-patient 2 -d-encounter 2 -d-out 4 -epoch 1 -threshold 1 -ngram-buckets 500 -maxn 4".split()
    cli.bootstrap_run(spark, ["--input", f"{at}/sentences", "--out", f"{at}/model", "--replicates", "2", *flags])
    m = model_store.ensemble(spark, at, "model")
    each = [m.words(g).select(F.col("replicate_id").cast("bigint").alias("replicate_id"), F.lit(g).alias("group_name"), "token", "freq") for g in model_store.GROUPS]
    return each[0].unionByName(each[1]).unionByName(each[2])
