"""Named queries over the test tables, and the same in SQL where SQL can say it.

The tables stand in for clinical ones: documents are notes, customers patients, orders admissions, suppliers caregivers, embeddings a word matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.functions import categories, hashing, text, vectors
from covarium.functions.hashing import ngram_texts, portable_int
from covarium.operators import compose, covariates, huffman, resample, search, sentences, skipgram, training, uncertainty, vocabulary
from covarium.session import spread
from covarium.sources import corpus, model_store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return spread(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.letter_tokens(F.lower("text"), True).alias("words"))


def _word_counts(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.token_counts(_words(spark, d), {"word": "words"})


#: CTE: the words of the cleaned corpus.
W_SQL = r"""
w AS (
  SELECT doc_id, list_filter(list_transform(list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')),
         lambda x: regexp_replace(x, '[^a-z/\\-]', '', 'g')), lambda x: x <> '') AS words FROM documents
), c AS (
  SELECT token, count(*) AS freq FROM (SELECT unnest(words) AS token FROM w) GROUP BY token
)"""


# ---------------------------------------------------------------- vocabulary


@query(f"WITH {W_SQL} SELECT row_number() OVER (ORDER BY freq DESC, token) - 1 AS idx, token, freq FROM c WHERE freq >= 5")
def vocab_words(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.indexed(_word_counts(spark, d), 5)


def _group_samples(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = t(spark, d, "orders"), t(spark, d, "customer"), t(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    kv = lambda name, col: text.key_value(name, F.lower(col))
    return j.select(F.array(kv("segment", "c_mktsegment"), kv("nation", "n_name")).alias("patient"), F.array(kv("priority", "o_orderpriority"), kv("status", "o_orderstatus")).alias("encounter"), F.array().cast("array<string>").alias("words"))


G_SQL = """
g AS (
  SELECT 'patient' AS group_name, 'segment:' || replace(lower(c_mktsegment), ' ', '_') AS token FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'patient', 'nation:' || replace(lower(n_name), ' ', '_') FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'encounter', 'priority:' || replace(lower(o_orderpriority), ' ', '_') FROM orders
  UNION ALL SELECT 'encounter', 'status:' || replace(lower(o_orderstatus), ' ', '_') FROM orders
), gc AS (SELECT group_name, token, count(*) AS freq FROM g GROUP BY ALL)"""


@query(f"WITH {G_SQL} SELECT group_name, row_number() OVER (PARTITION BY group_name ORDER BY freq DESC, token) - 1 AS idx, token, freq FROM gc")
def vocab_groups(spark: SparkSession, d: str) -> DataFrame:
    v = vocabulary.vocabularies(vocabulary.token_counts(_group_samples(spark, d)))
    return vocabulary.stacked({g: v[g] for g in ("patient", "encounter")})


@query(
    f"""WITH {W_SQL}, {G_SQL} SELECT (SELECT count(*) FROM c) AS unique_words, (SELECT count(*) FROM c WHERE freq >= 5) AS kept_words, (SELECT count(*) FROM c WHERE freq < 5) AS dropped_words,
    (SELECT sum(freq)::BIGINT FROM c WHERE freq >= 5) AS kept_total, (SELECT count(*) FROM gc WHERE group_name = 'patient') AS patient_tokens, (SELECT count(*) FROM gc WHERE group_name = 'encounter') AS encounter_tokens"""
)
def vocab_summary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.summary(_word_counts(spark, d).unionByName(vocabulary.token_counts(_group_samples(spark, d))))


@query(f"WITH {W_SQL}, k AS (SELECT * FROM c WHERE freq >= 5) SELECT token, freq, round(greatest(0.0::DOUBLE, 1 - sqrt(0.0001::DOUBLE * (SELECT sum(freq)::DOUBLE FROM k) / freq)), 6) AS discard_prob FROM k")
def discard_probs(spark: SparkSession, d: str) -> DataFrame:
    v = vocabulary.with_discard(_word_counts(spark, d).filter("freq >= 5").select("token", "freq"))
    return v.select("token", "freq", F.round("discard_prob", 6).alias("discard_prob"))


#: CTEs over c (token, freq): the vocabulary with at least 5 occurrences, the tree's merges one after the other (m keeps one row), its edges, and codes and paths from the root down.
H_SQL = """
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY freq DESC, token) - 1 AS idx, token, freq FROM c WHERE freq >= 5),
f AS MATERIALIZED (SELECT list(freq ORDER BY idx) AS fr, count(*) AS n FROM v),
m(k, leaf, inr, w, a, b) USING KEY (k) AS (
  SELECT 0, n, 1::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM f
  UNION
  SELECT 0, leaf2, inr2, list_append(w, (CASE WHEN one THEN fr[leaf] ELSE w[inr] END + CASE WHEN two THEN fr[leaf1] ELSE w[inr1] END)::BIGINT),
    list_append(a, CASE WHEN one THEN leaf - 1 ELSE n + inr - 1 END), list_append(b, CASE WHEN two THEN leaf1 - 1 ELSE n + inr1 - 1 END)
  FROM (SELECT *, leaf1 - two::BIGINT AS leaf2, inr1 + (NOT two)::BIGINT AS inr2 FROM (
    SELECT *, leaf1 >= 1 AND (inr1 > len(w) OR fr[leaf1] <= w[inr1]) AS two FROM (
      SELECT *, leaf - one::BIGINT AS leaf1, inr + (NOT one)::BIGINT AS inr1 FROM (
        SELECT *, leaf >= 1 AND (inr > len(w) OR fr[leaf] <= w[inr]) AS one FROM m, f WHERE len(w) < n - 1))))
),
e AS MATERIALIZED (SELECT n + j - 1 AS up, a[j] AS node, 0 AS bit FROM m, f, (SELECT unnest(range(1, n)) AS j FROM f) UNION ALL SELECT n + j - 1, b[j], 1 FROM m, f, (SELECT unnest(range(1, n)) AS j FROM f)),
d(node, code, path) AS (
  SELECT greatest(2 * n - 2, 0), []::INTEGER[], []::INTEGER[] FROM f WHERE n > 0
  UNION ALL SELECT e.node, list_append(code, bit::INTEGER), list_append(path, (up - n)::INTEGER) FROM d JOIN e ON e.up = d.node, f
)"""


@query(f"WITH RECURSIVE {W_SQL}, {H_SQL} SELECT idx, token, freq, code, path FROM v JOIN d ON node = idx")
def huffman_codes(spark: SparkSession, d: str) -> DataFrame:
    return huffman.with_codes(vocabulary.indexed(_word_counts(spark, d), 5))


@query(f"""WITH RECURSIVE {W_SQL}, {H_SQL} SELECT count(*) AS words, min(len(path)) AS min_depth, max(len(path)) AS max_depth, (sum(len(path)) // count(*))::BIGINT AS avg_depth,
    count(*) FILTER (len(path) = 0) AS zero_depth, sum(len(path) * freq)::BIGINT AS weighted_length FROM v JOIN d ON node = idx""")
def huffman_stats(spark: SparkSession, d: str) -> DataFrame:
    s = huffman.depth_stats(huffman_codes(spark, d))
    return s.select(*[F.col(c).cast("bigint").alias(c) for c in s.columns])


@query(f"WITH {W_SQL}, v AS (SELECT row_number() OVER (ORDER BY freq DESC, token) - 1 AS idx, token FROM c WHERE freq >= 5) SELECT p_partkey, k.token, coalesce(v.idx, -1) AS idx FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) k LEFT JOIN v ON v.token = k.token")
def token_lookup(spark: SparkSession, d: str) -> DataFrame:
    tokens = t(spark, d, "part").select("p_partkey", F.explode(text.tokens(F.col("p_name"))).alias("token"))
    return vocabulary.lookup(tokens, vocab_words(spark, d))


@query("SELECT token FROM (SELECT 'nation:' || lower(n_name) AS token FROM nation UNION SELECT 'region:' || lower(r_name) FROM region) ORDER BY token")
def group_dump(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.concat(F.lit("nation:"), F.lower("n_name")).alias("token"))
    r = t(spark, d, "region").select(F.concat(F.lit("region:"), F.lower("r_name")).alias("token"))
    return vocabulary.field_dump(n.union(r).distinct())


# ---------------------------------------------------------------- covariates

_PICK = {  # column: raw values, chosen by a key's remainder
    "LANGUAGE": ["ENGL", "SPAN", "*CHI", "XXXX"],
    "RELIGION": ["CATHOLIC", "GREEK ORTHODOX", "OTHER", "NONE", " JEWISH "],
    "ETHNICITY": ["WHITE", "BLACK/AFRICAN", "ASIAN - CHINESE", "MARTIAN", "HISPANIC OR LATINO", "OTHER"],
    "MARITAL_STATUS": ["MARRIED", "UNKNOWN (DEFAULT)", "SINGLE"],
    "LABEL": ["RN", " MD ", "Co-Ord", "zzz", "MS,RD"],
}


def _pick(col: str, key: str):
    return F.element_at(F.array(*map(F.lit, _PICK[col])), (F.col(key) % len(_PICK[col]) + 1).cast("int"))


def _sql_pick(col: str, key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in _PICK[col])}], ({key} % {len(_PICK[col])} + 1)::INT)"


def clinical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(notes, patients, admissions, caregivers) in the clinical schemas."""
    o, li, c, s, docs = (t(spark, d, x) for x in ("orders", "lineitem", "customer", "supplier", "documents"))
    counts = c.agg(F.count(F.lit(1)).alias("nc")).join(o.agg(F.count(F.lit(1)).alias("no"))).join(s.agg(F.count(F.lit(1)).alias("ns")))
    n = docs.join(F.broadcast(counts))  # one row
    notes = n.select(F.col("doc_id").alias("ROW_ID"), (F.col("doc_id") % F.col("nc")).alias("SUBJECT_ID"), F.when(F.col("source") != "src0", F.col("doc_id") % F.col("no")).alias("HADM_ID"), (F.col("doc_id") % F.col("ns")).alias("CGID"), F.col("text").alias("TEXT"))
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    a = o.join(last, o.o_orderkey == last.l_orderkey, "left")
    adm = a.select(F.col("o_orderkey").alias("HADM_ID"), F.col("o_orderdate").cast("string").alias("ADMITTIME"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("no time")).otherwise(F.col("last").cast("string")).alias("DISCHTIME"),
        F.col("o_orderpriority").alias("ADMISSION_TYPE"), F.col("o_orderstatus").alias("INSURANCE"), *[_pick(x, "o_orderkey").alias(x) for x in ("LANGUAGE", "RELIGION", "MARITAL_STATUS", "ETHNICITY")],
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("HOSPITAL_EXPIRE_FLAG"))
    born = F.expr("timestamp'1992-01-01 00:00:00' - make_dt_interval(CAST((c_custkey * 397) % 36500 AS INT))")
    pat = c.select(F.col("c_custkey").alias("SUBJECT_ID"), born.cast("string").alias("DOB"), F.when(F.col("c_custkey") % 3 == 0, F.lit("F")).when(F.col("c_custkey") % 3 == 1, F.lit("M")).alias("GENDER"))
    return notes, pat, adm, s.select(F.col("s_suppkey").alias("CGID"), _pick("LABEL", "s_suppkey").alias("LABEL"))


def _sql_map(name: str, col: str) -> str:
    pairs = ", ".join("'{}': '{}'".format(k.replace("'", "''"), v) for k, v in categories.DICTIONARIES[name].items())
    return f"coalesce(MAP {{{pairs}}}[replace(lower(trim({col})), ' ', '_')], 'unknown')"


MERGE_SQL = f"""
k AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM orders) AS no, (SELECT count(*) FROM supplier) AS ns),
notes AS (SELECT doc_id AS row_id, doc_id % nc AS subject_id, CASE WHEN source <> 'src0' THEN doc_id % no END AS hadm_id, doc_id % ns AS cgid, text FROM documents, k),
adm AS (
  SELECT o_orderkey AS hadm_id, o_orderdate AS admitted, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) END AS left_at,
    o_orderpriority AS admission_type, o_orderstatus AS insurance, {_sql_pick("LANGUAGE", "o_orderkey")} AS language, {_sql_pick("RELIGION", "o_orderkey")} AS religion,
    {_sql_pick("MARITAL_STATUS", "o_orderkey")} AS marital_status, {_sql_pick("ETHNICITY", "o_orderkey")} AS ethnicity, CASE WHEN o_orderstatus = 'F' THEN 'dead' ELSE 'alive' END AS mortality FROM orders
),
pat AS (SELECT c_custkey AS subject_id, TIMESTAMP '1992-01-01 00:00:00' - to_days(((c_custkey * 397) % 36500)::INT) AS born, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender FROM customer),
cg AS (SELECT s_suppkey AS cgid, {_sql_pick("LABEL", "s_suppkey")} AS label FROM supplier),
j AS (
  SELECT notes.subject_id, row_id, text, floor(datesub('day', born, admitted) / 365.0) AS age, datesub('day', admitted, left_at) AS stay, gender, ethnicity, language, religion, marital_status, insurance, label, admission_type, mortality
  FROM notes LEFT JOIN cg USING (cgid) LEFT JOIN pat ON pat.subject_id = notes.subject_id LEFT JOIN adm USING (hadm_id)
),
merged AS (
  SELECT subject_id AS "SUBJECT_ID", row_id AS "ROW_ID",
    CASE WHEN age >= 80 THEN 'elderly' WHEN age >= 65 THEN 'aged' WHEN age >= 45 THEN 'middle_aged' WHEN age >= 24 THEN 'adult' WHEN age >= 19 THEN 'young_adult' WHEN age >= 13 THEN 'adolescent' WHEN age >= 2 THEN 'child' ELSE 'infant' END AS age_group,
    lower(gender) AS gender, {_sql_map("ethnicity", "ethnicity")} AS ethnicity, {_sql_map("language", "language")} AS language, {_sql_map("religion", "religion")} AS religion,
    replace(lower(marital_status), ' ', '_') AS marital_status, replace(lower(insurance), ' ', '_') AS insurance, {_sql_map("caregiver_role", "label")} AS caregiver_role, replace(lower(admission_type), ' ', '_') AS admission_type,
    CASE WHEN stay >= 30 THEN 'long' WHEN stay >= 14 THEN 'prolonged' WHEN stay >= 7 THEN 'extended' WHEN stay >= 3 THEN 'moderate' ELSE 'short' END AS length_of_stay, mortality, text AS "TEXT" FROM j
)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return covariates.merge_notes(*clinical(spark, d))


@query(f"WITH {MERGE_SQL} SELECT * FROM merged")
def merge_notes(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


_SQL_GROUP = lambda cols: "concat_ws(' ', " + ", ".join(f"CASE WHEN NOT contains(lower('{c}:' || {c}), 'unknown') THEN '{c}:' || replace({c}, ' ', '_') END" for c in cols) + ")"


@query(f'WITH {MERGE_SQL} SELECT "ROW_ID", {_SQL_GROUP(covariates.PATIENT_COLS)} AS patient_group, {_SQL_GROUP(covariates.ENCOUNTER_COLS)} AS encounter_group FROM merged')
def group_strings(spark: SparkSession, d: str) -> DataFrame:
    return covariates.with_groups(_merged(spark, d)).select("ROW_ID", "patient_group", "encounter_group")


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN s >= 30 THEN 'Long' WHEN s >= 14 THEN 'Prolonged' WHEN s >= 7 THEN 'Extended' WHEN s >= 3 THEN 'Moderate' ELSE 'Short' END AS bucket
    FROM (SELECT datesub('day', o_orderdate, l_shipdate) AS s FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)) GROUP BY bucket""")
def length_of_stay_buckets(spark: SparkSession, d: str) -> DataFrame:
    j = t(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy(covariates.stay_group(covariates.whole_days(F.col("l_shipdate"), F.col("o_orderdate"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT age_group, count(*) AS n, min(age)::BIGINT AS min_age, max(age)::BIGINT AS max_age FROM (SELECT age, CASE WHEN age >= 80 THEN 'Elderly' WHEN age >= 65 THEN 'Aged' WHEN age >= 45 THEN 'Middle_Aged' WHEN age >= 24 THEN 'Adult'
    WHEN age >= 19 THEN 'Young_Adult' WHEN age >= 13 THEN 'Adolescent' WHEN age >= 2 THEN 'Child' ELSE 'Infant' END AS age_group FROM (SELECT floor(datesub('day', o_orderdate - to_days(((o_custkey * 397) % 36500)::INT), o_orderdate) / 365.0) AS age FROM orders)) GROUP BY age_group""")
def age_buckets(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderdate", F.expr("o_orderdate - make_dt_interval(CAST((o_custkey * 397) % 36500 AS INT))").alias("born"))
    a = o.select(covariates.age(F.col("o_orderdate"), F.col("born")).alias("age"))
    return a.groupBy(covariates.age_group(F.col("age")).alias("age_group")).agg(F.count(F.lit(1)).alias("n"), F.min("age").cast("bigint").alias("min_age"), F.max("age").cast("bigint").alias("max_age"))


@query(f"""SELECT o_orderkey, {_sql_map("language", _sql_pick("LANGUAGE", "o_orderkey"))} AS language, {_sql_map("religion", _sql_pick("RELIGION", "o_orderkey"))} AS religion, {_sql_map("ethnicity", _sql_pick("ETHNICITY", "o_orderkey"))} AS ethnicity,
    replace({_sql_map("caregiver_role", _sql_pick("LABEL", "o_orderkey"))}, 'unknown', 'other') AS caregiver FROM orders""")
def category_recode(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", categories.language(_pick("LANGUAGE", "o_orderkey")).alias("language"), categories.religion(_pick("RELIGION", "o_orderkey")).alias("religion"), categories.ethnicity(_pick("ETHNICITY", "o_orderkey")).alias("ethnicity"), categories.caregiver_title(_pick("LABEL", "o_orderkey")).alias("caregiver"))


# ---------------------------------------------------------------- sentences and corpus

#: CTE: cleaned sentences by ASCII classes, at least 20 characters.
S_SQL = r"""
s AS (
  SELECT doc_id, lang, source, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)),
    lambda x: array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(regexp_replace(x, '\[\*\*.*?\*\*\]', '', 'g')), '[ \t\n\r\f]+'), lambda y: y <> '' AND NOT regexp_matches(y, '[0-9]')),
      lambda y: regexp_replace(y, '[^a-z/\\-]', '', 'g')), lambda y: y <> ''), ' ')), lambda x: length(x) >= 20) AS ss FROM documents
)"""


#: CTE: cleaned sentences by Unicode classes: white space is collapsed, characters that don't print go, and a mark ends no sentence after an abbreviation or an initial.
_WHITE = r"[\t\n\x0B\f\r \x85\p{Z}]"
_AFTER_ABBREVIATION = r"(^|[^\p{L}\p{N}])((?:(?i:" + "|".join(text.ABBREVIATIONS) + r"))[.]) "
_AFTER_INITIAL = r"(^|[^\p{L}\p{N}.])([\p{L}][.]) "


def _twice(t: str, protect: str) -> str:
    """Blanks that end no sentence become U+0001; a second pass finds those whose left neighbour the first one took."""
    once = f"regexp_replace({t}, '{protect}', '\\1\\2' || chr(1), 'g')"
    return f"regexp_replace({once}, '{protect}', '\\1\\2' || chr(1), 'g')"


U_SQL = rf"""
u0 AS (SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '{_WHITE}+', ' ', 'g')), '[\p{{C}}\x{{2028}}\x{{2029}}]', '', 'g') AS t FROM documents),
u1 AS (SELECT doc_id, {_twice(_twice("t", _AFTER_ABBREVIATION), _AFTER_INITIAL)} AS t FROM u0),
u AS (
  SELECT doc_id AS row_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)),
    lambda x: array_to_string(list_filter(list_transform(list_filter(string_split(lower(regexp_replace(replace(x, chr(1), ' '), '\[\*\*.*?\*\*\]', '', 'g')), ' '), lambda y: y <> '' AND NOT regexp_matches(y, '\p{{Nd}}')),
      lambda y: regexp_replace(y, '[^a-z/\\-]', '', 'g')), lambda y: y <> ''), ' ')), lambda x: length(x) >= 20) AS ss FROM u1
)"""


def _sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(t(spark, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    return docs.select("doc_id", "lang", "source", text.sentences(F.col("text"), ascii_only=True, splitter=text.split_marks).alias("Sentences"))


@query(f"WITH {S_SQL} SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS pos, unnest(ss) AS sentence FROM s WHERE len(ss) > 0")
def clean_sentences(spark: SparkSession, d: str) -> DataFrame:
    return resample.explode_sentences(_sentence_rows(spark, d).select("doc_id", "Sentences")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {S_SQL} SELECT 'lang:' || lang || ' ||| source:' || source || ' ||| ' || unnest(ss) AS value FROM s")
def explode_corpus(spark: SparkSession, d: str) -> DataFrame:
    e = resample.explode_sentences(_sentence_rows(spark, d))
    return e.select(corpus.line(text.key_value("lang", F.col("lang")), text.key_value("source", F.col("source")), F.col("sentence")).alias("value"))


@query(f"WITH {S_SQL} SELECT count(DISTINCT source) AS n_patients, count(*) AS n_notes, sum(len(ss))::BIGINT AS n_sentences FROM s WHERE len(ss) > 0")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return sentences.totals(_sentence_rows(spark, d).filter(F.size("Sentences") > 0).withColumnRenamed("source", "SUBJECT_ID"))


@query(f"""WITH {MERGE_SQL}, {U_SQL} SELECT subject_id AS "SUBJECT_ID", row_id AS "ROW_ID", {_SQL_GROUP(covariates.PATIENT_COLS)} AS patient_group, {_SQL_GROUP(covariates.ENCOUNTER_COLS)} AS encounter_group, ss AS "Sentences"
    FROM merged JOIN u USING (row_id) WHERE len(ss) > 0""")
def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    """Whole chain from clinical tables to sentences, with Unicode classes and the rule that knows abbreviations."""
    return sentences.sentence_table(_merged(spark, d))


_LINE_SQL = """
l AS (
  SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_mktsegment || ' ||| ||| no ' || c_name WHEN 1 THEN c_mktsegment || ' |||  ||| ' || c_name || ' stable' WHEN 2 THEN ' |||  ||| ' || c_name
    WHEN 3 THEN c_mktsegment || ' ||| a ||| ' WHEN 4 THEN 'a ||| b ||| c ||| d' WHEN 5 THEN c_mktsegment || chr(9) || 'x ||| in  out ||| ' || c_name || chr(13) ELSE c_name END AS value FROM customer
), p AS (
  SELECT c_custkey, string_split(value, ' ||| ') AS g FROM l
), q AS (
  SELECT c_custkey, len(g) AS n_groups, list_filter(string_split_regex(coalesce(g[1], ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS patient,
    list_filter(string_split_regex(coalesce(g[2], ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS encounter, list_filter(string_split_regex(coalesce(g[3], ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM p
)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    k, seg, name = F.col("c_custkey") % 7, F.col("c_mktsegment"), F.col("c_name")
    v = F.when(k == 0, F.concat(seg, F.lit(" ||| ||| no "), name)).when(k == 1, F.concat(seg, F.lit(" |||  ||| "), name, F.lit(" stable"))).when(k == 2, F.concat(F.lit(" |||  ||| "), name))
    v = v.when(k == 3, F.concat(seg, F.lit(" ||| a ||| "))).when(k == 4, F.lit("a ||| b ||| c ||| d")).when(k == 5, F.concat(seg, F.lit("\tx ||| in  out ||| "), name, F.lit("\r"))).otherwise(name)
    return c.select("c_custkey", v.alias("value"))


@query(f"WITH {_LINE_SQL} SELECT c_custkey, array_to_string(patient, ',') AS patient, array_to_string(encounter, ',') AS encounter, array_to_string(words, ',') AS words FROM q WHERE n_groups = 3 AND len(words) > 0")
def parse_corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    s = corpus.training_samples(_lines(spark, d))
    return s.select("c_custkey", *[F.array_join(c, ",").alias(c) for c in ("patient", "encounter", "words")])


@query(f"WITH {_LINE_SQL} SELECT c_custkey, n_groups, CASE WHEN n_groups <> 3 THEN 'groups' ELSE 'no_words' END AS reason FROM q WHERE n_groups <> 3 OR len(words) = 0")
def bad_corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.bad_records(_lines(spark, d)).select("c_custkey", F.col("n_groups").cast("bigint").alias("n_groups"), "reason")


@query(f"WITH {_LINE_SQL} SELECT c_custkey, len(patient) AS n_patient, len(encounter) AS n_encounter, len(words) AS n_words FROM q WHERE n_groups = 3")
def count_corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    s = corpus.counting_samples(_lines(spark, d))
    return s.select("c_custkey", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("patient", "encounter", "words")])


@query("""SELECT c_custkey, array_to_string(string_split(lower(c_name), '#'), ',') AS words, 'segment:' || lower(c_mktsegment) AS patient, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE '' END AS encounter FROM customer WHERE c_custkey % 5 <> 0""")
def query_triples(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer")
    v = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")), F.lit("|||segment:"), F.lower("c_mktsegment"), F.lit(" ||| "), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("")))
    q = corpus.query_triples(c.select("c_custkey", v.alias("value")))
    return q.select("c_custkey", *[F.array_join(x, ",").alias(x) for x in ("words", "patient", "encounter")])


# ---------------------------------------------------------------- resampling


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS note FROM orders),
p AS (SELECT o_custkey, count(*) AS k, row_number() OVER (ORDER BY o_custkey) - 1 AS ord FROM orders GROUP BY o_custkey),
r AS (SELECT unnest([42, 43]) AS replicate_id),
i AS (SELECT replicate_id, i AS instance, ('0x' || substr(md5(replicate_id || '-' || i), 1, 8))::BIGINT % (SELECT count(*) FROM p) AS ord FROM r, (SELECT unnest(range((SELECT count(*) FROM p))) AS i)),
j AS (SELECT replicate_id, instance, o_custkey, k, unnest(range(k)) AS draw FROM i JOIN p USING (ord)),
x AS (SELECT *, ('0x' || substr(md5(replicate_id || '-' || instance || '-' || draw), 1, 8))::BIGINT % k AS note FROM j)
SELECT replicate_id, instance, draw, o_custkey, o_orderkey FROM x JOIN n USING (o_custkey, note)
""")
def bootstrap_sample(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap_notes(t(spark, d, "orders"), None, "o_custkey", "o_orderkey", [42, 43])


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle-42-' || doc_id), doc_id) - 1 AS place FROM documents")
def shuffle_rank(spark: SparkSession, d: str) -> DataFrame:
    from covarium.operators.ranking import dense_index

    docs = t(spark, d, "documents").select("doc_id").withColumn("k", resample.shuffle_key(42, F.col("doc_id")))
    return dense_index(docs, [F.col("k"), F.col("doc_id")], "place").select("doc_id", "place")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
g AS (SELECT token, n, unnest(range(length(token) + 3 - n)) AS i FROM w, (SELECT unnest([3, 4, 5]) AS n) WHERE length(token) + 2 >= n)
SELECT token, gram, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(gram, ''), lambda x: ord(x)::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 2000000)::BIGINT AS bucket
FROM (SELECT token, substr('<' || token || '>', i + 1, n) AS gram FROM g)
""")
def ngram_buckets(spark: SparkSession, d: str) -> DataFrame:
    w = t(spark, d, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("token")).distinct()
    z = F.arrays_zip(ngram_texts(F.col("token"), 3, 5).alias("gram"), hashing.ngram_buckets(F.col("token"), 3, 5, 2_000_000).alias("bucket"))
    return w.select("token", F.explode(z).alias("z")).select("token", F.col("z.gram").alias("gram"), F.col("z.bucket").alias("bucket"))


@query(f"""WITH {W_SQL},
p AS (SELECT doc_id, len(words) AS n, unnest(range(len(words))) AS pos FROM w),
x0 AS (SELECT doc_id, n, pos, (('0x' || substr(md5('42-' || doc_id), 1, 8))::BIGINT + pos * {skipgram.STEP}) & 4294967295 AS x FROM p),
x1 AS (SELECT doc_id, n, pos, (xor(x, x >> {skipgram.MIX[0][1]}) * {skipgram.MIX[0][0]}) & 4294967295 AS x FROM x0), x2 AS (SELECT doc_id, n, pos, (xor(x, x >> {skipgram.MIX[1][1]}) * {skipgram.MIX[1][0]}) & 4294967295 AS x FROM x1),
q AS (SELECT doc_id, n, pos, xor(x, x >> 15) % 5 + 1 AS win FROM x2),
r AS (SELECT doc_id, pos, greatest(0, pos - win) AS lo, least(n - 1, pos + win) AS hi FROM q)
SELECT doc_id, sum(hi - lo)::BIGINT AS n_pairs, sum((lo + hi) * (hi - lo + 1) // 2 - pos)::BIGINT AS ctx_pos_sum, sum(pos * (hi - lo))::BIGINT AS pos_sum FROM r WHERE hi > lo GROUP BY doc_id""")
def skipgram_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = skipgram.positions(_words(spark, d), ["doc_id"])
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("ctx_pos").alias("ctx_pos_sum"), F.sum("pos").alias("pos_sum"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_draw(what: str, n: int) -> str:
    return f"(('0x' || substr(md5('42-{what}-' || id), 1, 8))::BIGINT % {n})"


def _sql_choice(what: str, values) -> str:
    return f"list_extract({_sql_list(values)}, {_sql_draw(what, len(values))} + 1)"


def _sql_sample(what: str, fields: dict, most: int) -> str:
    keyed = ", ".join(f"{{'k': ('0x' || substr(md5('42-{what}-order-{k}-' || id), 1, 8))::BIGINT, 'name': '{k}', 'v': {_sql_choice(f'{what}-{k}', v)}}}" for k, v in fields.items())
    return f"array_to_string(list_transform(list_sort([{keyed}])[1:{_sql_draw(f'{what}-count', most + 1)}], lambda s: s.v), ' ')"


def _sql_filled() -> str:
    out = _sql_choice("template", corpus.TEMPLATES)
    for slot, values in corpus.SLOTS.items():
        out = f"replace({out}, '{{{slot}}}', {_sql_choice(slot, values)})"
    return out


#: Lines of the registered query; the generator's own default is a million.
DEMO_ROWS = 100_000


@query(f"SELECT id, {_sql_sample('patient', corpus.FIELDS, 5)} || ' ||| ' || {_sql_sample('encounter', corpus.ENCOUNTER_FIELDS, 2)} || ' ||| ' || {_sql_filled()} AS value FROM range({DEMO_ROWS}) t(id)")
def synthetic_corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus.synthetic_corpus(spark, DEMO_ROWS)


# ---------------------------------------------------------------- vectors


def toy_model(spark: SparkSession, d: str) -> model_store.Model:
    """Embeddings as the word matrix, labels as patient tokens, and formulas for the rest: a model that SQL can rebuild."""
    e = t(spark, d, "embeddings")
    words = e.select(F.lit("word").alias("group_name"), F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id")).alias("token"), F.lit(1).cast("long").alias("freq"))
    groups = e.select("label").distinct().select(F.lit("patient").alias("group_name"), F.col("label").cast("long").alias("idx"), F.concat(F.lit("label:"), F.col("label")).alias("token"), F.lit(1).cast("long").alias("freq"))
    none = F.lit(None).cast("array<int>")
    vocab = words.unionByName(groups).withColumns({"code": none, "path": none})
    row = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    m = e.select(F.lit("input").alias("matrix"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    m = m.unionByName(spark.range(1000).select(F.lit("ngram").alias("matrix"), F.col("id").alias("row_idx"), row(64, lambda j: (((F.col("id") * 7 + j * 3) % 11 - 5) / F.lit(64.0)).cast("float")).alias("vec")))
    m = m.unionByName(spark.range(16).select(F.lit("W_proj").alias("matrix"), F.col("id").alias("row_idx"), row(72, lambda j: (((F.col("id") * 5 + j * 3) % 7 - 3) / F.lit(8.0)).cast("float")).alias("vec")))
    m = m.unionByName(groups.select(F.lit("patient").alias("matrix"), F.col("idx").alias("row_idx"), row(8, lambda j: (((F.col("idx") + j) % 5 - 2) / F.lit(4.0)).cast("float")).alias("vec")))
    meta = {"d_word": 64, "d_patient": 8, "d_encounter": 0, "d_out": 16, "min_n": 3, "max_n": 4, "threshold": 1, "window_size": 5, "ngram_buckets": 1000}
    return model_store.Model(meta, vocab, m)


#: CTEs: raw vectors (wv), projected ones (pv), and composed ones of word pairs with a patient token (cv).
V_SQL = """
tok AS (SELECT vec_id AS id, 'w' || vec_id AS token, embedding::DOUBLE[] AS own FROM embeddings),
gr AS (SELECT id, token, substr('<' || token || '>', i + 1, n) AS gram FROM (SELECT id, token, n, unnest(range(length(token) + 3 - n)) AS i FROM tok, (SELECT unnest([3, 4]) AS n) WHERE length(token) + 2 >= n)),
bk AS (SELECT id, ((list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(gram, ''), lambda x: ord(x)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)) % 1000)::BIGINT AS b FROM gr),
ng AS (SELECT id, j, sum(((b * 7 + j * 3) % 11 - 5) / 64.0::DOUBLE) AS x FROM bk, (SELECT unnest(range(64)) AS j) GROUP BY id, j),
nv AS (SELECT id, list(x ORDER BY j) AS v FROM ng GROUP BY id),
wv AS (SELECT tok.id, token, list_transform(range(1, 65), lambda k: own[k] + v[k]) AS vec FROM tok JOIN nv USING (id)),
wm AS (SELECT r, list_transform(range(72), lambda j: ((r * 5 + j * 3) % 7 - 3) / 8.0::DOUBLE) AS wrow FROM (SELECT unnest(range(16)) AS r)),
pv AS (SELECT id, token, list(list_inner_product(wrow[1:64], vec) ORDER BY r) AS vec FROM wv, wm GROUP BY id, token),
qz AS (
  SELECT a.id AS qid, list_concat(list_transform(range(1, 65), lambda k: (a.vec[k] + b.vec[k]) / 2), list_transform(range(8), lambda j: ((e.label + j) % 5 - 2) / 4.0::DOUBLE)) AS z
  FROM wv a JOIN wv b ON b.id = (a.id + 1) % (SELECT count(*) FROM embeddings) JOIN embeddings e ON e.vec_id = a.id
),
hv AS (SELECT qid, list(list_inner_product(wrow, z) ORDER BY r) AS h FROM qz, wm GROUP BY qid),
cv AS (SELECT qid, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS vec FROM hv)"""

_round = lambda c, n=5: F.transform(c, lambda x: F.round(x, n) + F.lit(0.0))
_SQL_ROUND = "list_transform({}, lambda x: round(x, 5) + 0.0)"


def _all_words(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id")).alias("token"))


@query(f"WITH {V_SQL} SELECT token, {_SQL_ROUND.format('vec')} AS vec FROM wv")
def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    return compose.word_vectors(_all_words(spark, d), toy_model(spark, d)).select("token", _round("vec").alias("vec"))


@query(f"WITH {V_SQL} SELECT id AS idx, token, {_SQL_ROUND.format('vec')} AS vec, round(sqrt(list_inner_product(vec, vec)), 5) AS norm FROM pv")
def project_words(spark: SparkSession, d: str) -> DataFrame:
    return compose.word_cache(toy_model(spark, d)).select("idx", "token", _round("vec").alias("vec"), F.round("norm", 5).alias("norm"))


def _pair_queries(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return q.select(F.col("vec_id").alias("qid"), F.array(F.concat(F.lit("w"), F.col("vec_id")), F.concat(F.lit("w"), (F.col("vec_id") + 1) % F.col("n"))).alias("words"), F.array(F.concat(F.lit("label:"), F.col("label")), F.lit("label:none")).alias("patient"), F.array().cast("array<string>").alias("encounter"))


@query(f"WITH {V_SQL} SELECT qid, {_SQL_ROUND.format('vec')} AS vec FROM cv")
def compose_vectors(spark: SparkSession, d: str) -> DataFrame:
    return compose.combined(_pair_queries(spark, d), toy_model(spark, d)).select("qid", _round("vec").alias("vec"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id")).alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")).withColumn("norm", vectors.norm(F.col("vec")))


@query("""SELECT vec_id AS idx, 'w' || vec_id AS token, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q)), 5) AS similarity
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_inner_product(v, q) / sqrt(list_inner_product(v, v)) DESC, vec_id LIMIT 10""")
def knn_words(spark: SparkSession, d: str) -> DataFrame:
    q = t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]
    return search.nearest_one(q, _candidates(spark, d), 10).withColumn("similarity", F.round("similarity", 5))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.vec_id AS idx, list_inner_product(q.x, c.x) / (c.n * q.n) AS similarity FROM v q, v c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, idx) AS rank FROM s)
SELECT qid, rank, idx, 'w' || idx AS token, round(similarity, 5) AS similarity FROM r WHERE rank <= 10""")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    q = t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return search.nearest(q, _candidates(spark, d), 10).withColumns({"similarity": F.round("similarity", 5), "rank": F.col("rank").cast("bigint")})


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.x, b.x AS y FROM v a JOIN v b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM v)),
c AS (SELECT a_id, b_id, list_inner_product(x, y) / sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(y, y)) AS c,
  list_distance(list_transform(x, lambda k: k / sqrt(list_inner_product(x, x))), list_transform(y, lambda k: k / sqrt(list_inner_product(y, y)))) AS e FROM p)
SELECT a_id, b_id, round(c, 5) AS cosine, round(1 - c, 5) AS distance, round(e, 5) AS euclid,
  CASE WHEN c > 0.8 THEN 'Very similar' WHEN c > 0.5 THEN 'Moderately similar' WHEN c > 0.2 THEN 'Weakly similar' WHEN c > -0.2 THEN 'Unrelated' ELSE 'Opposite' END AS label FROM c""")
def compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    left = e.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))).select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("b_id"))  # one row
    c = search.compare(left.join(e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), "b_id"))
    return c.select("a_id", "b_id", *[F.round(x, 5).alias(x) for x in ("cosine", "distance", "euclid")], "label")


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings),
r AS (SELECT vec_id // 10 AS replicate_id, vec_id % 10 AS slot, x FROM v),
s AS (SELECT b.replicate_id, b.slot AS base, t.slot AS target, list_inner_product(b.x, t.x) AS similarity FROM r b JOIN r t USING (replicate_id) WHERE b.slot < 5 AND t.slot >= 5),
o AS (SELECT base, target, similarity FROM s WHERE replicate_id = 0),
q AS (SELECT base, target, quantile_cont(similarity::DOUBLE, 0.025) AS lo, quantile_cont(similarity::DOUBLE, 0.975) AS hi, count(*) AS n FROM s WHERE replicate_id > 0 GROUP BY ALL)
SELECT base, target, round(similarity, 5) AS similarity, round(lo, 5) AS lo, round(hi, 5) AS hi, coalesce(n, 0) AS n FROM o LEFT JOIN q USING (base, target)""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    v = e.select(F.floor(F.col("vec_id") / 10).alias("replicate_id"), (F.col("vec_id") % 10).alias("qid"), vectors.normalized(F.col("embedding")).alias("vec"))
    ci = uncertainty.intervals(uncertainty.similarities(v.filter("qid < 5"), v.filter("qid >= 5")))
    return ci.select("base", "target", *[F.round(x, 5).alias(x) for x in ("similarity", "lo", "hi")], "n")


@query("""WITH w AS (SELECT CASE WHEN j <= 40 THEN 'word' WHEN j <= 56 THEN 'patient' ELSE 'encounter' END AS block, x FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS j FROM embeddings))
SELECT block, round(sqrt(sum(x * x)), 4) AS norm FROM w GROUP BY block UNION ALL SELECT 'all', round(sqrt(sum(x * x)), 4) FROM w""")
def block_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norms of the columns of each group, of a projection with a row for each vector."""
    rows = t(spark, d, "embeddings").select(F.lit("W_proj").alias("matrix"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vec"))
    model = model_store.Model({"d_word": 40, "d_patient": 16, "d_encounter": 8}, None, rows)
    return compose.block_norms(model).select("block", F.round("norm", 4).alias("norm"))


@query("""SELECT matrix, sum(len(v))::BIGINT AS n_values, sum(len(list_filter(v, lambda x: isnan(x))))::BIGINT AS n_nan, sum(len(list_filter(v, lambda x: isinf(x))))::BIGINT AS n_inf FROM (
    SELECT 'label_' || label AS matrix, CASE WHEN vec_id % 3 = 0 THEN list_append(embedding, 'NaN'::FLOAT) WHEN vec_id % 5 = 0 THEN list_append(embedding, '-Infinity'::FLOAT) ELSE embedding END AS v FROM embeddings) GROUP BY matrix""")
def matrix_health(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("vec_id") % 3 == 0, F.array_append("embedding", F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 5 == 0, F.array_append("embedding", F.lit(float("-inf")).cast("float"))).otherwise(F.col("embedding"))
    return compose.matrix_health(t(spark, d, "embeddings").select(F.concat(F.lit("label_"), F.col("label")).alias("matrix"), extra.alias("vec")))


@query("""WITH p AS (SELECT vec_id, label % 2 AS target, 1 / (1 + exp(-greatest(-20.0, least(20.0, embedding[1]::DOUBLE * 10)))) AS p FROM embeddings)
SELECT target, count(*) AS n, round(sum(-(target * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - target) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))), 4) AS loss, round(sum(-(target * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - target) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))) / count(*), 5) AS mean_loss FROM p GROUP BY target""")
def loss_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "embeddings").select((F.col("label") % 2).alias("target"), vectors.sigmoid(F.col("embedding")[0].cast("double") * 10).alias("p"))
    loss = vectors.log_loss(F.col("target").cast("double"), F.col("p"))
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(loss), 4).alias("loss"), F.round(F.try_divide(F.sum(loss), F.count(F.lit(1))), 5).alias("mean_loss"))


def part_lines(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    words = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    return p.select("p_partkey", corpus.line(F.lower("p_brand"), F.concat(F.lit("size:"), F.col("p_size")), words).alias("value"))


TRAIN = dict(d_word=16, d_patient=4, d_encounter=4, d_out=16, epoch=2, ngram_buckets=50_000, subsample=0.01, weight_decay=1e-5, chunk_size=2_000)


@query()
def train_round_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs over the part names as a corpus, with subsampling and weight decay."""
    m = training.fit(part_lines(spark, d), training.Config(**TRAIN), key="p_partkey")[1]
    return m.select("epoch", F.round("avg_loss", 4).alias("avg_loss"), "predictions", "lr")


def _sql_mix(parts: str) -> str:
    """The trainer's draw in 64-bit arithmetic modulo 2**64."""
    m, x = "18446744073709551616::UHUGEINT", f"(({parts}) % 18446744073709551616::UHUGEINT)"
    for k, r in ((training.FINAL[0], 30), (training.FINAL[1], 27)):
        x = f"(xor({x}, {x} // {1 << r}::UHUGEINT) * {k}::UHUGEINT % {m})"
    return f"xor({x}, {x} // {1 << 31}::UHUGEINT)"


def _sql_draws(use: str) -> str:
    k = [f"{x}::UHUGEINT" for x in training.MULT]
    return _sql_mix(f"(({42 << 20} + epoch)::UHUGEINT * {k[0]}) % 18446744073709551616::UHUGEINT + (sample::UHUGEINT * {k[1]}) % 18446744073709551616::UHUGEINT + (pos::UHUGEINT * {k[2]}) % 18446744073709551616::UHUGEINT + (({use})::UHUGEINT * {k[3]}) % 18446744073709551616::UHUGEINT")


_SQL_UNIT = "(({}) // 2048::UHUGEINT)::DOUBLE / 9007199254740992.0::DOUBLE"


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT p_partkey AS sample, list_filter(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' '), lambda x: x <> '') AS words FROM part),
c AS (SELECT token, count(*) AS freq FROM (SELECT unnest(words) AS token FROM s) GROUP BY token), {H_SQL},
k AS MATERIALIZED (SELECT token, len(path) AS depth, greatest(0.0::DOUBLE, 1 - sqrt({TRAIN['subsample']}::DOUBLE * (SELECT sum(freq)::DOUBLE FROM v) / freq)) AS skip FROM v JOIN d ON node = idx),
p AS MATERIALIZED (SELECT epoch, sample, pos, depth, skip FROM (SELECT sample, unnest(words) AS token, unnest(range(len(words))) AS pos FROM s) JOIN k USING (token), (SELECT unnest(range({TRAIN['epoch']})) AS epoch)),
ce AS MATERIALIZED (SELECT epoch, sample, pos, 1 + ({_sql_draws('1')} % 5)::BIGINT AS win FROM p WHERE {_SQL_UNIT.format(_sql_draws('0'))} >= skip),
cx AS (SELECT epoch, sample, pos, depth FROM (SELECT ce.epoch, ce.sample, ce.pos, o.pos AS other, o.depth, o.skip FROM ce JOIN p o ON o.epoch = ce.epoch AND o.sample = ce.sample AND o.pos <> ce.pos AND abs(o.pos - ce.pos) <= win) WHERE {_SQL_UNIT.format(_sql_draws('2 + other'))} >= skip),
n AS (SELECT count(*) AS lines FROM s)
SELECT epoch + 1 AS epoch, sum(depth)::BIGINT AS predictions, any_value(lines) AS samples FROM cx, n GROUP BY epoch""")
def train_counts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of each epoch: every draw of windows and subsampling, and every path, counts."""
    lines = part_lines(spark, d)
    m = training.fit(lines, training.Config(**TRAIN), key="p_partkey")[1]
    return m.select(F.col("epoch").cast("bigint").alias("epoch"), "predictions", F.lit(lines.count()).cast("bigint").alias("samples"))


@query("SELECT doc_id, ('0x' || substr(md5('7-' || doc_id), 1, 8))::BIGINT AS draw FROM documents")
def portable_draws(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", portable_int(F.concat_ws("-", F.lit("7"), F.col("doc_id").cast("string"))).alias("draw"))
