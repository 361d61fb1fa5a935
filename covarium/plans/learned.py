"""Sentence boundaries learned from the documents: the statistics, and what they cut, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.operators import boundaries
from covarium.plans.catalogue import query, t
from covarium.session import spread

#: Two common words of the documents become abbreviations; what they stood before stays.
_ABBREVIATED = (("[ ](de|the)[ ]", " approx. "), ("[ ](la|with)[ ]", " e.g. "))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    for pattern, word in _ABBREVIATED:
        text = F.regexp_replace(text, pattern, word)
    return spread(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", text.alias("text"))


_SQL_TEXT = "text"
for _pattern, _word in _ABBREVIATED:
    _SQL_TEXT = f"regexp_replace({_SQL_TEXT}, '{_pattern}', '{_word}', 'g')"


def _ll(k: str, n: str, p: str) -> str:
    return f"((CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0.0 END) + (CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - ({p})) ELSE 0.0 END))"


def _association(both: str, first: str, second: str, total: str) -> str:
    p, p1, p2 = f"({second} / {total})", f"({both} / {first})", f"(({second} - {both}) / ({total} - {first}))"
    return f"2 * ({_ll(both, first, p1)} + {_ll(f'({second} - {both})', f'({total} - {first})', p2)} - {_ll(both, first, p)} - {_ll(f'({second} - {both})', f'({total} - {first})', p)})"


_SQL = rf"""
tk AS MATERIALIZED (SELECT doc_id, pos, tok, regexp_replace(regexp_replace(lower(tok), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') AS type FROM (
  SELECT doc_id, unnest(w) AS tok, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex({_SQL_TEXT}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents))),
rw AS MATERIALIZED (SELECT *, tok LIKE '%.' AS stop, lead(type) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS behind FROM tk),
ty AS MATERIALIZED (SELECT type, count(*)::DOUBLE AS n, count(*) FILTER (stop)::DOUBLE AS k FROM rw GROUP BY type),
sm AS (SELECT sum(n) AS tokens, sum(k) AS stops FROM ty),
pr AS MATERIALIZED (SELECT type, nxt, count(*)::DOUBLE AS both_ FROM rw WHERE stop AND nxt IS NOT NULL GROUP BY ALL),
ab AS MATERIALIZED (SELECT * FROM (SELECT type, 2 * ({_ll('k', 'n', '0.99::DOUBLE')} - {_ll('k', 'n', 'greatest(least(stops / tokens, 1 - 1e-12), 1e-12)')}) * exp(-size) * (length(type) - size + 1) * pow(size, k - n) AS score
  FROM (SELECT *, length(replace(type, '.', ''))::DOUBLE AS size FROM ty, sm WHERE k > 0 AND regexp_matches(type, '\p{{L}}') AND NOT regexp_matches(type, '^\p{{L}}$'))) WHERE score >= {boundaries.ABBREVIATION}),
kn AS MATERIALIZED (SELECT pr.*, ab.type IS NOT NULL OR regexp_matches(pr.type, '^\p{{L}}$') OR regexp_matches(pr.type, '^[0-9.,:/-]+$') AS open FROM pr LEFT JOIN ab ON ab.type = pr.type),
en AS (SELECT nxt, sum(both_) AS both_ FROM kn WHERE NOT open GROUP BY nxt), br AS (SELECT sum(both_) AS breaks FROM en),
st AS MATERIALIZED (SELECT * FROM (SELECT nxt AS type, {_association('both_', 'breaks', 'n', 'tokens')} AS score FROM en JOIN ty ON ty.type = nxt, br, sm WHERE nxt <> '' AND both_ / breaks > n / tokens) WHERE score >= {boundaries.STARTER}),
fi AS (SELECT type, sum(both_) AS first FROM kn WHERE open GROUP BY type),
co AS MATERIALIZED (SELECT * FROM (SELECT kn.type, nxt, {_association('both_', 'first', 'n', 'tokens')} AS score FROM kn JOIN fi ON fi.type = kn.type JOIN ty ON ty.type = nxt, sm WHERE open AND nxt <> '' AND both_ > 1 AND both_ / first > n / tokens) WHERE score >= {boundaries.COLLOCATION})"""


@query(f"""WITH {_SQL} SELECT 'abbreviation' AS kind, type, '' AS next, round(score, 3) AS score FROM ab
UNION ALL SELECT 'starter', type, '', round(score, 3) FROM st UNION ALL SELECT 'collocation', type, nxt, round(score, 3) FROM co""")
def boundary_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviations, starters and collocations of the documents, with their scores."""
    found = boundaries.learn(_texts(spark, d), "text")
    rows = lambda df, kind, behind: df.select(F.lit(kind).alias("kind"), "type", behind.alias("next"), F.round("score", 3).alias("score"))
    none = F.lit("")
    return rows(found.abbreviations, "abbreviation", none).unionByName(rows(found.starters, "starter", none)).unionByName(rows(found.collocations, "collocation", F.col("next")))


@query(rf"""WITH {_SQL} SELECT doc_id, (1 + count(*) FILTER (behind IS NOT NULL AND regexp_matches(tok, '[.!?]$') AND (NOT stop OR (co.type IS NULL AND
    CASE WHEN ab.type IS NOT NULL OR regexp_matches(rw.type, '^\p{{L}}$') THEN st.type IS NOT NULL AND regexp_matches(behind, '^\p{{Lu}}') ELSE NOT (regexp_matches(rw.type, '^[0-9.,:/-]+$') AND regexp_matches(behind, '^\p{{Ll}}')) END))))::BIGINT AS n_sentences
FROM rw LEFT JOIN ab ON ab.type = rw.type LEFT JOIN st ON st.type = rw.nxt LEFT JOIN co ON co.type = rw.type AND co.nxt = rw.nxt GROUP BY doc_id""")
def trained_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document that has a token, cut by the boundaries learned from all."""
    docs = _texts(spark, d)
    cut = docs.withColumn("s", boundaries.splitter(boundaries.learn(docs, "text"))(F.col("text")))
    return cut.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"))
