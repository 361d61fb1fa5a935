"""Quality rules as a bitmask ledger.

One pass over the whole texts takes every measurement; each rule is then evaluated once into one bit of `failed`. A policy is a named, versioned mask
over these bits, so another policy, or the effect of leaving one rule out, is a bitwise expression over the stored ledger and never touches a text again.

Defined results: a null or empty text has no words and fails `few_words`; a line counts as repeated if it holds a word and equals an earlier line
byte for byte (a text ending in a newline adds one empty line, which holds no word); windows never span texts; duplicate rows are judged alike;
extra columns are dropped from the ledger, whose only input columns are the id and the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import append

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Rule name -> failing condition over the measurements. The order fixes the bit numbers; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_ratio": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 25 * n_words OR word_chars < 2 * n_words",
    "few_letters": "2 * n_letter_words < n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base-1": mask("few_words", "repeated_windows"),
    "web-1": mask("few_words", "repeated_windows", "symbol_ratio", "repeated_lines", "word_length", "few_letters"),
}
PRODUCTION = "web-1"
LEDGER = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_letter_words long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` consecutive words that occur at least twice in the text, the first occurrence included. Exact: words get dense numbers, windows get dense ranks."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    u = len(seen)
    if u == len(words):
        return 0
    code, span = ids[:n].copy(), u
    for k in range(1, window):
        if span * u >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code = code * u + ids[k : k + n]
        span *= u
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_BLANK = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))
_CONTINUATION = bytes(range(0x80, 0xC0))


def measure(texts: list[bytes]) -> list[tuple[int, ...]]:
    out: list[tuple] = []
    for t in texts:
        words = t.split()
        lines = [x for x in t.split(b"\n") if x.strip(_BLANK)]
        joined = b"".join(words)
        letters = len(b" ".join(words).translate(None, _LETTERS.replace(b" ", b"")).split())
        out.append((
            len(words),
            len(joined.translate(None, _CONTINUATION)),
            len(joined) - len(joined.translate(None, SYMBOLS)),
            len(lines),
            len(lines) - len(set(lines)),
            repeat_words(words),
            letters,
        ))
    return list(zip(*out, strict=True))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, all measurements and the bitmask `failed`."""
    m = append(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["text"], measure, LEDGER, drop=("text",))
    return m.withColumn("failed", failures())


def failures() -> Column:
    """The bitmask of the rules that a row of measurements fails."""
    bits = sum((F.when(F.expr(f"({cond})"), F.lit(BITS[name])).otherwise(F.lit(0)) for name, cond in RULES.items()), F.lit(0))
    return bits.cast("long")


def kept(policy: str = PRODUCTION, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects (they return if the rule goes). One aggregation over at most 2**rules masks."""
    m = POLICIES[policy]
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [n for n in RULES if BITS[n] & m]
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in names]))
    per = masks.select("bits", "n", rule.alias("r"))
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def filter_documents(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns: rows carry their own verdict through one pass, without a join or a shuffle."""
    names = docs.columns
    fields = LEDGER.split(", ")
    tagged = append(docs.toDF(*[f"_d{i}" for i in range(len(names))]), [f"_d{names.index(text_col)}"], measure, LEDGER)
    assert len(tagged.columns) == len(names) + len(fields)
    return tagged.withColumn("failed", failures()).filter(kept(policy)).select(*[F.col(f"_d{i}") for i in range(len(names))]).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from covarium.llm.common import documents

    book = ledger(documents(spark, sf_dir))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base-1"])) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept().alias("kept"), "failed", "n_lines", "n_letter_words")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (SELECT unnest([0, 1, 2, 3, 4]) AS k)
  WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letter_words < n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_letter_words FROM f
"""


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """The effect of each rule of the production policy, from the ledger's bits alone."""
    from covarium.llm.common import documents

    return ablations(ledger(documents(spark, sf_dir)))


ABLATION_SQL = f"""WITH l AS ({SQL}), r AS (SELECT unnest({[*RULES]}) AS rule, unnest({[*BITS.values()]}) AS bit)
SELECT rule, coalesce(sum(CASE WHEN failed & bit <> 0 THEN 1 END), 0)::BIGINT AS n_failed, coalesce(sum(CASE WHEN failed = bit THEN 1 END), 0)::BIGINT AS n_only FROM l, r GROUP BY rule"""
