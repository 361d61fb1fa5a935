"""Text functions as Column builders: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of the three groups of a corpus line; a blank on either side belongs to it.
GROUP_SEP = " ||| "
_GROUP_SEP_RE = r" \|\|\| "
#: White space of the C locale, which is what corpus tokens are cut at; a no-break space stays inside its token.
TOKEN_SPACE = r"[ \t\n\x0B\f\r]+"
ASCII_SPACE = r"[ \t\n\r\f]+"
TAG_RE = r"\[\*\*.*?\*\*\]"
MIN_SENTENCE = 20


def tokens(text: Column) -> Column:
    """White-space tokens; null gives null."""
    return F.filter(F.split(text, TOKEN_SPACE), lambda x: x != "")


def split_groups(line: Column) -> Column:
    """The pieces between strict separators; a separator needs a blank on either side."""
    return F.split(line, _GROUP_SEP_RE, -1)


def collapse_space(text: Column, ascii_only: bool = False) -> Column:
    return F.trim(F.regexp_replace(text, ASCII_SPACE if ascii_only else r"(?U)\s+", " "))


def clean_text(text: Column, ascii_only: bool = False) -> Column:
    """White space is collapsed first and characters that don't print are dropped then, so a zero-width character joins its neighbours. Null counts as empty."""
    c = collapse_space(F.coalesce(text, F.lit("")), ascii_only)
    return c if ascii_only else F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ ]]", "")


#: Words (without their full stop, in any case) after which a full stop ends no sentence.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "st", "sr", "jr", "vs", "etc", "e\\.g", "i\\.e", "no", "approx", "dept", "est", "fig", "pt", "pts", "hosp", "resp", "temp", "wt", "ht", "a\\.m", "p\\.m"]
_SENTENCE_END = rf"(?<=[.!?])(?<!(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(ABBREVIATIONS)})\.)(?<!(?<![\p{{L}}\p{{N}}.])\p{{L}}\.)\s+"


def split_sentences(text: Column) -> Column:
    """After `.`, `!` or `?` and white space, but not after the full stop of a known abbreviation or of a single letter, an initial. A rule, not a trained model; see operators.sentences for a hook."""
    return F.split(text, _SENTENCE_END)


def split_marks(text: Column) -> Column:
    """After every `.`, `!` or `?` with white space behind it."""
    return F.split(text, r"(?<=[.!?])\s+")


def drop_tags(sentence: Column) -> Column:
    """Without de-identification tags, in lower case. Tags are looked for inside one sentence, so one that a sentence end cuts stays."""
    return F.lower(F.regexp_replace(sentence, TAG_RE, ""))


def letter_tokens(sentence: Column, ascii_only: bool = False) -> Column:
    """Tokens without a digit, reduced to a-z, hyphen, slash and backslash; what is left empty goes. Two expressions over the whole sentence, not one for each token: the first drops tokens with a digit (it can only
    begin where a token does, so it is linear in a token's length), the second all letters but those kept and white space."""
    space, digit = (r" \t\n\r\f", "0-9") if ascii_only else (r" \t\n\x0B\f\r", r"\p{Nd}")
    plain = F.regexp_replace(sentence, f"(?<![^{space}])[^{space}{digit}]*+[{digit}][^{space}]*+", "")
    return F.filter(F.split(F.regexp_replace(plain, rf"[^a-z/\\\-{space}]", ""), f"[{space}]+"), lambda w: w != "")


def clean_sentence(sentence: Column, ascii_only: bool = False) -> Column:
    return F.array_join(letter_tokens(drop_tags(sentence), ascii_only), " ")


def sentences(text: Column, min_len: int = MIN_SENTENCE, ascii_only: bool = False, splitter=split_sentences) -> Column:
    """Cleaned sentences of at least `min_len` characters, measured after cleaning."""
    return F.filter(F.transform(splitter(clean_text(text, ascii_only)), lambda s: clean_sentence(s, ascii_only)), lambda s: F.length(s) >= min_len)


def normalize_key(value: Column) -> Column:
    """Stripped, in lower case, with underscores for blanks: the form in which category dictionaries are keyed."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), " ", "_")


def normalize_label(value: Column) -> Column:
    """In lower case with underscores for blanks; not stripped."""
    return F.regexp_replace(F.lower(value.cast("string")), " ", "_")


def key_value(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ":"), F.regexp_replace(value, " ", "_"))


def group_string(columns: list[str]) -> Column:
    """`name:value` tokens of the columns; null values go, and those whose token contains `unknown` in any case."""
    parts = []
    for c in columns:
        kv = key_value(c, F.col(c).cast("string"))
        parts.append(F.when(~F.lower(kv).contains("unknown"), kv))
    return F.concat_ws(" ", *parts)
