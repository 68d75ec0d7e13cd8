"""Text expressions. Word characters are spelled out because Java's ``\\w`` is ASCII-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Character classes used by the cleaning rules.
WORD = r"([\p{L}\p{N}_]+)"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s]"
LATIN_WORD = r"([a-zA-Z]+)"
MASK_PREFIX = "^xxxx"
SPACE_AND_DIGITS = r" \p{Nd}+"


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(1))


def latin_words(text: Column | str) -> Column:
    """Lower-cased ``[a-zA-Z]+`` runs; accents split words by design."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(LATIN_WORD), F.lit(1))


def squeeze(text: Column) -> Column:
    """Runs of two or more blanks become one space."""
    return F.regexp_replace(text, r"\s\s+", " ")


def strip_noise(text: Column) -> Column:
    """Lower-case, drop punctuation, the mask prefix and numbers after a space."""
    plain = F.regexp_replace(F.lower(text), NOT_WORD_OR_SPACE, "")
    return F.regexp_replace(F.regexp_replace(plain, MASK_PREFIX, ""), SPACE_AND_DIGITS, " ")


def clean_document(text: Column, stop_words: Sequence[str]) -> Column:
    """Noise-free text without stop words, tokens joined by one space."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(strip_noise(text), r"\s+", " ")), " "), lambda w: w != "")
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*stop_words))
    return F.array_join(tokens, " ")


def explode_words(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per word with its position (0-based)."""
    return df.select(*keep, F.posexplode(words(text)).alias("pos", "word"))
