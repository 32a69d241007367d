"""Text expressions with the semantics the review tables need."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Markers that a CSV reader of the source data treats as null.
NULL_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Words that the Treebank tokenizer splits in two (can not, gim me,
# gon na, got ta, lem me, wan na).
CONTRACTIONS = r"(?<![^ ])(can(?=not)|(?:gim|lem)(?=me)|(?:gon|wan)(?=na)|got(?=ta))(not|me|na|ta)(?![^ ])"

# Letters kept by the normaliser.
LETTERS = "a-záéíóúñü"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(col, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def squeeze(col: Column) -> Column:
    """Collapse each run of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(col, f"{WHITESPACE}+", " "))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def normalise(col: Column) -> Column:
    """Lower case, letters only, single spaces; null gives the empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), f"[^{LETTERS}]+", " "))


def content_tokens(col: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens of the normalised text without stop words, as an array."""
    spaced = F.regexp_replace(normalise(col), CONTRACTIONS, "$1 $2")
    if not stop_words:
        return F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.filter(F.split(spaced, " "), lambda w: ~w.isin(["", *stop_words]))


def default_stop_words(language: str = "spanish") -> list[str]:
    """Spark's own stop-word list for the language."""
    return list(StopWordsRemover.loadDefaultStopWords(language))


def words(col: Column) -> Column:
    """Runs of letters and digits, case kept, as an array."""
    return F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]+"), 0)


def shifted(tokens: Column, n: int) -> Column:
    """One struct ``w0 .. w(n-1)`` per position: the word there and the next ones."""
    rest = [
        F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1))).alias(f"w{i}")
        for i in range(1, n)
    ]
    return F.arrays_zip(tokens.alias("w0"), *rest)
