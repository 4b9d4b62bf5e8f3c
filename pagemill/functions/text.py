"""Text normalisation, error rates and line classes as Column expressions."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Characters read as others, stand-alone bullets, and what hints at a line of code.
QUOTES, QUOTES_AS = "‘’‚‛′“”„″‐‑‒–—− ", "'''''\"\"\"\"------ "
BULLETS = r"(?<!\S)[•·◦▪▫■□●○‣⁃∙*¢°�](?!\S)"
CODE = r"[(){};=\[\]]|^\s|^(import|def|class|return|for|while|try|except|SELECT|UPDATE|CREATE)\b"


def normalize(text: Column, lowercase: bool = True) -> Column:
    """Quotes and dashes unified, lone bullets dropped, whitespace collapsed, lower case. For text already in NFKC form (see :func:`nfkc`)."""
    plain = F.replace(F.translate(text, QUOTES, QUOTES_AS), F.lit("…"), F.lit("..."))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, BULLETS, " "), r"\s+", " "))
    return F.lower(plain) if lowercase else plain


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; the JVM side has no function for it."""
    for t in texts:
        yield t.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _rate(ref: Column, hyp: Column, edits: Column, size: Column) -> Column:
    """Edits by size; without a reference 0 if there is no hypothesis either, else 1."""
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(edits / size)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts; may exceed 1."""
    return _rate(ref, hyp, F.levenshtein(ref, hyp), F.length(ref))


def word_code(i: Column) -> Column:
    """The character for the i-th word: from 0x100 on without surrogates and byte order mark; with more words than there are it fails, so none collide."""
    skipped = F.when(i < 0xD800 - 0xFF, 0).when(i < 0xFEFF - 0x8FF, 0x800).otherwise(0x801)
    point = F.when(i > 0x10FFFF - 0x900, F.raise_error(F.lit("too many distinct words in a pair"))).otherwise(i + 0xFF + skipped)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of normalised texts: each distinct word of a pair becomes one code point, then these are compared."""
    words = lambda t: F.split(t, " ")
    known = F.array_distinct(F.concat(words(ref), words(hyp)))
    coded = lambda k, t: F.array_join(F.transform(words(t), lambda w: word_code(F.array_position(k, w))), "")
    edits = F.transform(F.array(known), lambda k: F.levenshtein(coded(k, ref), coded(k, hyp)))[0]  # so that the words are listed once a pair
    return _rate(ref, hyp, edits, F.size(words(ref)))


@F.pandas_udf(LongType())
def _common_words(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How many words two texts have in common, each as often as both have it; counted word by word, which array functions do only pair by pair."""
    for ref, hyp in pairs:
        yield pd.Series([None if a is None or b is None else sum((Counter(a.split(" ")) & Counter(b.split(" "))).values()) if a and b else 0 for a, b in zip(ref, hyp, strict=True)], dtype="Int64")


def word_f1(ref: Column, hyp: Column) -> Column:
    """F1 over word multisets of normalised texts: twice the overlap by both sizes."""
    size = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    both = size(ref) + size(hyp)
    return F.when(both == 0, 1.0).otherwise(2.0 * _common_words(ref, hyp) / F.greatest(both, F.lit(1)))


def is_code(line: Column) -> Column:
    return line.rlike(CODE) & ~line.endswith(".")


def ascii_only(text: Column) -> Column:
    """Printable ASCII and newlines."""
    return F.regexp_replace(text, r"[^ -~\n]", "")
