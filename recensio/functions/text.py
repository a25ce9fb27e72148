"""Scalar text rules as Spark Column expressions (all JVM-side, codegen'd).

Character classes are spelled out so that Java regex, RE2 (the DuckDB oracle)
and Python's Unicode ``re`` agree:  ``\\w`` -> ``[\\p{L}\\p{N}_]``,
``\\d`` -> ``\\p{Nd}``, ``\\s`` -> the SPACE class below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recensio.config import ITALIAN_MONTHS, ITALIAN_STOPWORDS

# Python's str.isspace() set, written for Java regex and RE2 alike.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"


def _months(months) -> str:
    return "|".join(months)


def clean_steps(col: Column, months=ITALIAN_MONTHS) -> Column:
    """Lower-case and strip dates, 'verified' marks, star phrases, punctuation
    and digits; returns the text before word splitting."""
    t = F.regexp_replace(_phrases_off(col, months), rf"[^{WORD}{SPACE}]", " ")
    return F.regexp_replace(t, rf"{DIGIT}+", "")


def _phrases_off(col: Column, months) -> Column:
    """Lower-case, without the phrases that are no words of the review."""
    m = _months(months)
    t = F.lower(col)
    t = F.regexp_replace(t, rf"pubblicata il {DIGIT}{{1,2}} [{WORD}]+ {DIGIT}{{4}}", "")
    t = F.regexp_replace(t, r"data dell'esperienza:[^\n]*", "")
    t = F.regexp_replace(t, rf"{DIGIT}{{1,2}}[{SPACE}]+({m})[{SPACE}]+{DIGIT}{{4}}", "")
    # The lookahead on the months' first letters only lets the alternation be
    # tried where a month can start (same matches, far fewer attempts).
    first = "".join(f"[{''.join(sorted({x[i] for x in months}))}]" for i in range(min(3, *map(len, months))))
    t = F.regexp_replace(t, rf"(?={first})({m})[{SPACE}]+{DIGIT}{{4}}", "")
    t = F.regexp_replace(t, r"(?U)(?=v)\bverificat[aoe]\b", "")
    t = F.regexp_replace(t, r"(?U)(?=v)\bverifica\b", "")
    t = F.regexp_replace(t, "stelle su 5", "")
    t = F.regexp_replace(t, rf"{DIGIT}+ stelle", "")
    return F.regexp_replace(t, rf"valutato {DIGIT}", "")


def clean_words(col: Column, stopwords=ITALIAN_STOPWORDS, months=ITALIAN_MONTHS) -> Column:
    """array<string>: cleaned words, stopwords and words of <= 2 chars dropped."""
    stop = list(dict.fromkeys(stopwords))
    # What clean_steps turns into a space or leaves as one parts words; digits
    # go first, as they part none.
    words = F.split(F.regexp_replace(_phrases_off(col, months), rf"{DIGIT}+", ""), rf"[^{WORD}]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))


def clean_text(col: Column, stopwords=ITALIAN_STOPWORDS, months=ITALIAN_MONTHS) -> Column:
    """The cleaned text: cleaned words joined by one space."""
    return F.array_join(clean_words(col, stopwords, months), " ")


def rating_from_text(col: Column) -> Column:
    """First '<digit> stella/stelle', else first 'valutato <digit>', else NULL."""
    low = F.lower(col)
    star = F.regexp_extract(low, rf"({DIGIT})[{SPACE}]*stell[ae]", 1)
    rated = F.regexp_extract(low, rf"valutato[{SPACE}]*({DIGIT})", 1)
    return F.coalesce(
        F.nullif(star, F.lit("")).try_cast("int"),
        F.nullif(rated, F.lit("")).try_cast("int"),
    )


def date_text(col: Column, months=ITALIAN_MONTHS) -> Column:
    """First '<d> <month> <yyyy>' in the raw (not lower-cased) text, or NULL."""
    pat = rf"({DIGIT}{{1,2}}[{SPACE}]+(?:{_months(months)})[{SPACE}]+{DIGIT}{{4}})"
    return F.nullif(F.regexp_extract(col, pat, 1), F.lit(""))


def feature_tokens(words: Column) -> Column:
    """Tokens seen by the TF-IDF step: ASCII letters only, at least 3 long."""
    return F.filter(words, is_feature_token)


def is_feature_token(word: Column) -> Column:
    return word.rlike("^[a-zA-Z]{3,}$")


def theme_keywords(col: Column) -> Column:
    """Up to 3 whitespace-separated words longer than 3 chars of a theme."""
    parts = F.split(F.lower(col), rf"[{SPACE}]+")
    return F.slice(F.filter(parts, lambda w: F.length(w) > 3), 1, 3)


def identity(review_id: Column, testo: Column, mode: str = "strict") -> Column:
    """Identity of a review for de-duplication of examples and counts.

    strict: the review id, all id-less reviews sharing one identity;
    text50: the id, else the first 50 characters of the text.
    """
    if mode == "text50":
        return F.coalesce(review_id, F.substring(testo, 1, 50))
    return F.coalesce(review_id, F.lit("~null"))
