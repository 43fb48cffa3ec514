"""Normal forms of identifiers, texts and gene names.

Missing values are null, blank, or one of the words in ``MISSING_WORDS``; every
function maps them to null so that no operator has to know the spellings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for a missing value in the sources (compared in lower case)
MISSING_WORDS = ("nan", "none", "nd", "null", "na")


#: Blanks that surround values: trimmed by characters, without a regular expression per row.
BLANKS = " \t\n\r\x0b\x0c\u00a0"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without blanks of any kind at either end; stays null for null."""
    return F.btrim(_c(c), F.lit(BLANKS))


def present(c: Column | str, words: tuple[str, ...] = ("", "nan", "none", "nd")) -> Column:
    """Trimmed text, null where it is missing."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*words), t)


def upper_text(c: Column | str) -> Column:
    """The form in which texts compare: trimmed, upper case, null where missing."""
    return F.upper(present(c))


def letters(c: Column | str) -> Column:
    """Only the letters A-Z of a present text, upper case; null where nothing is left."""
    t = F.regexp_replace(upper_text(c), "[^A-Z]", "")
    return F.when(t != "", t)


def record_id(c: Column | str) -> Column:
    """An identifier without surrounding blanks and the aligner's ``reversed|``; null where empty."""
    t = trimmed(F.regexp_replace(trimmed(c), r"^reversed\|", ""))
    return F.when(t != "", t)


def gene(c: Column | str) -> Column:
    """Gene name: first call, upper case, without allele, species note and blanks."""
    t = F.regexp_extract(F.upper(present(c)), r"^\s*([^,*(\s]+)", 1)
    return F.when((t != "") & ~t.isin("NAN", "NONE", "ND"), t)


def name_key(c: Column | str) -> Column:
    """Names of cohorts and samples: lower case without surrounding blanks; null where missing."""
    return F.lower(present(c))


def cdr3_core(c: Column | str, least: int = 4) -> Column:
    """CDR3 without the flanking C and W, upper case; null below ``least`` letters."""
    t = upper_text(c)
    t = F.regexp_replace(F.regexp_replace(t, "^C", ""), "W$", "")
    return F.when(F.length(t) >= least, t)


def truth(c: Column | str) -> Column:
    """Booleans written as text: true, t, 1, yes in any case."""
    return F.coalesce(F.lower(trimmed(_c(c).cast("string"))).isin("true", "t", "1", "yes"), F.lit(False))
