"""Predicates that compare the two sides of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mrz import chars, normalize_document
from .text import transliterated

# --- fixed values: pairs of look-alikes, months and days that OCR mixes up ---
PAIRS = ("A4", "O0", "D0", "I1", "L1", "Z2", "S5", "B8", "G6")
MONTHS = ("01", "04", "06", "07")
DAYS = ("24", "22", "21", "27", "04", "02", "14", "12")
# --- end of fixed values ---


def blank(s: Column) -> Column:
    return F.coalesce(s, F.lit("")) == ""


def differing(a: Column, b: Column) -> Column:
    """Number of places at which two texts of one length differ."""
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def documents_match(a: Column, b: Column) -> Column:
    """Equal after normalisation, or apart in one place by a pair of look-alikes. A missing side: false."""
    n1, n2 = normalize_document(a), normalize_document(b)
    alike = [p for p in PAIRS] + [p[::-1] for p in PAIRS]
    apart = F.filter(F.zip_with(chars(n1), chars(n2), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    near = (F.length(n1) == 9) & (F.length(n2) == 9) & (F.size(apart) <= 1) & F.forall(apart, lambda p: p.isin(*alike))
    return ~blank(a) & ~blank(b) & ((n1 == n2) | near)


def dates_match(a: Column, b: Column) -> Column:
    """Equal digits, one with the century and one without, or the same year with a look-alike month, day or single digit. A missing side: false."""
    d1, d2 = (F.regexp_replace(x, "[^0-9]", "") for x in (a, b))
    n1, n2 = F.length(d1), F.length(d2)
    short = ((n1 == 8) & (n2 == 6) & (F.substring(d1, 3, 6) == d2)) | ((n2 == 8) & (n1 == 6) & (F.substring(d2, 3, 6) == d1))
    month = lambda d: F.substring(d, 5, 2)
    day = lambda d: F.substring(d, 7, 2)
    fuzzy = ((day(d1) == day(d2)) & month(d1).isin(*MONTHS) & month(d2).isin(*MONTHS)) | ((month(d1) == month(d2)) & day(d1).isin(*DAYS) & day(d2).isin(*DAYS)) | (differing(d1, d2) <= 1)
    same_year = (n1 == 8) & (n2 == 8) & (F.substring(d1, 1, 4) == F.substring(d2, 1, 4))
    return ~blank(a) & ~blank(b) & F.coalesce((d1 == d2) | short | (same_year & fuzzy), F.lit(False))


def names_compatible(a: Column, b: Column) -> Column:
    """True if a side is missing, if one starts with the other, or if they transliterate."""
    s1, s2 = (F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z]", "")) for x in (a, b))
    return (s1 == "") | (s2 == "") | s1.startswith(s2) | s2.startswith(s1) | transliterated(s1, s2)
