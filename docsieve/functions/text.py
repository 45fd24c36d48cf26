"""Scalars over OCR text: words, document numbers, personal numbers, names, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mrz import CYRILLIC, LATIN

# --- fixed values: label words, prefixes and suffixes of the documents ---
PREFIX_DENIED = ("UZ", "RE", "SH", "GU", "KA", "DA", "PE", "ZB", "OT", "TU", "AM")
PREFIX_ALLOWED = ("AA", "AB", "AC", "AD", "AE", "AF", "FA")
NAME_SUFFIXES = ("XON", "BEK", "JON", "MIRZO", "DOR", "IDDIN", "UDDIN", "ULLO", "ULLAH", "SHOD", "ALI", "BOY", "GUL", "NOZ", "ORA", "NUR", "ZOD", "ZODA", "XAN", "ISA", "INA", "IYA", "OVA", "EVA", "URA", "ILA", "OYA", "AT")
NOT_FIRST_NAMES = ("FUAROTIAI", "BIETA", "BETH", "BIRTH", "CITIZENSHIP", "NATIONALITY", "CARD", "NUMBER", "SANASI", "RESS", "STATE", "CENTRE", "CENTER", "RODIN", "BEDIN", "LADIN")
FIRST_NAMES = ("ZOXID", "DADAXON", "SOBITXON", "ZOKIRJON", "ABDUBAKIR", "ELYORJON", "ELYOR", "MUXLISA", "MUKHLISA", "MADINA", "NILUFAR", "DILNOZA", "SHAXNOZA", "MALIKA", "GULNORA", "SEVARA", "FERUZA", "KAMOLA", "ZULFIYA", "AXMADJON", "AKHMADJON", "SAMIJON", "DAVRON")
PATRONYMIC_REPAIRS = (("(OVISH|OWICH|OWIEH|OVIBH|OVICR|OVIC|OVI4)$", "OVICH"), ("(EVISH|EWICH|EWIEH|EVIBH|EVICR|EVIC|EVI4)$", "EVICH"), ("(OVHA|OWNA)$", "OVNA"), ("(EVHA|EWNA)$", "EVNA"))
APOSTROPHES = "'ʻʼ`"
# --- end of fixed values ---


def fold(s: Column) -> Column:
    """Cyrillic look-alikes as Latin letters."""
    return F.translate(s, CYRILLIC, LATIN)


def clean_word(s: Column) -> Column:
    """Without anything but Latin and Cyrillic letters at both ends."""
    return F.trim(F.regexp_replace(s, "^[^A-ZА-Яa-zа-я]+|[^A-ZА-Яa-zа-я]+$", ""))


def no_apostrophes(s: Column) -> Column:
    return F.translate(s, APOSTROPHES, "")


def _first(xs: Column) -> Column:
    return F.get(xs, 0)


def document_number(text: Column) -> Column:
    """Two letters and seven digits; else a look-alike with a known prefix; else after a label; else nine digits; else null."""
    t = F.regexp_replace(F.translate(text, "АВЕСР", "ABECP"), r"\bA0([0-9]{7})\b", "AD$1")
    denied = "|".join(PREFIX_DENIED)
    strict = F.transform(F.regexp_extract_all(t, F.lit(r"\b([A-Z]{2}\s*[0-9]{7})\b"), 1), lambda x: F.regexp_replace(x, r"\s+", ""))
    strict = _first(F.filter(strict, lambda x: ~x.rlike(f"^({denied})")))
    loose = F.filter(F.regexp_extract_all(t, F.lit(r"\b([A-Z]{2}[A-Z0-9]{7})\b"), 1), lambda x: F.substring(x, 1, 2).isin(*PREFIX_ALLOWED))
    loose = F.transform(loose, lambda x: F.concat(F.substring(x, 1, 2), F.translate(F.substring(x, 3, 7), "IlSsZBO", "1155380")))
    loose = _first(F.filter(loose, lambda x: x.rlike("^..[0-9]{7}$")))
    label = F.regexp_replace(F.regexp_extract(t, r"(?i)(?:karta\s*raqami|pasport\s*raqami|document\s*no|card\s*number)[:\s\w/]*?([A-Z]{2}\s*[A-Z0-9]{7})", 1), r"\s+", "")
    tail = F.translate(F.substring(label, 3, 7), "IlSsZBO", "1155280")
    label = F.when((F.length(label) == 9) & ~label.rlike(f"^({denied})") & tail.rlike("^[0-9]{7}$"), F.concat(F.substring(label, 1, 2), tail))
    nine = _first(F.regexp_extract_all(t, F.lit(r"\b([0-9]{9})\b"), 1))
    return F.coalesce(strict, loose, label, nine)


_PINFL = r"([1-6](?:[\s-]*[0-9]){13})"
_PINFL_OK = "^[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}$"


def personal_number(text: Column) -> Column:
    """The labelled 14-digit number, else the first plausible one, separators dropped; else null."""
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    label = bare(F.regexp_extract(text, r"(?i)(?:shaxsiy\s*raqam[i|e]?|personal\s*number)[:\s]*" + _PINFL, 1))
    every = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"\b{_PINFL}\b"), 1), bare), lambda x: x.rlike(_PINFL_OK))
    return F.coalesce(F.when(label.rlike(_PINFL_OK), label), _first(every))


def repair_patronymic(s: Column, table: tuple[tuple[str, str], ...] = ()) -> Column:
    """Upper case with its OCR-damaged suffix repaired; blank as null. ``table`` adds (pattern, name) repairs of the user's own."""
    p = F.trim(F.upper(s))
    for pattern, repaired in PATRONYMIC_REPAIRS:
        p = F.regexp_replace(p, pattern, repaired)
    p = F.regexp_replace(p, r"\s+(VICH|VNA|VISH)\b", "$1")
    for pattern, name in table:
        p = F.when(p.rlike(pattern), F.lit(name)).otherwise(p)
    return F.when(F.coalesce(s, F.lit("")) != "", p)


def repair_given_name(s: Column, surname: Column | None = None, table: tuple[tuple[str, str], ...] = ()) -> Column:
    """Upper case with plain apostrophes; null if blank or equal to the surname."""
    c = F.translate(F.trim(F.upper(s)), "ʻʼ`", "'''")
    for pattern, name in table:
        c = F.when(c.rlike(pattern), F.lit(name)).otherwise(c)
    same = F.lit(False) if surname is None else F.coalesce(F.trim(F.translate(F.upper(s), "ʻʼ`", "'''")) == F.upper(surname), F.lit(False))
    return F.when((F.coalesce(s, F.lit("")) != "") & ~same, c)


def transliterated(body: Column, zone: Column) -> Column:
    """Whether a name in the national spelling and one in the zone's are the same. Blank sides: false."""
    b, m = F.trim(F.upper(body)), F.trim(F.upper(zone))
    plain = no_apostrophes(b)
    u = no_apostrophes(F.regexp_replace(b, f"O[{APOSTROPHES}]", "U"))
    kh = lambda x: F.replace(x, F.lit("KH"), F.lit("X"))
    v = lambda x: F.translate(x, "W", "V")
    norm = lambda x: v(F.translate(kh(x), "K", "Q"))
    same = (b == m) | (m == plain) | (m == u) | (norm(plain) == norm(m)) | (norm(u) == norm(m)) | (norm(u) == m)
    same = same | (v(kh(m)) == v(b)) | (v(F.replace(b, F.lit("X"), F.lit("KH"))) == v(m)) | (F.translate(m, "K", "Q") == b) | (F.translate(b, "Q", "K") == m)
    return F.coalesce(same & (body != "") & (zone != ""), F.lit(False))


def strong_first_name(s: Column) -> Column:
    c = no_apostrophes(F.trim(F.upper(s)))
    return F.coalesce(~c.isin(*NOT_FIRST_NAMES) & (c.isin(*FIRST_NAMES) | c.rlike(f"({'|'.join(NAME_SUFFIXES)})$")), F.lit(False))
