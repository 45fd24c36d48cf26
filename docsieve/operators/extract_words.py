"""Words of OCR lines: what may be part of a name, and the fixed words that may not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_word, no_apostrophes

# --- fixed values: stems of labels, words that are no names, endings of patronymics ---
LABEL_STEMS = ("PATR", "FAMIL", "SURNAME", "GIVEN", "GIVE", "NAME", "ISMI", "SMI", "OTAS", "OTD", "OTS", "TUGIL", "BERIL", "AMAL", "QILISH", "RESPUBL", "GUVOH", "PASPORT", "PASSP", "FUQAR", "FUAR", "CITIZEN", "NATION", "JINSI", "KARTA", "CARD", "MUDDAT", "AUTHOR", "PLACE", "BIRTH", "BIRT", "BIET", "BETH", "BTOV", "ISSUE", "REPUBLIC", "SHAXS", "SANASI", "DATE", "USER", "ATINI")
NOT_NAMES = ("OF", "SEX", "UZBEKISTAN", "UZBEK", "UZB", "EEE", "RAQAMI", "NUMBER", "QINSI", "EFT", "ЗЕХ", "ПАС", "PAS", "ZEX", "ERKAK", "AYOL", "MALE", "FEMALE", "МУЖ", "ЖЕН", "АКУЛА", "AQVOANAUNUY", "FATNILIYAST", "FATNILIYASI", "FARMIYAST", "ISINI", "ETH", "AAA", "BBB", "CCC", "OOO", "SSS", "ZZZ", "LAA", "CGA", "ALS", "SET", "SETS", "CAE", "RESS", "STATE", "CENTRE", "CENTER", "REGION", "TUMANI", "IIB", "SIGNATURE", "HOLDER", "PERSONALIZATION", "RODIN", "BEDIN", "LADIN", "SAMION", "ERAT", "ACTRYET")
#: Words of labels that a stem tells apart, but not where an apostrophe is inside (TUG'ILGAN).
LABEL_WORDS = ("FAMILIYASI", "SURNAME", "ISMI", "GIVEN", "NAMES", "NAME", "OTASINING", "TUGILGAN", "BERILGAN", "AMAL", "QILISH", "MUDDATI", "RESPUBLIKASI", "SHAXS", "GUVOHNOMASI", "PASPORT", "PASSPORT", "FUQAROLIGI", "FUAROTIAI", "CITIZENSHIP", "NATIONALITY", "JINSI", "PLACE", "BIRTH", "BIETA", "BETH", "ISSUE", "AUTHORITY", "SANASI", "DATE", "KARTA", "CARD", "REPUBLIC", "PATRONYMIC", "PATRONYMICS", "PATRONYMIICS", "ATINI", "USER", "SMI")
PATRONYMIC_END = r"(?iu)(O['ʻʼ`]?G['ʻʼ`]?LI|QIZI|GIZI|OVICH|EVICH|OVISH|EVISH|OWICH|EWICH|OWIEH|OVIBH|OVICR|EVICR|OVIC|EVIC|OVNA|EVNA|OVHA|EVHA|VICH|VISH|VNA|OV|EV|OVA|EVA)$"
# --- end of fixed values ---


def token(w: Column) -> Column:
    t = F.upper(F.regexp_replace(clean_word(w), "^[^A-Za-z]+|[^A-Za-z]+$", ""))
    return F.translate(t, "ʻʼ`", "'''")


def name_like(t: Column, least: int) -> Column:
    bare = no_apostrophes(t)
    return (F.length(bare) >= least) & bare.rlike(r"^\p{L}+$") & ~t.rlike("|".join(LABEL_STEMS)) & ~t.isin(*NOT_NAMES) & ~bare.isin(*NOT_NAMES, *LABEL_WORDS)


def tokens(line: Column) -> Column:
    return F.transform(F.split(F.coalesce(line, F.lit("")), r"\s+"), token)
