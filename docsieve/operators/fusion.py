"""Fusion of text fields with the zone's record, derived fields, side, profile, and client-side normalisation and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.linkage import blank
from ..functions.text import repair_given_name, transliterated
from .zone import COUNTRY, TD1, TD3

# --- fixed values: aliases of a profile's fields in order, and their labels ---
ALIASES = {
    "full_name": ("full_name",),
    "surname": ("surname",),
    "first_name": ("first_name",),
    "patronymic": ("patronymic",),
    "personal_number": ("personal_number", "jshshir", "pinfl"),
    "document_number": ("document_number", "doc_num"),
    "date_of_birth": ("date_of_birth", "birth_date"),
    "place_of_birth": ("place_of_birth", "birth_place"),
    "date_of_issue": ("date_of_issue", "issue_date"),
    "date_of_expiry": ("date_of_expiry", "expiry_date"),
    "gender": ("gender",),
    "nationality": ("nationality",),
    "issuing_authority": ("issuing_authority",),
}
LABELS = {
    "surname": "Familiya",
    "first_name": "Ism",
    "patronymic": "Otasining ismi",
    "full_name": "To'liq ismi",
    "personal_number": "JSHSHIR (PINFL)",
    "document_number": "Hujjat raqami",
    "date_of_birth": "Tug'ilgan sana",
    "place_of_birth": "Tug'ilgan joyi",
    "date_of_issue": "Berilgan sana",
    "date_of_expiry": "Amal qilish muddati",
    "gender": "Jinsi",
    "nationality": "Fuqaroligi / Millati",
    "issuing_authority": "Kim tomonidan berilgan",
}
CARD_WORDS = r"(?iu)SHAXS\s*GUVOHNOMASI|GUVOHNOMASI|KARTA\s*RAQAMI|CARD\s*NUMBER|IDENTITY\s*CARD"
FRONT_WORDS = r"(?iu)OTASINING\s*IS[MN]?[I1]?|FAMILIYASI|GIVEN\s*NAMES|SURNAME|SHAXS\s*GUVOHNOMASI"
MALE_PATRONYMIC = r"(O['ʻʼ`]?G['ʻʼ`]?LI|VICH)\b"
FEMALE_PATRONYMIC = r"(QIZI|VNA)\b"
# --- end of fixed values ---


def _full(s: Column) -> Column:
    return F.when(~blank(s), s)


def gender_from(patronymic: Column, pinfl: Column) -> Column:
    """By the patronymic's suffix, then by the personal number's lead digit 3 to 6."""
    p = F.upper(patronymic)
    by_name = F.when(p.rlike(MALE_PATRONYMIC), "Erkak").when(p.rlike(FEMALE_PATRONYMIC), "Ayol")
    lead = F.when(F.length(pinfl) == 14, F.substring(pinfl, 1, 1))
    return F.coalesce(by_name, F.when(lead.isin("3", "5"), "Erkak").when(lead.isin("4", "6"), "Ayol"))


def birth_from(pinfl: Column) -> Column:
    """YYYY-MM-DD out of a 14-digit personal number, without a range check."""
    lead = F.substring(pinfl, 1, 1)
    century = F.when(lead.isin("1", "2"), 1800).when(lead.isin("3", "4"), 1900).when(lead.isin("5", "6"), 2000)
    year = century + F.substring(pinfl, 6, 2).try_cast("int")
    return F.when((F.length(pinfl) == 14) & year.isNotNull(), F.concat_ws("-", year.cast("string"), F.substring(pinfl, 4, 2), F.substring(pinfl, 2, 2)))


def fuse(fields: Column, m: Column, corpus: Column) -> Column:
    """struct of the text's fields overruled by the zone's record where that is more reliable; gender and birth derived where missing."""
    doc = F.when(m["document_number"].rlike("^[A-Z]{2}[0-9]{7}$") | (blank(fields["document_number"]) & ~blank(m["document_number"])), m["document_number"]).otherwise(fields["document_number"])
    zone = F.trim(F.regexp_replace(m["surname"], r"(?i)^(FAMILIYASI|SURNAME)\s*", ""))
    zone = F.regexp_replace(zone, "(OVA|EVA|IYEV|IYEVA|OV|EV|LI|QIZI)[SKCE]+$", "$1")
    words = F.split(zone, r"\s+")
    last = F.get(words, 0)
    body = _full(fields["surname"])
    usable = last.rlike(r"^\p{L}{3,}$")
    longer = ~last.startswith(body) & (F.length(last) > F.length(body)) & ~body.contains("X") & ~m["surname"].contains(" ")
    surname = F.when(usable & (body.isNull() | (~transliterated(body, last) & longer)), last).otherwise(body)
    text_first = F.coalesce(_full(fields["first_name"]), F.when(F.size(words) > 1, F.regexp_replace(F.get(words, 1), "([AEIOUY])S+$", "$1")))
    given = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(m["first_name"], r"(?i)^(ISMI|GIVEN|NAMES)\s*", "")), "[<EK]+$", ""), "([AEIOUY])S+$", "$1"))
    apt = F.replace(given, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$") & (F.length(given) >= 3)
    seen = F.get(F.filter(F.transform(F.regexp_extract_all(F.coalesce(corpus, F.lit("")), F.lit("([A-Za-zʻʼ']+)"), 1), lambda w: repair_given_name(w)), lambda w: transliterated(w, given)), 0)
    first = F.when(~apt | given.isNull() | transliterated(text_first, given) | given.startswith(text_first), text_first).otherwise(F.coalesce(seen, given))
    zone_first = lambda name: F.coalesce(_full(m[name]), _full(fields[name]))
    pinfl = zone_first("jshshir")
    gender = F.coalesce(zone_first("gender"), gender_from(fields["patronymic"], pinfl))
    birth = F.coalesce(zone_first("birth_date"), birth_from(pinfl))
    keep = lambda name: _full(fields[name]).alias(name)
    return F.struct(_full(doc).alias("document_number"), pinfl.alias("jshshir"), surname.alias("surname"), first.alias("first_name"), keep("patronymic"), birth.alias("birth_date"), zone_first("expiry_date").alias("expiry_date"), keep("issue_date"), gender.alias("gender"), zone_first("nationality").alias("nationality"), keep("birth_place"), keep("issuing_authority"))


def side(mrz_format: Column, corpus: Column, document: Column, surname: Column, first_name: Column, patronymic: Column) -> Column:
    """id_both_sides, id_back, passport, id_front or document."""
    text = F.coalesce(corpus, F.lit(""))
    front = text.rlike(FRONT_WORDS) | ~blank(patronymic) | (~blank(surname) & ~blank(first_name))
    book = ~text.rlike(CARD_WORDS) & text.rlike(r"(?iu)otasining\s*is[mn]?[i1]?|shaxsiy\s*imzo|\bmillat[i1]?\b") & text.rlike(r"(?iu)O['ʻʼ`]?ZBEKISTON\s+RESPUBLIKASI")
    return F.when(mrz_format == TD1, F.when(front, "id_both_sides").otherwise("id_back")).when((mrz_format == TD3) | book, "passport").when(~blank(document) | ~blank(surname), "id_front").otherwise("document")


def field_confidence(fields: Column, has_mrz: Column, status: Column) -> Column:
    n = sum((~blank(fields[k])).cast("int") for k in ("document_number", "surname", "first_name", "birth_date"))
    return scores.confidence(n, has_mrz, status, fields["jshshir"])


def profile(fields: Column, kind: Column) -> Column:
    """The canonical profile of one document's fields."""
    name = F.concat_ws(" ", _full(fields["surname"]), _full(fields["first_name"]), _full(fields["patronymic"]))
    pick = lambda own, name: fields[own].alias(name)
    return F.struct(kind.alias("document_type"), pick("document_number", "document_number"), pick("jshshir", "personal_number"), pick("surname", "surname"), pick("first_name", "first_name"), pick("patronymic", "patronymic"), _full(name).alias("full_name"), pick("birth_date", "date_of_birth"), pick("birth_place", "place_of_birth"), pick("issue_date", "date_of_issue"), pick("expiry_date", "date_of_expiry"), pick("issuing_authority", "issuing_authority"), pick("gender", "gender"), F.coalesce(_full(fields["nationality"]), F.lit(COUNTRY)).alias("nationality"), F.lit(True).alias("is_valid_pair"), F.lit(False).alias("different_cards_detected"))


def normalised(df: DataFrame) -> DataFrame:
    """The canonical fields of rows that use any of their aliases; 'null' and 'None' count as missing, which is ''. Derived: full name, gender (number before patronymic), birth, nationality."""
    some = lambda c: F.when(~F.col(c).isin("", "null", "None"), F.trim(F.col(c)))
    out = {}
    for key, names in ALIASES.items():
        there = [some(n) for n in names if n in df.columns]
        out[key] = F.coalesce(*there, F.lit("")) if there else F.lit("")
    base = df.select(*[c for c in df.columns if all(c not in n for n in ALIASES.values())], *[v.alias(k) for k, v in out.items()])
    c = F.col
    name = F.concat_ws(" ", _full(c("surname")), _full(c("first_name")), _full(c("patronymic")))
    lead = F.when(F.length("personal_number") == 14, F.substring("personal_number", 1, 1))
    p = F.upper("patronymic")
    derived = F.coalesce(F.when(lead.isin("1", "3", "5"), "Erkak").when(lead.isin("2", "4", "6"), "Ayol"), F.when(p.rlike(r"O['ʻʼ`]?G['ʻʼ`]?LI|VICH"), "Erkak").when(p.rlike("QIZI|VNA"), "Ayol"), F.lit(""))
    return base.withColumns({"full_name": F.coalesce(_full(c("full_name")), name), "gender": F.coalesce(_full(c("gender")), derived), "date_of_birth": F.coalesce(_full(c("date_of_birth")), birth_from(c("personal_number")), F.lit("")), "nationality": F.coalesce(_full(c("nationality")), F.lit(COUNTRY))})


def client_check(pinfl: Column, birth: Column, gender: Column, has_mrz: Column) -> Column:
    """struct<is_authentic, overall_status, birth_date_matches, gender_matches>: the client's fallback; weaker than the server's cross-check: exact dates only, a zone counts as passed."""
    lead = F.substring(pinfl, 1, 1)
    sex = F.when(lead.isin("1", "3", "5"), "erkak").when(lead.isin("2", "4", "6"), "ayol")
    known = (F.length(pinfl) == 14) & sex.isNotNull()
    birth_ok = F.when(known & ~blank(birth), birth == birth_from(pinfl))
    g = F.lower(gender)
    told = F.when(g.contains("erkak") | (g == "male"), "erkak").when(g.contains("ayol") | (g == "female"), "ayol")
    gender_ok = F.when(known & told.isNotNull(), told == sex)
    valid = F.coalesce(birth_ok, F.lit(True)) & F.coalesce(gender_ok, F.lit(True))
    status = F.when(~valid, "FAIL").when(has_mrz | ~blank(pinfl), "PASS").otherwise("NOT_APPLICABLE")
    return F.struct(valid.alias("is_authentic"), status.alias("overall_status"), birth_ok.alias("birth_date_matches"), gender_ok.alias("gender_matches"))


def precedence(profile_: Column, fields: Column, merged: Column, page: Column) -> Column:
    """The record to show: profile, else fields, else the merged profile, else the first page's fields."""
    return F.coalesce(profile_, fields, merged, page)


def labelled_text(df: DataFrame) -> Column:
    """Label: value lines of the non-empty canonical fields, in the card's order."""
    return F.concat_ws("\n", *[F.when(~F.col(k).isin("", "null", "None"), F.concat(F.lit(f"{label}: "), F.col(k))) for k, label in LABELS.items() if k in df.columns])


def compact_text(full_name: Column, personal_number: Column) -> Column:
    return F.concat_ws(" | ", _full(full_name), F.when(~blank(personal_number), F.concat(F.lit("JSHSHIR: "), personal_number)))


def long_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of the non-empty canonical fields: the long form that is exported."""
    names = [k for k in ALIASES if k in df.columns]
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names])).alias("e")).select(key, "e.field", "e.value").where(F.col("value") != "")
