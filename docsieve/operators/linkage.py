"""Record linkage of a document's two sides: swap rule, checks, gate for different cards, merged profile; dossiers of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.linkage import blank, dates_match, documents_match, names_compatible
from ..functions.mrz import normalize_document
from .zone import COUNTRY, TD1, TD3, Stage, cross_check

FIELDS = ("document_number", "jshshir", "surname", "first_name", "patronymic", "birth_date", "expiry_date", "issue_date", "gender", "nationality", "birth_place", "issuing_authority")


def _full(s: Column) -> Column:
    return F.when(~blank(s), s)


def is_back(r: Column) -> Column:
    return F.coalesce((r["detected_side"] == "id_back") | (F.coalesce(r["mrz_format"], F.lit("")) == TD1) | (~blank(r["jshshir"]) & ~F.coalesce(r["face_detected"], F.lit(False))), F.lit(False))


def is_front(r: Column) -> Column:
    return F.coalesce((r["detected_side"] == "id_front"), F.lit(False)) | F.coalesce(r["face_detected"], F.lit(False)) | ~blank(r["patronymic"])


def swapped(a: Column, b: Column) -> Column:
    """Whether the first upload is the back: it is and the second isn't, or only the second is a front and not a back."""
    return (is_back(a) & ~is_back(b)) | (is_front(b) & ~is_front(a) & ~is_back(b))


def _dealt(rows: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """rows with all of a key in one of ``tasks`` tasks, so that what one of them sorts need not grow with the table. None: grouping deals them, by ``spark.sql.shuffle.partitions``."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def pair_up(sides: DataFrame, keys: list[str], a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """keys, a, b: the first and second upload of each session from rows with ``upload`` 0 or 1. One shuffle, on the session key. ``tasks``: that many share the sessions."""
    record = F.struct(*[c for c in sides.columns if c not in (*keys, "upload")])
    return _dealt(sides, keys, tasks).groupBy(*keys).agg(F.min_by(record, F.when(F.col("upload") == 0, 0)).alias(a), F.min_by(record, F.when(F.col("upload") == 1, 1)).alias(b))


def merge(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with ``merged``: checks, score, alerts, status and the profile of both sides (structs of FIELDS, detected_side, mrz_format, face_detected, confidence)."""
    z = Stage(pairs)
    z(swap=swapped(F.col(a), F.col(b)))
    z(f=F.when(z.swap, F.col(b)).otherwise(F.col(a)), k=F.when(z.swap, F.col(a)).otherwise(F.col(b)))
    f, k = z.f, z.k
    pin = F.regexp_replace(F.coalesce(_full(k["jshshir"]), _full(f["jshshir"]), F.lit("")), "[^0-9]", "")
    century = F.when(pin.rlike("^[12]"), "18").when(pin.rlike("^[34]"), "19").otherwise("20")
    dob = F.when(pin.rlike("^[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}$"), F.concat(century, F.substring(pin, 6, 2), F.lit("-"), F.substring(pin, 4, 2), F.lit("-"), F.substring(pin, 2, 2)))
    z(dob=dob, fd=normalize_document(f["document_number"]), kd=normalize_document(k["document_number"]), fb=_full(f["birth_date"]))
    z(kb=F.coalesce(_full(k["birth_date"]), z.dob), fe=_full(f["expiry_date"]), ke=_full(k["expiry_date"]))
    state = lambda there, same: F.when(there, F.when(same, "MATCH").otherwise("MISMATCH")).otherwise("SKIPPED")
    z(doc=state(~blank(z.fd) & ~blank(z.kd), documents_match(z.fd, z.kd)), birth=state(z.fb.isNotNull() & z.kb.isNotNull(), dates_match(z.fb, z.kb)), expiry=state(z.fe.isNotNull() & z.ke.isNotNull(), dates_match(z.fe, z.ke)))
    clash = ~names_compatible(f["surname"], k["surname"]) | ~names_compatible(f["first_name"], k["first_name"])
    z(name=F.when(clash, "MISMATCH").when(~blank(f["surname"]) | ~blank(k["surname"]), "MATCH").otherwise("SKIPPED"))
    same = z.doc == "MATCH"
    z(jsh=F.coalesce(_full(k["jshshir"]), _full(f["jshshir"])))
    z(cross=cross_check(z.jsh, F.coalesce(z.fb, z.kb), F.coalesce(_full(f["gender"]), _full(k["gender"]))))
    z(pin_status=F.when(z.jsh.isNull(), "NOT_FOUND").when(z.jsh.rlike("^[0-9]{14}$"), z.cross["status"]).otherwise("INVALID_LENGTH"))
    # equal documents turn a clash of names or births into a reading error
    z(birth2=F.when(same & (z.birth == "MISMATCH"), "MATCH").otherwise(z.birth), name2=F.when(same & (z.name == "MISMATCH"), "MATCH").otherwise(z.name))
    z(differs=(z.doc == "MISMATCH") | (~same & ((z.birth == "MISMATCH") | (z.name == "MISMATCH"))))
    pin_alerts = F.when(z.jsh.rlike("^[0-9]{14}$") & ~z.cross["is_valid"], F.transform(z.cross["alerts"], lambda x: F.concat(F.lit("pinfl_"), x))).otherwise(F.array().cast("array<string>"))
    own = scores.present([F.when(z.differs, "different_cards"), F.when(z.doc == "MISMATCH", "document_number"), F.when(z.birth2 == "MISMATCH", "birth_date"), F.when(z.expiry == "MISMATCH", "expiry_date"), F.when(z.name2 == "MISMATCH", "name")])
    z(alerts=F.concat(own, F.coalesce(pin_alerts, F.array().cast("array<string>"))))
    score = scores.match_score(F.array(z.doc, z.birth2, z.expiry, z.name2))
    z(score=F.when(z.differs, F.least(score, F.lit(25.0))).otherwise(score))
    z(authentic=(F.size(z.alerts) == 0) & (z.score >= 80.0))
    status = F.when(z.authentic, "VERIFIED_MATCH").when(F.size(z.alerts) > 0, "SUSPECTED_FRAUD").otherwise("WARNING")
    alpha = lambda d: F.when(d.rlike("^[A-Za-z]{2}"), d)
    number = F.coalesce(alpha(z.fd), alpha(z.kd), _full(z.fd), _full(z.kd))
    first = lambda field: F.coalesce(_full(f[field]), _full(k[field]))
    last = lambda field: F.coalesce(_full(k[field]), _full(f[field]))
    only = lambda same_card, different: F.when(z.differs, different).otherwise(same_card)
    z(sur=only(first("surname"), _full(f["surname"])), given=only(first("first_name"), _full(f["first_name"])), pat=only(first("patronymic"), _full(f["patronymic"])))
    profile = F.struct(
        F.lit("ID_CARD").alias("document_type"),
        only(number, _full(z.fd)).alias("document_number"),
        only(z.jsh, _full(f["jshshir"])).alias("personal_number"),
        z.sur.alias("surname"),
        z.given.alias("first_name"),
        z.pat.alias("patronymic"),
        F.concat_ws(" ", z.sur, z.given, z.pat).alias("full_name"),
        only(F.coalesce(z.dob, z.kb, z.fb), z.fb).alias("date_of_birth"),
        only(last("birth_place"), _full(f["birth_place"])).alias("place_of_birth"),
        only(first("issue_date"), _full(f["issue_date"])).alias("date_of_issue"),
        only(F.coalesce(z.ke, z.fe), z.fe).alias("date_of_expiry"),
        only(last("issuing_authority"), _full(f["issuing_authority"])).alias("issuing_authority"),
        only(first("gender"), _full(f["gender"])).alias("gender"),
        F.coalesce(only(first("nationality"), _full(f["nationality"])), F.lit(COUNTRY)).alias("nationality"),
        (~z.differs).alias("is_valid_pair"),
        z.differs.alias("different_cards_detected"),
    )
    mean = F.bround((F.coalesce(f["confidence"], F.lit(0.0)) + F.coalesce(k["confidence"], F.lit(0.0))) / 2, 1)
    checks = F.struct(z.doc.alias("document_number_match"), z.birth2.alias("birth_date_match"), z.expiry.alias("expiry_date_match"), z.name2.alias("name_match"), z.pin_status.alias("jshshir_validation"))
    merged = F.struct(checks.alias("checks"), z.score.alias("match_score"), z.differs.alias("different_cards_detected"), z.alerts.alias("fraud_alerts"), z.authentic.alias("is_authentic"), status.alias("overall_status"), z.swap.alias("auto_swapped"), F.when(z.differs, F.least(mean, F.lit(35.0))).otherwise(mean).alias("confidence"), profile.alias("citizen_profile"))
    return z.done(merged=merged)


def page_type(r: Column) -> Column:
    """id_front, id_back, passport or general_document of a page's record (with ``raw_text``)."""
    face = F.coalesce(r["face_detected"], F.lit(False))
    kind, form = F.coalesce(r["detected_side"], F.lit("")), F.coalesce(r["mrz_format"], F.lit(""))
    text = F.upper(F.coalesce(r["raw_text"], F.lit("")))
    return (
        F.when((form == TD1) | (kind == "id_back") | (~blank(r["jshshir"]) & ~face), "id_back")
        .when((form == TD3) | (kind == "passport"), "passport")
        .when((face & (~blank(r["patronymic"]) | ~blank(r["document_number"]))) | (kind == "id_front"), "id_front")
        .when(text.contains("SHAXS GUVOHNOMASI") | text.contains("IDENTITY CARD"), F.when(face, "id_front").otherwise("id_back"))
        .otherwise("general_document")
    )


def first_pages(pages: DataFrame, key: str, number: str, kind: str, max_pages: int = 10) -> DataFrame:
    """The first page of each type in each dossier, among its first ``max_pages`` pages (1 to 20)."""
    if not 1 <= max_pages <= 20:
        raise ValueError("max_pages must be from 1 to 20")
    first = Window.partitionBy(key, kind).orderBy(number)
    return pages.where(F.col(number) <= max_pages).withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def dossier_type(front: Column, back: Column, passport: Column) -> Column:
    """From the presence of each type's first page."""
    return F.when(front & back, "TWO_SIDED_ID_DOSSIER").when(passport, "PASSPORT_DOSSIER").when(front, "ID_FRONT_ONLY").when(back, "ID_BACK_ONLY").otherwise("GENERAL_DOCUMENT")


def dossiers(pages: DataFrame, key: str = "dossier_id", number: str = "page_number", kind: str = "page_type", max_pages: int = 10) -> DataFrame:
    """One row for each dossier: page numbers of the first page of each type, pages seen, dossier_type. One shuffle, combined before it."""
    seen = pages.where(F.col(number) <= max_pages)
    at = lambda t: F.min(F.when(F.col(kind) == t, F.col(number)))
    out = seen.groupBy(key).agg(at("id_front").alias("front_page"), at("id_back").alias("back_page"), at("passport").alias("passport_page"), F.count("*").alias("pages"))
    return out.withColumn("dossier_type", dossier_type(F.col("front_page").isNotNull(), F.col("back_page").isNotNull(), F.col("passport_page").isNotNull()))


def merged_dossiers(pages: DataFrame, record: str, key: str = "dossier_id", number: str = "page_number", kind: str = "page_type", max_pages: int = 10, tasks: int | None = None) -> DataFrame:
    """dossiers with ``merged`` where both sides of a card are there: the first front and back page, by minimum over structs (no self-join). ``tasks``: that many share the dossiers."""
    seen = _dealt(pages.where(F.col(number) <= max_pages), [key], tasks)
    of = lambda t: F.min_by(F.when(F.col(kind) == t, F.col(record)), F.when(F.col(kind) == t, F.col(number)))
    at = lambda t: F.min(F.when(F.col(kind) == t, F.col(number)))
    out = seen.groupBy(key).agg(of("id_front").alias("a"), of("id_back").alias("b"), of("passport").alias("passport"), at("id_front").alias("front_page"), at("id_back").alias("back_page"), at("passport").alias("passport_page"))
    out = merge(out).withColumn("dossier_type", dossier_type(F.col("front_page").isNotNull(), F.col("back_page").isNotNull(), F.col("passport_page").isNotNull()))
    return out.withColumn("merged", F.when(F.col("dossier_type") == "TWO_SIDED_ID_DOSSIER", F.col("merged")))
