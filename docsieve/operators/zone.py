"""Machine-readable zone: cleaned lines to a record, checksums of its lines, personal-number cross-check, report.

Long chains are staged in named columns (prefix ``_z``), so that each is computed once and plans stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mrz

TD1 = "TD1 (ID Card 3-line)"
TD3 = "TD3 (Passport 2-line)"
COUNTRY = "O'zbekiston"
_DOC = "^[A-Z]{2}[0-9]{7}$"


def _at(s: Column, i: Column | int) -> Column:
    """Character at 0-based place i, empty beyond the end."""
    return F.substring(s, (i if isinstance(i, Column) else F.lit(i)) + 1, F.lit(1))


def _cut(s: Column, a: Column | int, b: Column | int) -> Column:
    """s[a:b] with 0-based bounds."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def _find(s: Column, what: str) -> Column:
    """0-based place of the first occurrence, -1 for none."""
    return F.instr(s, F.lit(what)) - 1


def _digit(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), c)


def _blank_null(s: Column) -> Column:
    return F.when(s != "", s)


def _corrected(pairs: list[tuple[Column, Column]]) -> Column:
    """array<struct<value, corrected>> of (field, digit) pairs. One correction for all of them: written once a field, plans grow with every field."""
    return F.transform(F.array(*[F.struct(v.alias("field"), k.alias("digit")) for v, k in pairs]), lambda p: mrz.auto_correct(p["field"], p["digit"]))


class Stage:
    """Adds named steps to a DataFrame and drops them in the end."""

    def __init__(self, df: DataFrame):
        self.df, self.names, self.before, self.made = df, [], set(df.columns), {}

    def __call__(self, **steps: Column) -> None:
        self.df = self.df.withColumns({f"_z_{k}": v for k, v in steps.items()})
        self.names += [f"_z_{k}" for k in steps]

    def __getattr__(self, name: str) -> Column:
        # a column is named once: building one takes a dozen calls
        if name not in self.made:
            self.made[name] = F.col(f"_z_{name}")
        return self.made[name]

    def done(self, **results: Column) -> DataFrame:
        return self.df.withColumns(results).drop(*[n for n in dict.fromkeys(self.names) if n not in self.before])


def _window(lines: Column, test) -> Column:
    """0-based index of the first line that passes, null for none."""
    return F.get(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: test(e["x"], e["i"])), 0)["i"]


def parse(df: DataFrame, lines: str = "lines", as_of_year: int = 2026) -> DataFrame:
    """df with ``mrz``: the record read from cleaned lines, or null when there are under two lines or none fits."""
    z = Stage(df)
    text = F.col(lines)
    passport = F.exists(text, lambda x: x.rlike("^(P<|<P<|PUZB)") | x.contains("P<UZB"))
    card_line = lambda x, i: x.rlike("^[I1AC]|^.{0,7}UZB") & x.rlike("^.{0,7}(UZB|U[Z27][B8])") & ~x.rlike("^(P<|PM|PA)") & (F.length(x) >= 20) & (i < F.size(text) - 2)
    z(i1=F.when((F.size(text) >= 3) & ~passport, _window(text, card_line)))
    z(a=F.get(text, z.i1), b=F.get(text, z.i1 + 1), c=F.get(text, z.i1 + 2))
    # --- identity card ---
    z(pin=mrz.rightmost_pinfl(F.concat(_cut(z.a, 0, 10), mrz.clean_date_digits(_cut(z.a, 10, F.length(z.a))))))
    before = F.regexp_replace(_cut(z.a, 0, z.pin["at"] - 1), "<+$", "")
    tail = F.substring(before, F.greatest(F.length(before) - 9, F.lit(1)), F.lit(10))
    found = F.regexp_extract(z.a, "([A-Z0-9]{2}[0-9]{7})([0-9])?", 1)
    uzb = _find(z.a, "UZB")
    z(uzb=uzb)
    cand = lambda s: mrz.normalize_document(s)
    z(da=F.when(z.pin["at"] - 1 >= 10, cand(F.substring(tail, 1, 9))), ka=_digit(F.substring(tail, 10, 1)), db=cand(found), kb=_digit(F.regexp_extract(z.a, "([A-Z0-9]{2}[0-9]{7})([0-9])?", 2)))
    z(dc=F.when((z.uzb >= 0) & (F.length(z.a) >= z.uzb + 12), cand(_cut(z.a, z.uzb + 3, z.uzb + 12))), kc=_digit(_at(z.a, z.uzb + 12)), dd=F.when(((z.uzb < 0) | (F.length(z.a) < z.uzb + 12)) & (F.length(z.a) >= 14), cand(_cut(z.a, 5, 14))), kd=_digit(_at(z.a, 14)))
    choice = F.when(z.da.rlike(_DOC), F.struct(z.da.alias("d"), z.ka.alias("k"))).when(z.db.rlike(_DOC), F.struct(z.db.alias("d"), z.kb.alias("k"))).when(z.dc.rlike(_DOC), F.struct(z.dc.alias("d"), z.kc.alias("k"))).when(F.length(z.dd) == 9, F.struct(z.dd.alias("d"), z.kd.alias("k")))
    z(choice=choice)
    z(l2=F.translate(z.b, "МЖВОЗ", "MFBO3"))
    z(sx=F.get(F.filter(F.array(*[F.lit(i) for i in range(5, 12)]), lambda i: _at(z.l2, i).isin("M", "F")), 0))
    z(sex=_at(z.l2, z.sx))
    raw = mrz.clean_date_digits(F.when(z.sx >= 6, _cut(z.l2, 0, z.sx)).otherwise(_cut(z.l2, 0, 7)))
    z(rb=raw)
    shifted = (z.sx >= 6) & (F.length(z.rb) >= 7)
    z(bc=F.when(shifted, F.substring(z.rb, F.length(z.rb) - 6, F.lit(6))).otherwise(F.substring(z.rb, 1, 6)), bk=_digit(F.when(shifted, F.substring(z.rb, F.length(z.rb), F.lit(1))).otherwise(F.substring(z.rb, 7, 1))))
    own = F.concat(F.substring(z.pin["value"], 6, 2), F.substring(z.pin["value"], 4, 2), F.substring(z.pin["value"], 2, 2))
    after = F.when(F.instr(_cut(z.l2, z.sx, F.length(z.l2)), F.lit("UZB")) > 0, z.sx + F.instr(_cut(z.l2, z.sx, F.length(z.l2)), F.lit("UZB")) - 1)
    z(chunk=F.when(z.sx.isNotNull(), F.when(after > z.sx, _cut(z.l2, z.sx + 1, after)).otherwise(_cut(z.l2, z.sx + 1, z.sx + 9))))
    six = mrz.clean_date_digits(F.substring(z.chunk, 1, 6))
    last = _digit(F.substring(z.chunk, F.length(z.chunk), F.lit(1)))
    drops = F.transform(F.sequence(F.lit(0), F.greatest(F.length(z.chunk) - 2, F.lit(0))), lambda i: mrz.clean_date_digits(F.concat(_cut(z.chunk, 0, i), _cut(z.chunk, i + 1, F.length(z.chunk) - 1))))
    z(six=F.when(six.rlike("^[0-9]{6}$"), six), last=last)
    z(drop=F.when((F.length(z.chunk) >= 8) & z.last.isNotNull(), F.get(F.filter(drops, lambda s: s.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$") & (mrz.check_digit(s) == z.last)), 0)))
    parts = F.filter(F.transform(F.split(F.regexp_replace(z.c, "<[A-Z0-9]<", "<<"), "<<"), lambda p: F.trim(F.translate(p, "<", " "))), lambda p: p != "")
    edge = lambda s: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+[A-Z]$", "")), "^[0-9]+", ""))
    given = F.regexp_replace(edge(F.regexp_replace(F.get(parts, 1), r"^[A-Z]\s+", "")), "([A-Z]{3,}?)[EK]+$", "$1")
    z(sur=_blank_null(edge(F.get(parts, 0))), given=_blank_null(given))
    # --- passport ---
    first = lambda x, i: (x.rlike("^(P|Р|<P<|<UZB|UZB)") | (x.contains("<<") & (x.rlike("^.{0,7}UZB") | (F.length(F.regexp_replace(x, "[^<]", "")) >= 5)))) & ~x.rlike("^[I1AC]") & (F.length(x) >= 25) & (F.length(F.coalesce(F.get(text, i + 1), F.lit(""))) >= 28)
    z(j=_window(text, first))
    z(p=F.get(text, z.j), q=F.get(text, z.j + 1))
    body = F.when(z.p.rlike("^.{0,7}UZB"), _cut(z.p, _find(z.p, "UZB") + 3, F.length(z.p))).otherwise(_cut(z.p, 2, F.length(z.p)))
    z(named=F.split(F.regexp_replace(body, "^<+", ""), "<<"))
    inner = F.filter(F.split(F.get(z.named, 0), "<"), lambda x: x != "")
    z(named=F.when(F.size(inner) >= 2, F.concat(F.array(F.get(inner, 0), F.array_join(F.slice(inner, F.lit(2), F.size(inner)), "<")), F.slice(z.named, F.lit(2), F.greatest(F.size(z.named) - 1, F.lit(0))))).otherwise(z.named))
    z(psur=_blank_null(mrz.name_token(F.get(z.named, 0), True)), pgiven=_blank_null(mrz.name_token(F.get(z.named, 1), False)))
    near = F.regexp_instr(z.q, F.lit("U[7Z2][2B8]")) - 1
    z(u=F.when(_find(z.q, "UZB") >= 0, _find(z.q, "UZB")).when(near >= 0, near))
    # fields by the country's place
    z(lead=F.translate(_cut(z.q, 0, z.u), "<", ""))
    with_digit = (F.length(z.lead) >= 9) & z.lead.rlike("[0-9]$")
    z(rd=F.when(with_digit, F.substring(z.lead, F.lit(1), F.length(z.lead) - 1)).otherwise(z.lead), rk=F.when(with_digit, F.substring(z.lead, F.length(z.lead), F.lit(1))))
    direct = _cut(z.q, z.u + 18, z.u + 32)
    fixed_place = _cut(z.q, 28, 42)
    pin = F.when(direct.rlike("^[3456][0-9]{13}$"), direct).when((F.length(z.q) >= 42) & fixed_place.rlike("^[3456][0-9]{13}$"), fixed_place).otherwise(_blank_null(F.regexp_extract(_cut(z.q, z.u + 15, F.length(z.q)), "([3-6][0-9]{13})", 1)))
    loose = F.when((F.length(z.q) >= 42) & fixed_place.rlike("^[3456][0-9]{13}$"), fixed_place).otherwise(_blank_null(F.regexp_extract(_cut(z.q, 25, F.length(z.q)), "([3-6][0-9]{13})", 1)))
    z(ppin=mrz.correct_pinfl(F.when(z.u.isNotNull(), pin).otherwise(loose))["value"])
    z(pbk=_digit(_at(z.q, z.u + 9)), pb=F.when(F.length(z.q) >= z.u + 9, _cut(z.q, z.u + 3, z.u + 9)), pown=F.concat(F.substring(z.ppin, 6, 2), F.substring(z.ppin, 4, 2), F.substring(z.ppin, 2, 2)))
    # fields by absolute place
    adoc = F.coalesce(_blank_null(F.regexp_extract(z.q, "([A-Z]{2}[0-9]{7})", 1)), F.translate(_cut(z.q, 0, 9), "<", ""))
    state = F.translate(_cut(z.q, 10, 13), "<", "")
    # --- corrections of all fields ---
    headless = z.rd.rlike("^[A-Z][0-9]{7}$") & z.rk.isNotNull()
    guesses = [F.when(headless, F.concat(F.lit(h), z.rd)) for h in ("A", "P", "B")]
    expires = F.when(F.length(z.q) >= z.u + 17, _cut(z.q, z.u + 11, z.u + 17))
    pairs = [(z.choice["d"], z.choice["k"]), (z.bc, z.bk), (z.six, z.last), (z.rd, z.rk), (z.pb, z.pbk), (expires, _digit(_at(z.q, z.u + 17))), (adoc, _digit(_at(z.q, 9))), (_cut(z.q, 13, 19), _digit(_at(z.q, 19)))]
    z(fix=_corrected(pairs + [(g, z.rk) for g in guesses]))
    fix = lambda i: F.get(z.fix, i)
    value = lambda i: fix(i)["value"]
    ec = F.when(F.length(z.chunk) == 7, F.when(z.last.isNotNull(), value(2))).when(F.length(z.chunk) >= 8, F.coalesce(z.drop, z.six)).when(F.length(z.chunk) == 6, z.six)
    untouched = F.coalesce(*[F.when(headless & ~fix(len(pairs) + i)["corrected"], g) for i, g in enumerate(guesses)])
    z(
        doc=F.when(z.choice["k"].isNotNull() & fix(0)["corrected"] & value(0).rlike(_DOC), value(0)).otherwise(z.choice["d"]),
        birth=F.coalesce(mrz.birth_date(own, as_of_year), F.when(z.bc.rlike("^[0-9]{6}$"), mrz.birth_date(value(1), as_of_year))),
        expiry=F.coalesce(mrz.expiry_date(ec), mrz.expiry_date(F.regexp_extract(mrz.clean_date_digits(z.l2), r"[MF][^0-9]*([0-9]{6})", 1))),
        pdoc=F.when(headless, F.coalesce(untouched, z.rd)).otherwise(value(3)),
        pb=F.when(z.pbk.isNotNull() & (mrz.check_digit(z.pown) == z.pbk) & z.ppin.isNotNull(), z.pown).otherwise(F.coalesce(value(4), z.pown)),
    )
    card = F.struct(F.lit(True).alias("mrz_detected"), F.lit(TD1).alias("format"), z.doc.alias("document_number"), z.pin["value"].alias("jshshir"), z.sur.alias("surname"), z.given.alias("first_name"), z.birth.alias("birth_date"), z.expiry.alias("expiry_date"), F.when(z.sex == "M", "Erkak").when(z.sex == "F", "Ayol").alias("gender"), F.lit(COUNTRY).alias("nationality"))
    is_card = z.i1.isNotNull() & F.coalesce(z.doc, z.pin["value"], z.sur, z.birth).isNotNull()
    century = F.when(z.ppin.rlike("^[56]"), 2000).when(z.ppin.rlike("^[34]"), 1900)
    psex = _at(z.q, z.u + 10)
    gender = lambda c: F.when(c == "M", "Erkak").when(c == "F", "Ayol")
    anchored = F.struct(F.lit(True).alias("mrz_detected"), F.lit(TD3).alias("format"), z.pdoc.alias("document_number"), z.ppin.alias("jshshir"), z.psur.alias("surname"), z.pgiven.alias("first_name"), mrz.birth_date(z.pb, as_of_year, F.coalesce(century, F.lit(0))).alias("birth_date"), mrz.expiry_date(value(5)).alias("expiry_date"), gender(psex).alias("gender"), F.lit(COUNTRY).alias("nationality"))
    absolute = F.struct(F.lit(True).alias("mrz_detected"), F.lit(TD3).alias("format"), value(6).alias("document_number"), z.ppin.alias("jshshir"), z.psur.alias("surname"), z.pgiven.alias("first_name"), mrz.birth_date(value(7), as_of_year).alias("birth_date"), mrz.expiry_date(_cut(z.q, 21, 27)).alias("expiry_date"), gender(_at(z.q, 20)).alias("gender"), F.when(state.isin("UZB", "UZ", "U72", "U72B", "U2B", "UZ8", "0ZB"), F.lit(COUNTRY)).otherwise(state).alias("nationality"))
    record = F.when(F.size(text) < 2, F.lit(None)).when(is_card, card).when(z.j.isNotNull(), F.when(z.u.isNotNull(), anchored).otherwise(absolute))
    return z.done(mrz=record)


def checksums(df: DataFrame, lines: str = "lines", record: str = "mrz") -> DataFrame:
    """df with ``mrz_checksums``: which check digits of the zone's lines hold, after correction; null for what could not be tested.

    The composite digit is reported but not part of all_passed.
    """
    z = Stage(df)
    m = F.col(record)
    z(t=F.transform(F.filter(F.col(lines), lambda x: F.trim(x) != ""), lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))))
    has = m.isNotNull() & (F.size(F.coalesce(F.col(lines), F.array().cast("array<string>"))) >= 2)
    z(i=F.when(has & (m["format"].contains("TD1") | (F.size(z.t) >= 3)), _window(z.t, lambda x, i: x.rlike("^[I1AC]|^.{0,7}UZB") & (F.length(x) >= 20) & (i < F.size(z.t) - 2))))
    pad = lambda s, n: F.rpad(s, F.greatest(F.length(s), F.lit(n)), F.lit("<"))
    z(a=pad(F.get(z.t, z.i), 30), b=pad(F.get(z.t, z.i + 1), 30))
    ext = m["document_number"]
    norm = mrz.normalize_nine(ext)
    place = F.when(F.instr(z.a, ext) > 0, F.instr(z.a, ext)).otherwise(F.instr(z.a, norm))
    d1 = F.when((F.length(ext) == 9) & (place > 0) & _at(z.a, place + 8).rlike("[0-9]"), F.struct(norm.alias("d"), _at(z.a, place + 8).alias("k")))
    spot = F.regexp_instr(z.a, F.lit("[3-6][0-9]{13}<?$"))
    chunk = F.substring(z.a, spot - 10, F.lit(10))
    c2 = mrz.normalize_nine(F.substring(chunk, 1, 9))
    d2 = F.when((spot > 10) & c2.rlike("^[A-Za-z]{2}[0-9]{7}$"), F.struct(c2.alias("d"), _digit(F.substring(chunk, 10, 1)).alias("k")))
    c3 = mrz.normalize_nine(F.regexp_extract(z.a, "([A-Z0-9]{2}[0-9]{7})([0-9])?", 1))
    d3 = F.when(c3.rlike("^[A-Za-z]{2}[0-9]{7}$"), F.struct(c3.alias("d"), _digit(F.regexp_extract(z.a, "([A-Z0-9]{2}[0-9]{7})([0-9])?", 2)).alias("k")))
    u = _find(z.a, "UZB")
    d4 = F.when((u >= 0) & (F.length(z.a) >= u + 13), F.struct(mrz.normalize_nine(_cut(z.a, u + 3, u + 12)).alias("d"), _digit(_at(z.a, u + 12)).alias("k"))).otherwise(F.struct(mrz.normalize_nine(_cut(z.a, 5, 14)).alias("d"), _digit(_at(z.a, 14)).alias("k")))
    z(doc=F.when(z.i.isNotNull(), F.coalesce(d1, d2, d3, d4)))
    z(l2=F.translate(z.b, "МЖ", "MF"))
    rx = "([A-Z0-9]{6})([0-9])[MF<]([A-Z0-9]{6})([0-9])"
    pair = lambda raw, k: F.struct(raw.alias("d"), k.alias("k"))
    z(sx=F.get(F.filter(F.array(*[F.lit(i) for i in range(5, 12)]), lambda i: _at(z.l2, i).isin("M", "F")), 0))
    head = mrz.clean_date_digits(_cut(z.l2, 0, z.sx))
    rest = mrz.clean_date_digits(_cut(z.l2, z.sx + 1, F.length(z.l2)))
    birth = F.when(z.l2.rlike(rx), pair(mrz.clean_date_digits(F.regexp_extract(z.l2, rx, 1)), F.regexp_extract(z.l2, rx, 2))).when(z.sx >= 6, F.when(F.length(head) >= 7, pair(F.substring(head, F.length(head) - 6, F.lit(6)), _digit(F.substring(head, F.length(head), F.lit(1))))).otherwise(pair(F.substring(head, 1, 6), _digit(F.substring(head, 7, 1))))).otherwise(pair(mrz.clean_date_digits(_cut(z.l2, 0, 6)), _digit(_at(z.l2, 6))))
    expiry = F.when(z.l2.rlike(rx), pair(mrz.clean_date_digits(F.regexp_extract(z.l2, rx, 3)), F.regexp_extract(z.l2, rx, 4))).when(z.sx >= 6, F.when(F.length(rest) >= 7, pair(F.substring(rest, 1, 6), _digit(F.substring(rest, 7, 1))))).otherwise(pair(mrz.clean_date_digits(_cut(z.l2, 8, 14)), _digit(_at(z.l2, 14))))
    z(birth=F.when(z.i.isNotNull(), birth), expiry=F.when(z.i.isNotNull(), expiry))
    # passport
    second = F.get(F.filter(z.t, lambda x: x.rlike("^[A-Z0-9<]{30,44}$") & (x.rlike("^[A-Z]{2}[0-9]{7}") | (x.contains("UZB") & x.rlike("[0-9]{6}")))), 0)
    z(p=F.when(has & z.i.isNull(), second))
    target = F.when(F.length(ext) == 9, ext)
    z(p=F.when(target.isNotNull() & ~z.p.startswith(target), F.when(z.p.startswith(F.substring(target, 2, 8)), F.concat(F.substring(target, 1, 1), z.p)).otherwise(z.p)).when((_find(z.p, "UZB") == 9) & (F.length(z.p) == 43), F.concat(F.coalesce(F.substring(target, 1, 1), F.lit("A")), z.p)).otherwise(z.p))
    z(p=pad(z.p, 44))
    z(doc=F.coalesce(z.doc, F.when(z.p.isNotNull(), pair(_cut(z.p, 0, 9), _digit(_at(z.p, 9))))), birth=F.coalesce(z.birth, F.when(z.p.isNotNull(), pair(_cut(z.p, 13, 19), _digit(_at(z.p, 19))))), expiry=F.coalesce(z.expiry, F.when(z.p.isNotNull(), pair(_cut(z.p, 21, 27), _digit(_at(z.p, 27))))))
    names = ("doc", "birth", "expiry")
    z(fix=_corrected([(F.col(f"_z_{n}")["d"], F.col(f"_z_{n}")["k"]) for n in names]))
    tried = lambda n: (F.col(f"_z_{n}")["d"] != "") & F.col(f"_z_{n}")["k"].isNotNull()
    z(**{f"{n}_fix": F.when(tried(n), F.get(z.fix, i)) for i, n in enumerate(names)})
    z(**{f"{n}_ok": F.when(F.col(f"_z_{n}_fix").isNotNull(), mrz.verify(F.col(f"_z_{n}_fix")["value"], F.col(f"_z_{n}")["k"])) for n in names})
    card = F.when(_at(z.b, 29).rlike("[0-9]"), mrz.verify(F.concat(_cut(z.a, 5, 30), _cut(z.b, 0, 7), _cut(z.b, 8, 15), _cut(z.b, 18, 29)), _at(z.b, 29)))
    passport = F.when(_at(z.p, 43).rlike("[0-9]"), mrz.verify(F.concat(_cut(z.p, 0, 10), _cut(z.p, 13, 20), _cut(z.p, 21, 43)), _at(z.p, 43)))
    tested = F.filter(F.array(z.doc_ok, z.birth_ok, z.expiry_ok), lambda x: x.isNotNull())
    fixes = [F.when(F.col(f"_z_{n}_fix")["corrected"], F.concat(F.lit(f"{label} '"), F.col(f"_z_{n}")["d"], F.lit("' -> '"), F.col(f"_z_{n}_fix")["value"], F.lit("'"))) for n, label in (("doc", "DocNum"), ("birth", "BirthDate"), ("expiry", "ExpiryDate"))]
    applied = F.filter(F.array(*fixes), lambda x: x.isNotNull())
    report = F.struct(F.when(has, m["format"]).alias("format"), has.alias("has_mrz"), ((F.size(tested) > 0) & F.forall(tested, lambda x: x)).alias("all_passed"), z.doc_ok.alias("document_number_valid"), z.birth_ok.alias("birth_date_valid"), z.expiry_ok.alias("expiry_date_valid"), F.when(z.i.isNotNull(), card).otherwise(passport).alias("composite_valid"), applied.alias("auto_corrections_applied"))
    return z.done(mrz_checksums=report)


def cross_check(pinfl: Column, birth: Column, gender: Column) -> Column:
    """struct<status, is_valid, birth_date_matches, gender_matches, pinfl_parsed, alerts>: the personal number against birth date and gender."""
    p = F.regexp_replace(F.coalesce(pinfl, F.lit("")), r"[\s-]+", "")
    lead = F.substring(p, 1, 1)
    sex = F.when(lead.isin("1", "3", "5"), "Erkak").otherwise("Ayol")
    century = F.when(lead.isin("1", "2"), 1800).when(lead.isin("3", "4"), 1900).otherwise(2000)
    day, month, year = F.substring(p, 2, 2), F.substring(p, 4, 2), century + F.substring(p, 6, 2).try_cast("int")
    own = F.concat_ws("-", year.cast("string"), month, day)
    failed = F.when(p == "", "not_applicable").when(~p.rlike("^[0-9]{14}$"), "invalid_format").when(~lead.rlike("[1-6]"), "invalid_lead_digit").when(~p.rlike("^.(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])"), "invalid_date_component")
    b = F.trim(birth)
    dated = b.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    bm, bd = F.substring(b, 6, 2), F.substring(b, 9, 2)
    months = ("04", "06", "01", "07")
    one_off = lambda x, y: (F.substring(x, 1, 1) == F.substring(y, 1, 1)) | (F.substring(x, 2, 1) == F.substring(y, 2, 1))
    optical = (F.substring(b, 1, 4) == year.cast("string")) & F.when(bd == day, bm.isin(*months) & month.isin(*months)).when(bm == month, one_off(bd, day)).otherwise(F.lit(False))
    birth_ok = F.when(failed.isNull() & dated, (b == own) | optical)
    g = F.lower(F.trim(gender))
    told = F.when(g.contains("erkak") | g.contains("male") | (g == "m"), "erkak").when(g.contains("ayol") | g.contains("female") | (g == "f"), "ayol")
    gender_ok = F.when(failed.isNull() & told.isNotNull(), told == F.lower(sex))
    valid = F.when(failed == "not_applicable", True).when(failed.isNotNull(), False).otherwise(F.coalesce(birth_ok, F.lit(True)) & F.coalesce(gender_ok, F.lit(True)))
    status = F.coalesce(failed, F.when(~valid, "mismatch_detected").when(F.coalesce(birth_ok, F.lit(False)) | F.coalesce(gender_ok, F.lit(False)), "verified").otherwise("partially_verified"))
    alerts = F.filter(F.array(F.when(failed.startswith("invalid"), failed), F.when(~birth_ok, "birth_date_mismatch"), F.when(~gender_ok, "gender_mismatch")), lambda x: x.isNotNull())
    parsed = F.when(failed.isNull(), F.struct(sex.alias("gender"), F.concat(century.cast("string"), F.lit("s")).alias("century"), own.alias("birth_date")))
    return F.struct(status.alias("status"), valid.alias("is_valid"), birth_ok.alias("birth_date_matches"), gender_ok.alias("gender_matches"), parsed.alias("pinfl_parsed"), alerts.alias("alerts"))


#: Coded alerts of the personal number and the status that each leads to: those about mismatch or an unusable date fail, the rest warn.
FAILING = ("birth_date_mismatch", "gender_mismatch", "invalid_date_component")


def report(checks: Column, pinfl: Column, cross: Column) -> Column:
    """struct<is_authentic, overall_status, fraud_alerts> from the checksum report, the personal number and its cross-check."""
    zone = F.filter(F.array(F.when(~checks["document_number_valid"], "mrz_document_number"), F.when(~checks["birth_date_valid"], "mrz_birth_date"), F.when(~checks["expiry_date_valid"], "mrz_expiry_date")), lambda x: x.isNotNull())
    alerts = F.concat(cross["alerts"], F.when(checks["has_mrz"], zone).otherwise(F.array().cast("array<string>")))
    failing = F.exists(alerts, lambda a: a.isin(*FAILING))
    status = F.when(F.size(alerts) > 0, F.when(failing, "FAIL").otherwise("WARN")).when(checks["all_passed"] | (cross["status"] == "verified"), "PASS").when(~checks["has_mrz"] & (F.coalesce(pinfl, F.lit("")) == ""), "NOT_APPLICABLE").otherwise("PASS")
    return F.struct((F.size(alerts) == 0).alias("is_authentic"), status.alias("overall_status"), alerts.alias("fraud_alerts"))
