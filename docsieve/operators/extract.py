"""Fields out of OCR text: dates, names, gender, nationality, places, authority. Array expressions within a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mrz import let
from ..functions.text import APOSTROPHES, document_number, fold, no_apostrophes, personal_number, repair_given_name, repair_patronymic, strong_first_name
from .extract_words import NOT_NAMES, PATRONYMIC_END, name_like, tokens
from .layout import given_between, patronymic_below
from .zone import COUNTRY, Stage

# --- fixed values: stems and words of labels, suffixes, label and place patterns of the documents ---
SURNAME_LABEL = r"(?iu)famili|surname|fairo|farmi|fatnili|farui|farni|zurna"
GIVEN_LABEL = r"(?iu)\b[i1l]?[s5][mn]i\b|g[i1l]?[uvw]en|\bnames?\b"
PATRONYMIC_LABEL = r"(?iu)otasining\s*is[mn]?[i1]?|patr"
PATRONYMIC = r"(?iu)\b([A-Za-zА-Яа-я][A-Za-zА-Яа-я'ʻʼ`]{2,20}\s+(?:O['ʻʼ`]?\s*G['ʻʼ`]?\s*LI|QIZI|GIZI)|[A-Za-zА-Яа-я][A-Za-zА-Яа-я'ʻʼ`]{2,25}?(?:OVICH|EVICH|OVISH|EVISH|OWICH|EWICH|OWIEH|OVIBH|OVICR|EVICR|OVIC|EVIC|OVI4|EVI4|OVNA|EVNA|OVHA|EVHA|OWNA|EWNA|VICH|VISH|VNA)|O['ʻʼ`]?\s*G['ʻʼ`]?\s*LI|QIZI|GIZI)\b"
PATRONYMIC_NOT = "BERIL|SANASI|DATE|ISSUE|FUQAR|CITIZEN|TUGIL|RESPUBL"
PEOPLES = r"(?iu)\b(O['ʻʼ`]?ZBEK|RUS|QOZOQ|TOJIK|TATAR|QORAQALPOQ)\b"
PLACE = r"(?iu)\b([A-Za-zА-Яа-я'ʻʼ`\s-]{3,25}\s+(?:TUMANI|ТУМАНИ|SHAHRI|ША[ХҲ]РИ|VILOYATI|ВИЛОЯТИ|REGION|DISTRICT))\b"
PLACE_NOT = "KIM|TOMONIDAN|BERILGAN|RESPUBLIKASI|IIB|MIIB|BOSHQARMASI|AUTHORITY|CENTRE|PASSPORT|PASPORT|SHAXSIY|IMZO|БУ|ВЕК|BEK|REPUBLIC|UZBEKISTAN"
TOPONYMS = ((r"\bТУМАНИ\b", "TUMANI"), (r"\bША[ХҲ]РИ\b", "SHAHRI"), (r"\bВИЛОЯТИ\b", "VILOYATI"), (r"\bРЕСПУБЛИКАСИ\b", "RESPUBLIKASI"), (r"\bРОР\b", "POP"), (r"\bPOP\s+TOMAMT\b", "POP TUMANI"), (r"\bNAMANGAN\s+REGION\b", "NAMANGAN VILOYATI"), (r"\b[HХ][UУ][SС][TТ]\b", "CHUST"))
AUTHORITY = r"(?iu)\b(IIB|MIIB|ROO|BOSHQARMASI|VILOYATI|CENTRE|CENTER|AUTHORITY)\b"
AUTHORITY_NEXT = r"(?iu)\b(IIB|MIIB|ROO|BOSHQARMASI|TUMANI|CENTRE|CENTER)\b"
AUTHORITY_NOT = "AMAL|MUDDATI|EXPIRY|TUGILGAN|BIRTH|RESPUBLIKASI"
BIRTH_BEFORE, ISSUE_UNTIL = 2012, 2026
# --- end of fixed values ---


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _head(xs: Column) -> Column:
    return F.get(xs, 0)


def every_date(text: Column) -> Column:
    """All dates of the text as YYYY-MM-DD, repeats kept: with separators, as eight digits, and as eight after a stray digit; years 1920 to 2045."""
    parted = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{2}[./\-\s]+[0-9]{2}[./\-\s]+[0-9]{4})\b"), 1), lambda d: F.regexp_replace(d, "[^0-9]", ""))
    day = r"(?:0[1-9]|[12][0-9]|3[01])\s*(?:0[1-9]|1[0-2])\s*(?:19[0-9]{2}|20[0-9]{2})"
    solid = lambda lead: F.transform(F.regexp_extract_all(text, F.lit(rf"\b{lead}({day})\b"), 1), lambda d: F.regexp_replace(d, r"\s", ""))
    made = F.filter(F.concat(parted, solid(""), solid("[0-9]")), lambda d: d.rlike("^(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(19[2-9][0-9]|20[0-3][0-9]|204[0-5])$"))
    return F.transform(made, lambda d: F.concat_ws("-", F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2)))


def dates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``dates``: struct<birth_date, issue_date, expiry_date>, by the order birth < issue < expiry over one date a year (the most frequent, then the earliest)."""
    z = Stage(df)
    z(all=F.coalesce(every_date(F.col(text)), F.array().cast("array<string>")))
    year = lambda d: F.substring(d, 1, 4).cast("int")
    z(each=F.transform(F.array_sort(F.array_distinct(z.all)), lambda d, i: F.struct(F.size(F.filter(z.all, lambda x: x == d)).alias("n"), (-i).alias("p"), d.alias("d"))))
    ahead = lambda y, x: (y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["p"] > x["p"]))
    z(one=F.transform(F.filter(z.each, lambda x: ~F.exists(z.each, lambda y: (year(y["d"]) == year(x["d"])) & ahead(y, x))), lambda x: x["d"]))
    n, first, last = F.size(z.one), F.get(z.one, 0), F.try_element_at(z.one, F.lit(-1))
    gap = lambda d: F.least(F.abs(year(d) - year(last) + 10), F.abs(year(d) - year(last) + 5))
    between = F.slice(z.one, 2, F.greatest(n - 2, F.lit(0)))
    issue = F.array_min(F.transform(between, lambda d, i: F.struct(gap(d).alias("g"), i.alias("i"), d.alias("d"))))["d"]
    early = year(first) < BIRTH_BEFORE
    birth = F.when((n >= 3) | early, first)
    issued = F.when(n >= 3, issue).when(n == 2, F.when(~early, first).when(year(last) <= ISSUE_UNTIL, last)).when((n == 1) & ~early & (year(first) <= ISSUE_UNTIL), first)
    expiry = F.when(n >= 3, last).when(n == 2, F.when(~early | (year(last) > ISSUE_UNTIL), last)).when((n == 1) & ~early & (year(first) > ISSUE_UNTIL), first)
    return z.done(dates=F.struct(birth.alias("birth_date"), issued.alias("issue_date"), expiry.alias("expiry_date")))


def _surname_points(t: Column) -> Column:
    return 2 + F.when(t.rlike("(OV|EV|OVA|EVA)$"), 6).otherwise(0) + F.when(F.length(no_apostrophes(t)) >= 5, 2).otherwise(0)


def _best(candidates: Column) -> Column:
    """The token with the largest sum of points; of equals the one that came first."""

    def ranked(there: Column) -> Column:
        total = lambda t: F.aggregate(F.filter(there, lambda c: c["t"] == t), F.lit(0), lambda s, c: s + c["p"])
        return F.array_max(F.transform(F.array_distinct(F.transform(there, lambda c: c["t"])), lambda t, i: F.struct(total(t).alias("p"), (-i).alias("i"), t.alias("t"))))

    return let(F.filter(candidates, lambda c: c["t"].isNotNull()), ranked)["t"]


def whole_patronymic(text: Column, repairs: tuple[tuple[str, str], ...] = ()) -> Column:
    """The first word of the text with a patronymic's form, or such an ending alone; of one that runs over lines the last line. Null where it is no name."""
    found = F.regexp_extract(F.upper(F.regexp_extract(text, PATRONYMIC, 1)), r"([^\n]*)$", 1)
    bare = F.regexp_replace(F.trim(F.regexp_replace(found, "^[^A-ZА-Я]+", "")), r"^[A-Z]\s+", "")
    fits = (bare != "") & (F.size(F.split(bare, r"\s+")) <= 2) & ~bare.rlike(PATRONYMIC_NOT)
    repaired = repair_patronymic(bare, repairs)
    return F.when(fits & ~repaired.isin(*NOT_NAMES), repaired)


def names(df: DataFrame, text: str = "text", patronymics: tuple[tuple[str, str], ...] = (), given_names: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """df with ``names``: struct<surname, first_name, patronymic>.

    Each line is read once: what it could give as a surname, a given name and a patronymic, with points, and what it is the label of. Lines after a
    label (and, for the surname, before the given-name label) are candidates; points of a word add up. Where no label leads to a name, its
    place does (``layout``), and a passport's national section overrules. Repairs of single persons' names are not built in; the tables take a user's own.
    """
    z = Stage(df)
    z(lines=lines_of(F.col(text)))
    late = r"(VICH|VICR|OVIC|EVIC|VNA|QIZI|OGLI|UGLI)$"
    candidate = lambda t, points: F.struct(t.alias("t"), F.when(t.isNotNull(), points).alias("p"))
    bonus = lambda test, n: F.when(test, n).otherwise(0)

    def read(words: Column) -> Column:
        """What a line's words give: the first fit for each part of the name."""
        late_not = lambda t: ~no_apostrophes(t).rlike(late)
        given = lambda ws: _head(F.filter(F.transform(F.filter(ws, late_not), lambda t: repair_given_name(t, None, given_names)), lambda t: t.isNotNull()))
        fathers = lambda ws: repair_patronymic(_head(F.filter(ws, lambda t: (F.length(no_apostrophes(t)) >= 4) & t.rlike(PATRONYMIC_END))), patronymics)
        found = lambda ws: F.struct(_head(ws).alias("sur"), given(ws).alias("giv"), fathers(ws).alias("pat"))

        def pointed(n: Column) -> Column:
            giv_points = 2 + bonus(strong_first_name(n["giv"]), 8) + bonus(F.length(no_apostrophes(n["giv"])) >= 4, 2)
            return F.struct(candidate(n["sur"], _surname_points(n["sur"])).alias("sur"), candidate(n["giv"], giv_points).alias("giv"), candidate(n["pat"], 2 + bonus(n["pat"].rlike("(VICH|VNA|QIZI|OGLI|UGLI)$"), 6)).alias("pat"))

        # inside a lambda nothing is shared, so the words and what they give are bound once
        return let(F.filter(words, lambda t: name_like(t, 3)), lambda ws: let(found(ws), pointed))

    z(words=F.transform(z.lines, tokens))
    z(each=F.transform(z.words, read))
    label = lambda c: F.when(c.rlike(SURNAME_LABEL), "sur").when(~c.rlike(r"(?iu)otasining|patron") & c.rlike(GIVEN_LABEL), "giv").when(c.rlike(PATRONYMIC_LABEL), "pat").otherwise("")
    z(kind=F.transform(z.lines, lambda x: label(F.translate(fold(x), "'ʻʼ", ""))))
    none = F.array().cast("array<struct<t:string,p:int>>")
    after = lambda i, part: F.transform(F.slice(z.each, i + 2, F.lit(3)), lambda e: e[part])
    behind = lambda i: F.transform(F.slice(z.each, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda e, j: F.struct(e["sur"]["t"].alias("t"), (e["sur"]["p"] + 3 - F.least(i, F.lit(3)) + j).alias("p")))
    led = lambda body: F.flatten(F.transform(z.kind, body))
    # the nearest line before a label comes first among equals
    z(sur=led(lambda k, i: F.when(k == "sur", after(i, "sur")).when(k == "giv", F.reverse(behind(i))).otherwise(none)))
    z(giv=led(lambda k, i: F.when(k == "giv", after(i, "giv")).otherwise(none)))
    z(patc=led(lambda k, i: F.when(k == "pat", after(i, "pat")).otherwise(none)))
    z(surname=_best(z.sur))
    z(first=_best(F.filter(z.giv, lambda c: z.surname.isNull() | (c["t"] != z.surname))))
    z(pat=F.coalesce(whole_patronymic(F.col(text), patronymics), _best(z.patc)))
    z(pat=F.coalesce(z.pat, patronymic_below(z.lines, z.first, patronymics)))
    # the national section of a passport: between the republic's line and the patronymic's label
    card = F.col(text).rlike(r"(?iu)GUVOHNOMASI|KARTA\s*RAQAMI|CARD\s*NUMBER|IDENTITY\s*CARD")
    place = lambda test: _head(F.filter(F.transform(z.lines, lambda x, i: F.struct(F.upper(x).alias("x"), i.alias("i"))), test))["i"]
    z(top=place(lambda e: e["x"].contains("RESPUBLIKASI") & ~e["x"].rlike("REPUBLIC|PASPORT|PASSPORT|GUVOHNOMA")))
    z(end=place(lambda e: (e["i"] > z.top) & e["x"].rlike(r"(?iu)otasining\s*is[mn]?[i1]?")))
    inside = F.when(~card & z.end.isNotNull(), F.slice(z.words, z.top + 2, z.end - z.top - 1))
    z(sect=F.filter(F.flatten(inside), lambda t: name_like(t, 3)))
    nsur = _head(F.filter(z.sect, lambda t: no_apostrophes(t).rlike("(OV|EV|OVA|EVA|IY|IYA)$")))
    z(nsur=nsur)
    nfirst = F.try_element_at(F.filter(z.sect, lambda t: ~no_apostrophes(t).rlike("(OV|EV|OVA|EVA|IY|IYA|VICH|OVNA|EVNA|OGLI|QIZI)$")), F.lit(1))
    z(surname=F.coalesce(z.nsur, z.surname), first=F.coalesce(repair_given_name(nfirst, z.nsur, given_names), z.first))
    spelt = lambda n: F.when(n.contains("KH") & F.upper(F.col(text)).contains(F.replace(n, F.lit("KH"), F.lit("X"))), F.replace(n, F.lit("KH"), F.lit("X"))).otherwise(n)
    z(surname=spelt(z.surname), first=spelt(z.first))
    z(first=F.when(~z.first.eqNullSafe(z.surname), z.first))
    weak = z.surname.isNotNull() & z.pat.isNotNull() & ~strong_first_name(z.first)
    return z.done(names=F.struct(z.surname.alias("surname"), F.when(weak, given_between(z.lines, z.surname, z.first, given_names)).otherwise(z.first).alias("first_name"), z.pat.alias("patronymic")))


def toponym(s: Column) -> Column:
    for pattern, name in TOPONYMS:
        s = F.regexp_replace(s, f"(?iu){pattern}", name)
    return s


def others(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``other``: struct<gender, nationality, birth_place, issuing_authority>."""
    z = Stage(df)
    t = F.coalesce(F.col(text), F.lit(""))
    z(lines=lines_of(t))
    f = fold(t)
    gender = F.when(f.rlike(r"(?iu)\b(ERKAK|MALE|МУЖ)\b|\bERKA\b"), "Erkak").when(f.rlike(r"(?iu)\b(AYOL|FEMALE|ЖЕН)\b"), "Ayol")
    people = F.exists(F.transform(z.lines, lambda x, i: F.concat_ws("\n", x, F.when(x.rlike(r"(?iu)\bMILLAT[I1]?\b"), F.get(z.lines, i + 1)))), lambda x: x.rlike(r"(?iu)\bMILLAT[I1]?\b") & x.rlike(PEOPLES))
    state = r"(?iu)O['ʻʼ`]?ZBEKISTON"
    nationality = F.when(people, "O'zbek").when(t.rlike(r"(?iu)\bO['ʻʼ`]?ZBEK\b") & ~t.rlike(state + r"\s+RESPUBLIKASI"), "O'zbek").when(t.rlike(state + "|UZBEKISTAN|UZB"), COUNTRY)
    found = F.transform(z.lines, lambda x: toponym(F.trim(F.regexp_replace(F.upper(F.trim(F.regexp_extract(x, PLACE, 1))), r"^([MF]\b|[\s\W_\d])+", ""))))
    z(near=_head(F.filter(found, lambda x: (F.length(x) >= 5) & ~x.rlike(PLACE_NOT))))
    tidy = lambda x: toponym(F.trim(F.regexp_replace(x, r"^[\s\W_\d]+", "")))
    label = lambda x: x.rlike(rf"(?iu)tug[{APOSTROPHES}]?ilgan\s*joyi|place\s*of\s*birth")
    after = F.flatten(F.transform(z.lines, lambda x, i: F.when(label(x), F.transform(F.slice(z.lines, i + 2, F.lit(3)), tidy)).otherwise(F.array().cast("array<string>"))))
    spot = _head(F.filter(after, lambda x: (F.length(x) >= 3) & ~x.rlike(r'[:"]|\b\d+\b') & ~F.upper(x).isin("PLACE OF BIRTH", "PLACE", "OF", "BIRTH", "TUGILGAN", "JOYI", "SEX", "M", "F") & ~F.upper(x).rlike(PLACE_NOT)))
    code_label = lambda x: x.rlike(r"(?iu)beri[il1]gan\s*joyi|place\s*of\s*issue")
    codes = F.flatten(F.transform(z.lines, lambda x, i: F.when(code_label(x), F.transform(F.filter(F.slice(z.lines, i + 2, F.lit(3)), lambda y: F.length(y) < 20), lambda y: F.regexp_extract(y, r"\b([0-9]{5})\b", 1))).otherwise(F.array().cast("array<string>"))))
    code = _head(F.filter(codes, lambda c: c != ""))
    joined = F.transform(z.lines, lambda x, i: F.when(x.rlike(AUTHORITY), F.concat_ws(" ", x, F.when(F.get(z.lines, i + 1).rlike(AUTHORITY_NEXT), F.get(z.lines, i + 1)))))
    tidied = F.transform(F.filter(joined, lambda x: x.isNotNull()), lambda x: F.upper(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?iu)^(KIM\s*TOMONIDAN\s*BERILGAN|BERILGAN)\s*", ""), r"\b(118|11B|II8)\b", "IIB"), r"[\d.=\-_~\s]+$", "")), r"\s+", " ")))
    authority = _head(F.filter(tidied, lambda x: (F.length(x) >= 6) & ~x.rlike(AUTHORITY_NOT)))
    return z.done(other=F.struct(gender.alias("gender"), nationality.alias("nationality"), F.coalesce(z.near, F.upper(spot)).alias("birth_place"), F.coalesce(F.concat(F.lit("IIV "), code), authority).alias("issuing_authority")))


def structured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``fields``: all fields of the text in one struct."""
    made = others(names(dates(df, text), text), text)
    t = F.col(text)
    fields = F.struct(document_number(t).alias("document_number"), personal_number(t).alias("jshshir"), *[F.col(f"names.{n}") for n in ("surname", "first_name", "patronymic")], *[F.col(f"dates.{n}") for n in ("birth_date", "expiry_date", "issue_date")], *[F.col(f"other.{n}") for n in ("gender", "nationality", "birth_place", "issuing_authority")])
    return made.withColumn("fields", fields).drop("names", "dates", "other")
