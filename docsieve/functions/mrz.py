"""Machine-readable-zone scalars as Column expressions: check digits, normalisation, correction, dates.

Booleans are three-valued where a report needs "not tested". Every function accepts null and states its result for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: weights, alphabets and look-alike tables of the document standard and of the OCR engine's confusions ---
WEIGHTS = (7, 3, 1)
LETTER_VALUES = "123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONFUSIONS = {
    "0": ["O", "Q", "D", "U", "8", "6"],
    "O": ["0", "Q", "D"],
    "Q": ["0", "O"],
    "D": ["0", "O"],
    "U": ["0"],
    "1": ["I", "L", "|", "T", "7"],
    "I": ["1", "L", "|", "T"],
    "L": ["1", "I"],
    "|": ["1", "I"],
    "T": ["1", "7", "I"],
    "7": ["1", "T"],
    "2": ["Z", "4", "7"],
    "Z": ["2", "7"],
    "3": ["5", "8", "E"],
    "4": ["2", "A", "6"],
    "A": ["4"],
    "5": ["S", "3", "6"],
    "S": ["5"],
    "8": ["B", "3", "0"],
    "B": ["8"],
    "6": ["G", "b", "4", "0", "5"],
    "G": ["6"],
}
PINFL_SUBSTITUTES = {"8": "203", "2": "871", "1": "74", "7": "12", "0": "689", "6": "058", "5": "63", "3": "58"}
PINFL_POSITIONS = (12, 11, 10, 9, 8, 7, 13)
FIRST_DIGITS, FIRST_LETTERS = "4018257", "AOIBZST"
SECOND_DIGITS, SECOND_LETTERS = "40182573", "AOIBZSTE"
TAIL_LETTERS, TAIL_DIGITS = "ODQILTZBSGA", "00011128564"
DATE_LETTERS, DATE_DIGITS = "ODQoILl|TZzASsGbB", "00001111122455668"
SIX_LETTERS, SIX_DIGITS = "ODQBSZILTAG", "00085211146"
CYRILLIC = "АВЕКМНРСТХУЗОЬъавекмнорстху"
LATIN = "ABEKMHPCTXY30  ABEKMHOPCTXY"
NOISE = "«»{}()[]|/\\cC"
# --- end of fixed values ---


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def char_value(c: Column) -> Column:
    """0-9 as they are, A-Z from 10, anything else 0."""
    return F.when(F.length(c) == 1, F.instr(F.lit(LETTER_VALUES), F.upper(c))).otherwise(F.lit(0))


#: Letters whose upper case is one of A-Z.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyzıſ", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS"


def weighted_sum(s: Column) -> Column:
    """The sum of ``char_value`` by WEIGHTS; letters are raised for the whole text at once, not one call a character."""
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    value = lambda c: F.when(c != "", F.instr(F.lit(LETTER_VALUES), c)).otherwise(F.lit(0))
    return F.aggregate(F.transform(F.split(F.translate(s, _LOWER, _UPPER), ""), lambda c, i: value(c) * F.get(weight, i % 3)), F.lit(0), lambda a, x: a + x)


def check_digit(s: Column) -> Column:
    """The check digit as text; of null or empty text "0"."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("0")).otherwise((weighted_sum(s) % 10).cast("string"))


def verify(s: Column, digit: Column) -> Column:
    """Never null: a digit that is missing or not one digit is false."""
    return F.coalesce(digit.rlike("^[0-9]$") & (check_digit(s) == digit), F.lit(False))


def normalize_nine(s: Column) -> Column:
    """A number of nine characters: letters first, digits after; other lengths as they are, null as empty."""
    u = F.upper(s)
    fixed = F.concat(F.translate(F.substring(u, 1, 1), FIRST_DIGITS, FIRST_LETTERS), F.translate(F.substring(u, 2, 1), SECOND_DIGITS, SECOND_LETTERS), F.translate(F.substring(u, 3, 7), TAIL_LETTERS, TAIL_DIGITS))
    return F.when(F.length(s) == 9, fixed).otherwise(F.coalesce(s, F.lit("")))


def normalize_document(s: Column) -> Column:
    """As ``normalize_nine`` after everything but ASCII letters and digits is stripped; upper case at any length, null as empty."""
    bare = F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), "[^A-Za-z0-9]", ""))
    return normalize_nine(bare)


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _value(c: str) -> int:
    return LETTER_VALUES.find(c.upper()) + 1


def _alternatives() -> Column:
    """map of a character to its look-alikes and what each adds to the character's value, modulo 10."""
    option = lambda key, v: f"named_struct('alt', '{v}', 'adds', {(_value(v) - _value(key)) % 10})"
    return F.expr("map(" + ", ".join(f"'{key}', array({', '.join(option(key, v) for v in values)})" for key, values in CONFUSIONS.items()) + ")")


def _is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


def _nine_ok(s: Column) -> Column:
    return (F.length(s) != 9) | s.rlike("^[^0-9]{2}[0-9]{7}$")


def _replaced(s: Column, i: Column, alt: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), i), alt, F.substring(s, i + 2, F.length(s)))


def _places(up: Column) -> Column:
    """array<struct<i, digit, alts: array<struct<k, alt, adds>>>>: the places with look-alikes, and what each of these adds to the check digit."""
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    found = F.transform(chars(up), lambda ch, i: F.struct(i.alias("i"), _is_digit(ch).cast("int").alias("digit"), F.transform(F.try_element_at(_alternatives(), ch), lambda o, k: F.struct(k.alias("k"), o["alt"].alias("alt"), (o["adds"] * F.get(weight, i % 3) % 10).alias("adds"))).alias("alts")))
    return F.filter(found, lambda p: p["alts"].isNotNull())


def _single(y: Column) -> Column:
    """The first single substitution of y: struct<up, places, wanted> that adds what is wanted."""
    date_order = F.array(*[F.lit(x) for x in (5, 4, 1, 0, 3, 2)])  # rank of places 0..5 for six digits: 3, 2, 5, 4, 1, 0
    rank = lambda p: F.when(y["up"].rlike("^[0-9]{6}$"), F.get(date_order, p["i"])).otherwise(p["digit"] * 1000 + p["i"])
    month_day = lambda s: (F.length(s) != 6) | s.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$")
    each = F.flatten(F.transform(y["places"], lambda p: F.transform(F.filter(p["alts"], lambda o: o["adds"] == y["wanted"]), lambda o: F.struct(rank(p).alias("r"), o["k"].alias("k"), _replaced(y["up"], p["i"], o["alt"]).alias("s")))))
    return F.array_min(F.filter(each, lambda x: _nine_ok(x["s"]) & month_day(x["s"])))


def _double(y: Column) -> Column:
    """The first two substitutions that together add what is wanted; strings are made only for those that do."""

    def beside(p, o):
        later = F.filter(y["places"], lambda q: q["i"] > p["i"])
        fit = lambda q: F.filter(q["alts"], lambda u: (o["adds"] + u["adds"]) % 10 == y["wanted"])
        return F.flatten(F.transform(later, lambda q: F.transform(fit(q), lambda u: F.struct((p["digit"] + q["digit"]).alias("d"), p["i"].alias("i"), q["i"].alias("j"), o["k"].alias("k"), u["k"].alias("k2"), _replaced(_replaced(y["up"], p["i"], o["alt"]), q["i"], u["alt"]).alias("s")))))

    six_ok = lambda s: (F.length(s) != 6) | s.rlike("^[0-9]{6}$")
    each = F.flatten(F.flatten(F.transform(y["places"], lambda p: F.transform(p["alts"], lambda o: beside(p, o)))))
    return F.array_min(F.filter(each, lambda x: _nine_ok(x["s"]) & six_ok(x["s"])))


def auto_correct(field: Column, digit: Column) -> Column:
    """struct<value, corrected>: the first substitution of look-alikes, in a fixed order, that meets the check digit.

    Order: the normalised nine-character number; the field as it is; six-character dates with letters read as digits; one
    substitution; two substitutions. Without a hit the (normalised) field and false. A blank field or a digit that is null or none: the field and false.

    The check digit is linear modulo 10, so a substitution counts by what it adds; the search runs only for fields whose digit doesn't hold.
    """
    result = lambda value, flag: F.struct(value.alias("value"), F.lit(flag).alias("corrected") if isinstance(flag, bool) else flag.alias("corrected"))

    def searched(x):
        up = F.upper(x["norm"])
        six = F.translate(up, SIX_LETTERS, SIX_DIGITS)
        six_hit = (F.length(up) == 6) & up.rlike("[A-Z]") & six.rlike("^[0-9]+$") & (check_digit(six) == x["digit"])
        wanted = F.pmod(x["digit"].try_cast("int") - weighted_sum(up), F.lit(10))
        parts = F.struct(up.alias("up"), _places(up).alias("places"), wanted.alias("wanted"))
        two = lambda y: let(_double(y), lambda d: F.when(d.isNotNull(), result(d["s"], True)).otherwise(result(x["norm"], False)))
        one = lambda y: let(_single(y), lambda s: F.when(s.isNotNull(), result(s["s"], True)).otherwise(two(y)))
        return F.when(six_hit, result(six, True)).when(_is_digit(x["digit"]), let(parts, one)).otherwise(result(x["norm"], False))

    def corrected(x):
        nine = F.length(x["field"]) == 9
        known = (F.coalesce(x["field"], F.lit("")) != "") & x["digit"].rlike("^[0-9]+$")
        norm = F.when(nine, normalize_nine(x["field"])).otherwise(x["field"])
        named = F.struct(x["field"].alias("field"), x["digit"].alias("digit"), norm.alias("norm"))
        checked = lambda y: F.when(check_digit(y["norm"]) == y["digit"], result(y["norm"], (F.length(y["field"]) == 9) & (y["norm"] != y["field"]))).otherwise(searched(y))
        return F.when(~F.coalesce(known, F.lit(False)), result(x["field"], False)).otherwise(let(named, checked))

    return let(F.struct(field.alias("field"), digit.alias("digit")), corrected)


def pinfl_digit(s: Column) -> Column:
    """Check digit over the first 13 digits; -1 where they are not there."""
    return F.when(s.rlike("^[0-9]{13}"), (weighted_sum(F.substring(s, 1, 13)) % 10).cast("int")).otherwise(F.lit(-1))


def correct_pinfl(s: Column) -> Column:
    """struct<value, corrected>: the first single-digit substitution, in scanning order, that meets the last digit."""
    good = lambda x: pinfl_digit(x).cast("string") == F.substring(x, 14, 1)
    options = [(place, digit, other) for place in PINFL_POSITIONS for digit, others in PINFL_SUBSTITUTES.items() for other in others]
    table = F.expr("array(" + ", ".join(f"named_struct('at', {place}, 'digit', '{digit}', 'other', '{other}')" for place, digit, other in options) + ")")
    fitting = F.filter(table, lambda o: F.substring(s, o["at"] + 1, F.lit(1)) == o["digit"])
    tries = F.transform(fitting, lambda o: F.concat(F.substring(s, F.lit(1), o["at"]), o["other"], F.substring(s, o["at"] + 2, F.lit(14))))
    hit = F.get(F.filter(tries, good), 0)
    apt = F.coalesce(s.rlike("^[1-6][0-9]{13}$"), F.lit(False))
    fixed = F.when(apt & ~good(s), hit)
    return F.struct(F.coalesce(fixed, s).alias("value"), fixed.isNotNull().alias("corrected"))


def clean_date_digits(s: Column) -> Column:
    return F.translate(s, DATE_LETTERS, DATE_DIGITS)


def _plausible(s: Column) -> Column:
    return s.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$")


def birth_date(s: Column, as_of_year: int, century: Column | None = None) -> Column:
    """YYMMDD to YYYY-MM-DD; a given century (1800, 1900, 2000) rules, else the pivot of 14 years before ``as_of_year``."""
    yy = F.substring(s, 1, 2).try_cast("int")
    pivot = F.when(yy <= (as_of_year - 14) % 100, 2000 + yy).otherwise(1900 + yy)
    year = pivot if century is None else F.when(century.isin(1800, 1900, 2000), century + yy).otherwise(pivot)
    return F.when(_plausible(s), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.substring(s, 3, 2), F.substring(s, 5, 2)))


def expiry_date(s: Column) -> Column:
    """YYMMDD to 20YY-MM-DD; the fifties are misread thirties."""
    yy = F.substring(s, 1, 2).try_cast("int")
    year = 2000 + F.when(yy.between(50, 59), yy - 20).otherwise(yy)
    return F.when(_plausible(s), F.concat_ws("-", year.cast("string"), F.substring(s, 3, 2), F.substring(s, 5, 2)))


def clean_lines(text: Column, legacy: bool = True) -> Column:
    """array<string>: lines of the zone: look-alikes folded, noise as ``<``, upper case; long enough and with a filler or a long number.

    legacy keeps the Latin letter C among the noise, as the engine does; without it only the other marks are.
    """
    noise = NOISE if legacy else NOISE.replace("c", "").replace("C", "")
    # one pass of translate: a Cyrillic look-alike of C becomes the letter, a Latin C a filler
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.upper(F.regexp_replace(F.translate(x, noise + CYRILLIC, "<" * len(noise) + LATIN), r"[^\p{L}\p{Nd}<]", "")))
    return F.filter(clean, lambda x: (F.length(x) >= 20) & (x.contains("<") | ((F.length(x) >= 30) & x.rlike("[0-9]{6}"))))


def score_candidate(m: Column) -> Column:
    """Points of a parsed record; -1 for none."""
    present = lambda f: F.coalesce(m[f], F.lit("")) != ""
    doc = F.when(m["document_number"].rlike("^[A-Za-z]{2}[0-9]{7}$"), 35).when(present("document_number"), 10).otherwise(0)
    pinfl = F.when(m["jshshir"].rlike("^[3456][0-9]{13}$"), 35).when(present("jshshir"), 10).otherwise(0)
    points = F.when(F.coalesce(m["mrz_detected"], F.lit(False)), 10).otherwise(0) + doc + pinfl
    points += F.when(present("birth_date"), 20).otherwise(0) + F.when(present("expiry_date"), 15).otherwise(0)
    points += F.when(present("surname") & present("first_name"), 15).otherwise(0)
    return F.when(m.isNull(), F.lit(-1)).otherwise(points)


def rightmost_pinfl(s: Column) -> Column:
    """struct<at, value>: the last, possibly overlapping, run of 14 digits with a lead 1-6 and a plausible day and month; at counts from 1."""
    spots = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 13, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring(s, i, F.lit(14)).alias("value")))
    fits = F.filter(spots, lambda x: x["value"].rlike("^[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}$"))
    return F.when(F.length(s) >= 14, F.try_element_at(fits, F.lit(-1)))


def name_token(tok: Column, surname: bool) -> Column:
    """A name of the passport zone without digits, fillers and the trailing noise letters."""
    t = F.regexp_replace(F.trim(tok), "^[0-9]+", "")
    t = F.trim(F.regexp_replace(t, "<{2,}.*$", ""))
    t = F.trim(F.translate(F.trim(F.regexp_replace(t, "<+$", "")), "<", " "))
    t = F.trim(F.regexp_replace(t, r"^[A-Z]\s+", ""))
    t = F.regexp_replace(t, "(OVA|EVA|IYEV|IYEVA|OV|EV|LI|QIZI)[SKCE]+$", "$1") if surname else F.regexp_replace(t, "([AEIOUY])S+$", "$1")
    return F.trim(F.regexp_replace(t, r"\s+[SKCE]$", ""))
