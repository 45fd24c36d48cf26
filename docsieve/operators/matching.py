"""Fuzzy join of many records: all pairs within one look-alike of the document number, whatever session they came with.

A listed look-alike is a letter and the one digit that it is read as, so a record needs no mask: it meets its own number, and for each place with
such a letter the number with the digit there. Every pair is made once, by equality joins alone, and dates and names filter it afterwards.

Records that are equal after normalisation are one profile, combined before the shuffle. Pairs meet on number and year of birth, which must agree anyway.
A number that many profiles have in one year (a placeholder) meets on more: matching dates share their month or their day, and of matching names, spelt
alike, one begins with the other. So the sides meet on month or day and surname and, where that is crowded too, on the first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linkage import PAIRS, dates_match, names_compatible
from ..functions.mrz import chars, normalize_document

#: Profiles of one key above which they meet on more.
HOT = 1000
_LETTERS, _DIGITS = ("".join(p[i] for p in PAIRS) for i in (0, 1))


def profiles(records: DataFrame, id: str = "id") -> DataFrame:
    """(number, birth, surname, first_name, profile, copies): records with what comparison ignores taken away; profile is the least id of the equal ones.

    Records without a number or a birth date match nothing and are left out.
    """
    letters = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))
    bare = records.select(F.col(id).alias("id"), normalize_document(F.col("document_number")).alias("number"), F.regexp_replace(F.coalesce("birth_date", F.lit("")), "[^0-9]", "").alias("birth"), letters(F.col("surname")).alias("surname"), letters(F.col("first_name")).alias("first_name"))
    full = bare.where((F.col("number") != "") & (F.col("birth") != ""))
    return full.groupBy("number", "birth", "surname", "first_name").agg(F.min("id").alias("profile"), F.count("*").alias("copies"))


def look_alike_numbers(number: Column) -> Column:
    """The numbers that differ in one place by a listed letter read as its digit; only those of nine characters have any."""
    changed = F.transform(chars(number), lambda c, i: F.when(c.isin(*_LETTERS), F.concat(F.substring(number, F.lit(1), i), F.translate(c, _LETTERS, _DIGITS), F.substring(number, i + 2, F.lit(9)))))
    return F.when(F.length(number) == 9, F.filter(changed, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def _short(birth: Column) -> Column:
    """The date without its century, on which any two matching dates are near; of other lengths the digits as they are."""
    return F.when(F.length(birth) == 8, F.substring(birth, 3, 6)).otherwise(birth)


def _date_parts(short: Column) -> Column:
    """Month and day, one of which any two matching dates share; of other lengths the digits as they are."""
    return F.when(F.length(short) == 6, F.array(F.concat(F.lit("m"), F.substring(short, 3, 2)), F.concat(F.lit("d"), F.substring(short, 5, 2)))).otherwise(F.array(short))


def spelt_alike(name: Column) -> Column:
    """A name by which any two compatible ones are equal or one begins with the other: K and X (KH) as Q, W as V, no H. Blank begins every name."""
    return F.translate(name, "KXWH", "QQV")


def _beginnings(name: Column, left: bool) -> Column:
    """What a side's name meets the other's by. Either the left one begins the right one (0, then it), or the right one a longer left one (1, then it)."""
    cut = lambda most: F.transform(F.sequence(F.lit(0), most), lambda n: F.substring(name, F.lit(1), n))
    shorter = F.when(name != "", cut(F.length(name) - 1)).otherwise(F.array().cast("array<string>"))
    marked = lambda mark, xs: F.transform(xs, lambda x: F.concat(F.lit(mark), x))
    own = F.array(name)
    return F.concat(marked("0", own), marked("1", shorter)) if left else F.concat(marked("0", cut(F.length(name))), marked("1", own))


#: What the two sides meet on; the last three are empty where a key is not crowded.
KEYS = ("key", "year", "part", "by", "by2")


def sides(found: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join, profiles with KEYS; every matching pair agrees on KEYS, at least once."""
    there = found.withColumns({"short": _short(F.col("birth")), "sur": spelt_alike(F.col("surname")), "giv": spelt_alike(F.col("first_name"))}).withColumn("year", F.substring("short", 1, 2))
    here = there.withColumn("key", F.explode(F.concat(F.array("number"), look_alike_numbers(F.col("number")))))
    one, two = here, there.withColumnRenamed("number", "key")

    def crowded(of: DataFrame, *keys: str) -> DataFrame:
        return of.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*keys, F.lit(True).alias("crowded"))

    more = lambda xs: F.explode(F.when(F.col("crowded"), xs).otherwise(F.array(F.lit(""))))
    many = crowded(two, "key", "year")
    first = lambda side, left: side.join(many, ["key", "year"], "left").withColumn("part", more(_date_parts(F.col("short")))).withColumn("by", more(_beginnings(F.col("sur"), left))).drop("crowded")
    one, two = first(one, True), first(two, False)
    many2 = crowded(two.where("by <> ''"), "key", "year", "part", "by")
    then = lambda side, left: side.join(many2, ["key", "year", "part", "by"], "left").withColumn("by2", more(_beginnings(F.col("giv"), left))).drop("crowded")
    return then(one, True), then(two, False)


def pairs(found: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b, copies_a, copies_b, look_alike): matching profiles, a < b, as ``profiles`` makes them; look_alike: their numbers differ."""
    l, r = (side.alias(n) for side, n in zip(sides(found, hot), "lr"))
    c = F.col
    once = (c("l.number") != c("r.key")) | (c("l.profile") < c("r.profile"))
    # dates that share both have met on the month
    once = once & ~(c("l.part").startswith("d") & (F.substring("l.short", 3, 2) == F.substring("r.short", 3, 2)))
    alike = lambda n: c(f"l.{n}").startswith(c(f"r.{n}")) | c(f"r.{n}").startswith(c(f"l.{n}"))
    # equal keys are matching numbers already
    same = dates_match(c("l.birth"), c("r.birth")) & names_compatible(c("l.surname"), c("r.surname")) & names_compatible(c("l.first_name"), c("r.first_name"))
    met = l.join(r, [*[c(f"l.{k}") == c(f"r.{k}") for k in KEYS], once, alike("sur"), alike("giv")]).where(same)
    swap = c("l.profile") > c("r.profile")
    return met.select(F.least("l.profile", "r.profile").alias("a"), F.greatest("l.profile", "r.profile").alias("b"), F.when(swap, c("r.copies")).otherwise(c("l.copies")).alias("copies_a"), F.when(swap, c("l.copies")).otherwise(c("r.copies")).alias("copies_b"), (c("l.number") != c("r.key")).alias("look_alike"))
