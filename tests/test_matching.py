"""Fuzzy join of records against a plain loop over all pairs, with and without crowded numbers."""

import pytest
from pyspark.sql import functions as F

from docsieve.functions import linkage
from docsieve.operators import matching

SCHEMA = "id long, document_number string, birth_date string, surname string, first_name string"
ROWS = [
    (1, "AG1234567", "1990-04-21", "KARIMOV", "ALI"),
    (2, "A61234567", "1990-04-21", "QARIMOV", "ALI"),
    (3, "66 123-4567", "1990-04-21", "KARIMOV", "ALI"),
    (4, "ag1234567", "21.04.1990", "Karimov", None),
    (5, "AG1234567", "900421", "KARIMOV", "ALI"),
    (6, "AG1234567", "1990-06-21", "KARIM", "ALI"),
    (7, "AG1234567", "1990-04-22", "KARIMOV", "ALI"),
    (8, "AG1234567", "1990-05-25", "KARIMOV", "ALI"),
    (9, "AG1234567", "1991-04-21", "KARIMOV", "ALI"),
    (10, "AG1234567", "1990-04-21", "OTHER", "ALI"),
    (11, None, "1990-04-21", "KARIMOV", "ALI"),
    (12, "AG1234567", None, "KARIMOV", "ALI"),
    (13, "AG1234567", "1990-04-21", "KARIMOV", "ALI"),
    (14, "AGI234S67", "19900421", "KARIMOV", "ALI"),
    (15, "12345", "1990-04-21", "KARIMOV", "ALI"),
    (16, "12345", "1990-04-21", "KARIM", "ALI"),
    (17, "1234S", "1990-04-21", "KARIMOV", "ALI"),
    (18, "AG1234567", "1990", "KARIMOV", "ALI"),
]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_pairs_same_as_all_pairs(spark, hot):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("profile", F.lit("own")).repartition(3)
    found = matching.profiles(df)
    got = sorted(tuple(r) for r in matching.pairs(found, hot).collect())
    assert len(got) == len(set(got))
    l, r = (found.select(*[F.col(c).alias(f"{c}_{s}") for c in found.columns]) for s in "lr")
    same = linkage.documents_match(F.col("number_l"), F.col("number_r")) & linkage.dates_match(F.col("birth_l"), F.col("birth_r"))
    same = same & linkage.names_compatible(F.col("surname_l"), F.col("surname_r")) & linkage.names_compatible(F.col("first_name_l"), F.col("first_name_r"))
    every = l.join(r, F.col("profile_l") < F.col("profile_r")).where(same)
    assert got == sorted(tuple(r) for r in every.select("profile_l", "profile_r", "copies_l", "copies_r", F.col("number_l") != F.col("number_r")).collect())
    assert (1, 2, 3, 1, True) in got and (1, 6, 3, 1, False) in got and not any(11 in p[:2] or 12 in p[:2] for p in got)


def test_a_placeholder_number_is_split_by_date(spark):
    rows = [(i, "AG0000000", f"19{i % 100:02d}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "X", "Y") for i in range(2000)]
    found = matching.profiles(spark.createDataFrame(rows, SCHEMA)).cache()
    assert sorted(map(tuple, matching.pairs(found, 1).collect())) == sorted(map(tuple, matching.pairs(found, 10_000).collect()))


def test_no_records(spark):
    assert matching.pairs(matching.profiles(spark.createDataFrame([], SCHEMA))).count() == 0


def test_compatible_names_begin_alike(spark):
    """Any two compatible names, spelt alike, are equal or one begins with the other."""
    parts = ("", "K", "KH", "X", "XH", "H", "Q", "W", "V", "A")
    names = sorted({a + b + c for a in parts for b in parts for c in ("", "K", "H", "AN")})
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    both = df.select(F.col("n").alias("a")).crossJoin(df.select(F.col("n").alias("b"))).where(linkage.names_compatible(F.col("a"), F.col("b")))
    p, q = matching.spelt_alike(F.col("a")), matching.spelt_alike(F.col("b"))
    assert both.count() > len(names) and both.where(~(p.startswith(q) | q.startswith(p))).count() == 0


@pytest.mark.parametrize("surname", ["", "X"])
def test_a_placeholder_of_one_date_is_split_by_names(spark, surname):
    """Rows of a crowded number, date and surname: those that meet grow with the rows, not with their square."""
    rows = [(i, "12345", "1990-04-21", surname, "".join(chr(65 + int(d)) for d in f"{i:04d}")) for i in range(600)]
    found = matching.profiles(spark.createDataFrame(rows, SCHEMA)).cache()
    l, r = matching.sides(found, 50)
    assert l.join(r, list(matching.KEYS)).count() <= 600 * 50
    assert matching.pairs(found, 50).count() == 0
