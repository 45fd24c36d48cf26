"""Names found by their place on the card, against a plain reading of the lines."""

import re

from pyspark.sql import functions as F

from docsieve.operators import extract

CARD = "SHAXS GUVOHNOMASI\n"


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    return [tuple(r["names"]) for r in extract.names(df).orderBy("k").collect()]


def test_patronymic_below_the_first_name(spark):
    texts = [
        # no label and no whole pattern leads to it: a damaged ending two lines below the first name
        CARD + "Familiyasi\nTESTOV\nIsmi\nDILSHOD\n-- 7 --\nRUSTAMOV\n01.02.1990\n",
        CARD + "Familiyasi\nTESTOV\nIsmi\nDILSHOD\nTug'ilgan sanasi 01.02.1990\nRUSTAMOV\n",
        CARD + "Familiyasi\nTESTOV\nIsmi\nDILSHOD\n-\n--\nRUSTAMOV\n",
        CARD + "Familiyasi\nTESTOV\nIsmi\nDILSHOD\nRUSTAMOVISH\n",
    ]
    assert found(spark, texts) == [("TESTOV", "DILSHOD", "RUSTAMOV"), ("TESTOV", "DILSHOD", None), ("TESTOV", "DILSHOD", None), ("TESTOV", "DILSHOD", "RUSTAMOVICH")]


def test_given_name_between_surname_and_patronymic(spark):
    texts = [
        CARD + "Familiyasi\nTESTOV\n12\nDILSHOD\nRUSTAMOVICH\n",
        CARD + "Familiyasi\nTESTOV\nQWERT\nDILSHOD XYZ\nRUSTAMOVICH\n",
        CARD + "Familiyasi\nTESTOV\nQWERT\nRUSTAMOVICH\n",
        CARD + "Familiyasi\nTESTOV\nRUSTAMOVICH\nDILSHOD\n",
        CARD + "TESTOV\nFamiliyasi\nTESTOV\nOLIMJON QIZI\n",
    ]
    got = found(spark, texts)
    assert [g[1] for g in got] == ["DILSHOD", "DILSHOD", "QWERT", None, None] and all(g[0] == "TESTOV" for g in got)


def test_a_bare_ending_and_one_over_two_lines(spark):
    df = spark.createDataFrame([("QIZI",), ("abc O'G'LI",), ("AB O'G'LI",), ("TEST\nOG'LI",), ("KARIM O G LI",), ("SANASI QIZI",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(extract.whole_patronymic(F.col("text"))).collect()]
    assert got == ["QIZI", "ABC O'G'LI", "O'G'LI", "OG'LI", None, None, None, None]


def test_no_text(spark):
    assert found(spark, [None, "", "\n \n", "12 34"]) == [(None, None, None)] * 4


def test_points_as_a_plain_sum(spark):
    """Surname candidates of several labels, by a dictionary that adds their points up."""
    text = "QATORDA\nBEKTOSHEV\nGiven names\nOLIM\nSurname\nBEKTOSHEV\nQATORDA\nTESTLAR\nSurname\nXOLOVA\n"
    lines = text.strip().split("\n")
    points = {}
    for i, line in enumerate(lines):
        for s in (1, 2, 3):
            places = [(i + s, 0)] if line == "Surname" else [(i - s, 3 - s)] if line == "Given names" else []
            for at, more in places:
                if 0 <= at < len(lines) and lines[at] not in ("Surname", "Given names"):
                    w = lines[at]
                    points[w] = points.get(w, 0) + 2 + 6 * bool(re.search("(OV|EV|OVA|EVA)$", w)) + 2 * (len(w) >= 5) + more
    assert found(spark, [text])[0][0] == max(points, key=points.get)


def test_declared_kinds(spark):
    import pytest

    from docsieve.operators import cards

    df = spark.createDataFrame([("nothing",), ("Familiyasi\nTESTOV\nIsmi\nDILSHOD\n",)], "text string")
    side = lambda kind: [r["detected_side"] for r in cards.read_sides(df, doc_type=kind).orderBy("text").collect()]
    assert side("auto") == ["id_front", "document"] and side("passport") == ["id_front", "passport"] and side("id_card") == ["id_front", "id_front"]
    with pytest.raises(ValueError):
        cards.read_sides(df, doc_type="visa")
