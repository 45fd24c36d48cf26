"""Scalars against plain Python on made-up inputs, nulls and blanks among them."""

import random

import pytest
from pyspark.sql import functions as F

from docsieve.functions import linkage, mrz, scores, text, tokens
from docsieve.operators import zone


def rows(spark, values, *made, names=("a", "b", "c")):
    values = [v if isinstance(v, tuple) else (v,) for v in values]
    schema = ", ".join(f"{n} string" for n in names[: len(values[0])])
    out = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + schema).select("i", *[m.alias(f"r{k}") for k, m in enumerate(made)])
    return [tuple(r)[1:] if len(made) > 1 else r[1] for r in sorted(out.collect())]


def digit(s):
    value = lambda c: int(c) if c.isdigit() else ord(c.upper()) - 55 if c.upper().isascii() and c.isalpha() else 0
    return str(sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(s or "")) % 10)


def test_check_digit(spark):
    r = random.Random(2)
    xs = ["670119", "", None, "<", "a1"] + ["".join(r.choice("ABZ059<x") for _ in range(r.randint(1, 44))) for _ in range(60)]
    assert rows(spark, xs, mrz.check_digit(F.col("a"))) == [digit(x) for x in xs]
    assert rows(spark, [("670119", "2"), ("670119", "3"), ("670119", None), ("670119", "22")], mrz.verify(F.col("a"), F.col("b"))) == [True, False, False, False]


def test_corrected_fields_verify(spark):
    """Whenever the flag is set, the result meets the check digit."""
    r = random.Random(4)
    xs = []
    for _ in range(40):
        s = "A" + r.choice("ABCDEF") + "".join(r.choice("0123456789") for _ in range(7))
        d = digit(s)
        i = r.randrange(9)
        xs.append((s[:i] + r.choice("O0I1S5B8G6Z2TX") + s[i + 1 :], d))
    xs += [(s[0][2:8], s[1]) for s in xs[:15]] + [("", "1"), (None, "1"), ("123456", None), ("123456", "x")]
    got = rows(spark, xs, mrz.auto_correct(F.col("a"), F.col("b")))
    for (s, d), g in zip(xs, got):
        if g["corrected"]:
            assert digit(g["value"]) == d and g["value"] != s
        elif len(s or "") != 9:
            assert g["value"] == s


def test_letter_read_as_digit_is_corrected(spark):
    # O for 0 in a date, and digits for the letters of a document number
    good = "AE0364469"
    got = rows(spark, [("67O119", digit("670119")), ("4EO364469", digit(good)), (good, digit(good))], mrz.auto_correct(F.col("a"), F.col("b")))
    assert [(g["value"], g["corrected"]) for g in got] == [("670119", True), (good, True), (good, False)]


def pinfl(lead, ddmmyy, serial="123456"):
    s = f"{lead}{ddmmyy}{serial}"
    return s + digit(s)


def test_pinfl_cross_check(spark):
    p = pinfl(3, "150690")
    xs = [(p, "1990-06-15", "Erkak"), (p, "1991-06-15", "Erkak"), (p, "1990-06-15", "Ayol"), (None, "1990-06-15", "Erkak"), ("12", None, None), (pinfl(9, "150690"), None, None), (pinfl(3, "459990"), None, None), (p, None, None), (p, "1990-06-16", None)]
    got = rows(spark, xs, zone.cross_check(F.col("a"), F.col("b"), F.col("c")))
    assert [g["status"] for g in got] == ["verified", "mismatch_detected", "mismatch_detected", "not_applicable", "invalid_format", "invalid_lead_digit", "invalid_date_component", "partially_verified", "verified"]
    assert got[0]["pinfl_parsed"]["century"] == "1900s" and got[3]["is_valid"] and got[1]["alerts"] == ["birth_date_mismatch"]


def test_documents_match_is_symmetric(spark):
    r = random.Random(6)
    xs = [("".join(r.choice("AE048OBSIZ1") for _ in range(9)), "".join(r.choice("AE048OBSIZ1") for _ in range(9))) for _ in range(40)] + [("AE1364469", "AE1364469"), (None, "AE1"), ("", "")]
    xs += [(a, a[:4] + "4" + a[5:]) for a, _ in xs[:20]]
    assert all(a == b for a, b in rows(spark, xs, linkage.documents_match(F.col("a"), F.col("b")), linkage.documents_match(F.col("b"), F.col("a"))))


def test_dates_and_names(spark):
    xs = [("1990-06-15", "15.06.1990"), ("1990-06-15", "900615"), ("1990-06-15", "1990-04-15"), ("1990-06-15", "1991-06-15"), (None, "1990-06-15"), ("1990-06-24", "1990-06-12")]
    assert rows(spark, xs, linkage.dates_match(F.col("a"), F.col("b"))) == [False, True, True, False, False, True]
    ns = [("ALIYEV", "ALIYEVA"), ("SAIDXONOV", "SAIDKHONOV"), (None, "X"), ("ALI", "VALI")]
    assert rows(spark, ns, linkage.names_compatible(F.col("a"), F.col("b"))) == [True, True, True, False]


def test_text_fields(spark):
    xs = ["no AA1234567 here", "UZ1234567 then 123456789", "AEISSIZ18", "karta raqami: AB 12345S7", None, "nothing"]
    assert rows(spark, xs, text.document_number(F.col("a"))) == ["AA1234567", "123456789", "AE1551318", "AB1234557", None, None]
    ps = ["x 3 1506 90 123456 7 y", "shaxsiy raqam 31506901234567", "39906901234567", None]
    assert rows(spark, ps, text.personal_number(F.col("a"))) == ["31506901234567", "31506901234567", None, None]


def test_tokens(spark):
    base = spark.createDataFrame([(1,)], "x int")
    token = base.select(tokens.sign(F.lit("s1"), F.array(F.lit("BLINK")), F.lit(100), "k").alias("t")).first()["t"]
    import hashlib
    import hmac

    body, sig = token.split(".")
    assert hmac.new(hashlib.sha256(b"k").digest(), body.encode(), hashlib.sha256).hexdigest() == sig and "=" not in body
    check = lambda t, now, key="k": base.select(tokens.verify(F.lit(t), F.lit(now), key).alias("r")).first()["r"]["reason"]
    assert [check(token, 99), check(token, 101), check("A" + token[1:], 0), check("abc", 0), check(token, 0, "other")] == ["ok", "expired", "forged", "malformed", "forged"]
    with pytest.raises(ValueError):
        tokens.sign(F.lit("s"), F.array(), F.lit(1), "")
    drawn = spark.range(300).select(tokens.choose(F.col("id"), 4).alias("c")).collect()
    assert all(len(set(r["c"])) == 4 and not {"MOVE_CLOSER", "MOVE_AWAY"} <= set(r["c"]) for r in drawn) and len({tuple(r["c"]) for r in drawn}) > 50


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
