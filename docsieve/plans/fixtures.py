"""Inputs of the queries, derived from the relational tables by projections. The fragments read the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mrz
from ..operators.zone import TD1

DIGITS, NAMES = "0123456789", "ABDEGKLMNR"
_MM = "lpad(concat(c_custkey % 12 + 1, ''), 2, '0')"
_DD = "lpad(concat(c_custkey % 28 + 1, ''), 2, '0')"
_YY = "lpad(concat(c_custkey * 7 % 100, ''), 2, '0')"
#: Columns of the identity fixture before check digits.
IDENTITY = {
    "k": "c_custkey",
    "doc": "concat('A', substr('ABCDEF', c_custkey % 6 + 1, 1), lpad(concat(c_custkey, ''), 7, '0'))",
    "dob": f"concat({_YY}, {_MM}, {_DD})",
    "birth": f"concat(CASE WHEN c_custkey * 7 % 100 >= 30 THEN '19' ELSE '20' END, {_YY}, '-', {_MM}, '-', {_DD})",
    "exp": f"concat(27 + c_custkey % 8, {_MM}, {_DD})",
    "expiry": f"concat('20', 27 + c_custkey % 8, '-', {_MM}, '-', {_DD})",
    "sex": "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END",
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 'Erkak' ELSE 'Ayol' END",
    "p13": f"concat(CASE WHEN c_custkey * 7 % 100 >= 30 THEN 3 ELSE 5 END + c_custkey % 2, {_DD}, {_MM}, {_YY}, lpad(concat(c_custkey % 1000000, ''), 6, '0'))",
    "surname": f"concat(translate(lpad(concat(c_custkey, ''), 5, '0'), '{DIGITS}', '{NAMES}'), 'OV')",
    "first_name": f"concat('DIL', translate(lpad(concat(c_custkey % 1000, ''), 3, '0'), '{DIGITS}', '{NAMES}'), 'JON')",
}
FILL = "<" * 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task works on, at least and at most, and tasks a core between these.
TASK_ROWS, TASKS_A_CORE = (500, 10_000), 3


def tasks_for(rows: int, cores: int) -> int:
    least, most = TASK_ROWS
    return max(1, -(-rows // most), min(-(-rows // least), TASKS_A_CORE * cores))


def tasks_of(df: DataFrame) -> int:
    """By the number of rows, from the files' footers."""
    return tasks_for(df.count(), df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out by its number of rows: a narrow table of millions of rows lies in a few splits, and what is made of each row costs far more than reading it."""
    return df.repartition(tasks_of(df))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic person a customer, with the lines of an identity card (l1 to l3) and of a passport (p1, p2)."""
    df = spread(table(spark, sf_dir, "customer").select("c_custkey")).selectExpr(*[f"{e} AS {n}" for n, e in IDENTITY.items()])
    ck = lambda *parts: mrz.check_digit(F.concat(*parts))
    c = F.col
    df = df.withColumn("pinfl", F.concat("p13", ck("p13")))
    df = df.withColumn("l1", F.concat(F.lit("I<UZB"), "doc", ck("doc"), "pinfl", F.lit("<")))
    head = F.concat("dob", ck("dob"), "sex", "exp", ck("exp"), F.lit("UZB" + FILL))
    df = df.withColumn("l2", head)
    df = df.withColumn("l2", F.concat("l2", ck(F.substring("l1", 6, 25), F.substring("l2", 1, 7), F.substring("l2", 9, 7), F.substring("l2", 19, 11))))
    df = df.withColumn("l3", F.rpad(F.concat("surname", F.lit("<<"), "first_name"), 30, "<"))
    df = df.withColumn("p1", F.rpad(F.concat(F.lit("P<UZB"), "surname", F.lit("<<"), "first_name"), 44, "<"))
    body = F.concat("doc", ck("doc"), F.lit("UZB"), "dob", ck("dob"), "sex", "exp", ck("exp"), "pinfl", ck("pinfl"))
    df = df.withColumn("p2", body)
    return df.withColumn("p2", F.concat("p2", ck(F.substring("p2", 1, 10), F.substring("p2", 14, 7), F.substring("p2", 22, 22)))).withColumn("lines", F.array("l1", "l2", "l3")).withColumn("passport", F.array("p1", "p2")).select("*", c("k").alias("key"))


def duck_check(x: str) -> str:
    """The check digit of an expression, in DuckDB's SQL."""
    return f"(CASE WHEN coalesce({x}, '') = '' THEN '0' ELSE concat(list_sum([instr('{mrz.LETTER_VALUES}', upper(({x})[i])) * [7, 3, 1][(i - 1) % 3 + 1] for i in range(1, length({x}) + 1)]) % 10, '') END)"


def duck_identities() -> str:
    """CTEs that make the same ``idn`` in DuckDB."""
    ck = duck_check
    base = ", ".join(f"{e} AS {n}" for n, e in IDENTITY.items())
    return f"""idn0 AS (SELECT {base} FROM customer),
idn1 AS (SELECT *, concat(p13, {ck("p13")}) AS pinfl FROM idn0),
idn2 AS (SELECT *, concat('I<UZB', doc, {ck("doc")}, pinfl, '<') AS l1, concat(dob, {ck("dob")}, sex, exp, {ck("exp")}, 'UZB{FILL}') AS h2,
 rpad(concat(surname, '<<', first_name), 30, '<') AS l3, rpad(concat('P<UZB', surname, '<<', first_name), 44, '<') AS p1,
 concat(doc, {ck("doc")}, 'UZB', dob, {ck("dob")}, sex, exp, {ck("exp")}, pinfl, {ck("pinfl")}) AS q2 FROM idn1),
idn3 AS (SELECT *, concat(substr(l1, 6, 25), substr(h2, 1, 7), substr(h2, 9, 7), substr(h2, 19, 11)) AS c1, concat(substr(q2, 1, 10), substr(q2, 14, 7), substr(q2, 22, 22)) AS c2 FROM idn2),
idn AS (SELECT *, concat(h2, {ck("c1")}) AS l2, concat(q2, {ck("c2")}) AS p2 FROM idn3)"""


#: One misread digit at place 6, two at 6 and 8, one that nothing explains, by the key's last digit.
SWAP = (DIGITS, "8727285116")
CORRUPT = f"CASE WHEN k % 10 = 0 THEN concat(substr(doc, 1, 5), translate(substr(doc, 6, 1), '{SWAP[0]}', '{SWAP[1]}'), substr(doc, 7)) WHEN k % 10 = 1 THEN concat(substr(doc, 1, 5), translate(substr(doc, 6, 1), '{SWAP[0]}', '{SWAP[1]}'), substr(doc, 7, 1), translate(substr(doc, 8, 1), '{SWAP[0]}', '{SWAP[1]}'), substr(doc, 9)) WHEN k % 10 = 2 THEN concat('XX', substr(doc, 3)) WHEN k % 10 = 3 THEN translate(doc, '015', 'OIS') ELSE doc END"

#: Fields of the two sides of a card: another document, a birth one day off, an upload in reverse, a missing number, another expiry.
FRONT = {
    "document_number": "doc",
    "jshshir": "CAST(NULL AS {s})",
    "surname": "surname",
    "first_name": "first_name",
    "patronymic": "'KARIMOVICH'",
    "birth_date": "CASE WHEN k % 7 = 0 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) ELSE birth END",
    "expiry_date": "CASE WHEN k % 17 = 0 THEN concat('2040', substr(expiry, 5)) ELSE expiry END",
    "issue_date": "concat('2020', substr(expiry, 5))",
    "gender": "gender",
    "nationality": "CAST(NULL AS {s})",
    "birth_place": "CAST(NULL AS {s})",
    "issuing_authority": "CAST(NULL AS {s})",
}
BACK = {
    "document_number": "CASE WHEN k % 11 = 0 THEN concat('AF', lpad(concat(k + 1234567, ''), 7, '0')) ELSE doc END",
    "jshshir": "CASE WHEN k % 13 = 0 THEN NULL ELSE pinfl END",
    "surname": "CASE WHEN k % 19 = 0 THEN 'BOSHQAYEV' ELSE surname END",
    "first_name": "first_name",
    "patronymic": "CAST(NULL AS {s})",
    "birth_date": "birth",
    "expiry_date": "expiry",
    "issue_date": "CAST(NULL AS {s})",
    "gender": "gender",
    "nationality": "CAST(NULL AS {s})",
    "birth_place": "'POP TUMANI'",
    "issuing_authority": "'IIV 12345'",
}


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (key, upload, record fields): front and back of each person's card, every fifth uploaded in reverse."""
    df = identities(spark, sf_dir)
    cut = lambda fields: [F.expr(e.format(s="string")).alias(n) for n, e in fields.items()]
    rest = lambda side, form, face, sure: [F.lit(side).alias("detected_side"), F.lit(form).cast("string").alias("mrz_format"), F.lit(face).alias("face_detected"), F.lit(sure).alias("confidence")]
    turned = F.col("k") % 5 == 0
    front = F.struct(turned.cast("int").alias("upload"), *cut(FRONT), *rest("id_front", None, True, 90.0))
    back = F.struct((~turned).cast("int").alias("upload"), *cut(BACK), *rest("id_back", TD1, False, 98.0))
    return df.select("key", F.explode(F.array(front, back)).alias("s")).select("key", "s.*")


def session_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that meet the two sides of each person's card: a session has two rows, however many sessions there are."""
    return tasks_of(table(spark, sf_dir, "customer"))


#: OCR text of a card's front, labels and values on lines; every ninth has no surname label.
LABEL_TEXT = "concat('O''ZBEKISTON RESPUBLIKASI\nSHAXS GUVOHNOMASI\n', CASE WHEN k % 9 = 0 THEN '' ELSE 'Familiyasi / Surname\n' END, surname, '\nIsmi / Given names\n', first_name, '\nOtasining ismi\nKARIMOVICH\nTug''ilgan sanasi\n', substr(birth, 9, 2), '.', substr(birth, 6, 2), '.', substr(birth, 1, 4), '\nJinsi\n', upper(gender), '\nBerilgan sanasi\n', substr(expiry, 9, 2), '.', substr(expiry, 6, 2), '.2020\nAmal qilish muddati\n', substr(expiry, 9, 2), '.', substr(expiry, 6, 2), '.', substr(expiry, 1, 4), '\nKarta raqami\n', doc, '\nShaxsiy raqami ', pinfl, '\nChust tumani\nBerilgan joyi\n', 10000 + k % 90000, '\n')"


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities(spark, sf_dir).withColumn("text", F.expr(LABEL_TEXT))
