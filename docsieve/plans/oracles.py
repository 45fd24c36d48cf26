"""DuckDB SQL for the queries of ``registry``, written apart from the Column expressions that they check."""

from __future__ import annotations

from ..functions import mrz
from ..operators import extract_words, fusion
from . import fixed
from . import fixtures as fx
from .fixed import DAYS, MONTHS, PAIRS

ck = fx.duck_check


def _nine(x: str) -> str:
    return f"(CASE WHEN length({x}) = 9 THEN concat(translate(upper(substr({x}, 1, 1)), '{fixed.FIRST_DIGITS}', '{fixed.FIRST_LETTERS}'), translate(upper(substr({x}, 2, 1)), '{fixed.SECOND_DIGITS}', '{fixed.SECOND_LETTERS}'), translate(upper(substr({x}, 3)), '{fixed.TAIL_LETTERS}', '{fixed.TAIL_DIGITS}')) ELSE coalesce({x}, '') END)"


def _document(x: str) -> str:
    return _nine(f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))")


def _list(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _documents_match(a: str, b: str) -> str:
    """Over columns a and b that are normalised already."""
    alike = _list([*PAIRS, *[p[::-1] for p in PAIRS]])
    apart = f"[i for i in range(1, 10) if ({a})[i] <> ({b})[i]]"
    bad = f"[i for i in range(1, 10) if ({a})[i] <> ({b})[i] AND concat(({a})[i], ({b})[i]) NOT IN {alike}]"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (length({a}) = 9 AND length({b}) = 9 AND len({apart}) <= 1 AND len({bad}) = 0)))"


def _dates_match(a: str, b: str) -> str:
    x, y = (f"regexp_replace({c}, '[^0-9]', '', 'g')" for c in (a, b))
    part = lambda d, i, n: f"substr({d}, {i}, {n})"
    months, days = _list(MONTHS), _list(DAYS)
    fuzzy = f"(({part(x, 7, 2)} = {part(y, 7, 2)} AND {part(x, 5, 2)} IN {months} AND {part(y, 5, 2)} IN {months}) OR ({part(x, 5, 2)} = {part(y, 5, 2)} AND {part(x, 7, 2)} IN {days} AND {part(y, 7, 2)} IN {days}) OR len([i for i in range(1, 9) if ({x})[i] <> ({y})[i]]) <= 1)"
    return f"coalesce({a} <> '' AND {b} <> '' AND ({x} = {y} OR (length({x}) = 8 AND length({y}) = 6 AND substr({x}, 3) = {y}) OR (length({y}) = 8 AND length({x}) = 6 AND substr({y}, 3) = {x}) OR (length({x}) = 8 AND length({y}) = 8 AND substr({x}, 1, 4) = substr({y}, 1, 4) AND {fuzzy})), false)"


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([fx.duck_identities(), *ctes]) + "\n" + select


def _confusions() -> str:
    rows = [f"('{k}', '{v}', {i})" for k, vs in fixed.CONFUSIONS.items() for i, v in enumerate(vs)]
    return "conf(ch, alt, r) AS (VALUES " + ", ".join(rows) + ")"


def _substitutes() -> str:
    rows = [f"({pr}, {place}, '{d}', '{v}', {i})" for pr, place in enumerate(mrz.PINFL_POSITIONS) for d, vs in mrz.PINFL_SUBSTITUTES.items() for i, v in enumerate(vs)]
    return "subs(pr, place, d, v, vr) AS (VALUES " + ", ".join(rows) + ")"


def _autocorrect(raw: str = fx.CORRUPT, digit: str = ck("doc"), select: str = "") -> str:
    put = "concat(substr({s}, 1, {i} - 1), {a}, substr({s}, {i} + 1))"
    ok = "regexp_full_match(s, '[^0-9]{2}[0-9]{7}')"
    return _with(
        select
        or f"""SELECT b.k, CASE WHEN v0 THEN n WHEN one.s IS NOT NULL THEN one.s WHEN two.s IS NOT NULL THEN two.s ELSE n END AS value,
 CASE WHEN v0 THEN n <> raw ELSE one.s IS NOT NULL OR two.s IS NOT NULL END AS corrected
FROM b LEFT JOIN one USING (k) LEFT JOIN two USING (k)""",
        _confusions(),
        f"b0 AS (SELECT k, {raw} AS raw, {digit} AS d FROM idn)",
        f"b1 AS (SELECT *, {_nine('raw')} AS n FROM b0)",
        f"b AS (SELECT *, {ck('n')} = d AS v0 FROM b1)",
        "pos AS (SELECT k, n, d, i, n[i] AS ch, CASE WHEN regexp_full_match(n[i], '[0-9]') THEN 1 ELSE 0 END AS dig FROM b, range(1, 10) t(i) WHERE NOT v0)",
        f"s1 AS (SELECT k, d, dig, i, r, {put.format(s='n', i='i', a='alt')} AS s FROM pos JOIN conf USING (ch))",
        f"one AS (SELECT k, arg_min(s, dig * 1000000 + i * 1000 + r) AS s FROM s1 WHERE {ok} AND {ck('s')} = d GROUP BY k)",
        f"s2 AS (SELECT p.k, p.d, p.dig + q.dig AS dig, p.i AS i, q.i AS j, c.r AS r, e.r AS r2, {put.format(s='(' + put.format(s='p.n', i='p.i', a='c.alt') + ')', i='q.i', a='e.alt')} AS s FROM pos p JOIN pos q ON p.k = q.k AND p.i < q.i JOIN conf c ON c.ch = p.ch JOIN conf e ON e.ch = q.ch)",
        f"two AS (SELECT k, arg_min(s, dig * 100000000 + i * 1000000 + j * 10000 + r * 100 + r2) AS s FROM s2 WHERE {ok} AND {ck('s')} = d GROUP BY k)",
    )


def _pinfl_autocorrect() -> str:
    return _with(
        "SELECT k, coalesce(fix, bad) AS value, fix IS NOT NULL AS corrected FROM b LEFT JOIN f USING (k)",
        _substitutes(),
        "b AS (SELECT k, CASE WHEN k % 3 = 0 THEN concat(substr(pinfl, 1, 12), translate(substr(pinfl, 13, 1), '0123456789', '6478139250'), substr(pinfl, 14)) ELSE pinfl END AS bad FROM idn)",
        "c AS (SELECT k, pr, vr, concat(substr(bad, 1, place), v, substr(bad, place + 2)) AS s FROM b JOIN subs ON bad[place + 1] = d" + f" WHERE {ck('substr(bad, 1, 13)')} <> bad[14])",
        f"f AS (SELECT k, arg_min(s, pr * 100 + vr) AS fix FROM c WHERE {ck('substr(s, 1, 13)')} = s[14] GROUP BY k)",
    )


_OK_DAY = "regexp_full_match(substr(p, 2, 4), '(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])')"
_CROSS = [
    "x0 AS (SELECT k, coalesce({pin}, '') AS p, {birth} AS b, {gender} AS g FROM {src})",
    f"x1 AS (SELECT *, CASE WHEN p = '' THEN 'not_applicable' WHEN NOT regexp_full_match(p, '[0-9]{{{{14}}}}') THEN 'invalid_format' WHEN p[1] NOT IN ('1','2','3','4','5','6') THEN 'invalid_lead_digit' WHEN NOT {_OK_DAY} THEN 'invalid_date_component' END AS failed, CASE WHEN p[1] IN ('1','3','5') THEN 'erkak' ELSE 'ayol' END AS sx, concat(CASE WHEN p[1] IN ('1','2') THEN '18' WHEN p[1] IN ('3','4') THEN '19' ELSE '20' END, substr(p, 6, 2), '-', substr(p, 4, 2), '-', substr(p, 2, 2)) AS own FROM x0)",
    "x2 AS (SELECT *, CASE WHEN failed IS NULL AND b IS NOT NULL THEN b = own OR (substr(b, 1, 4) = substr(own, 1, 4) AND CASE WHEN substr(b, 9) = substr(own, 9) THEN substr(b, 6, 2) IN ('04','06','01','07') AND substr(own, 6, 2) IN ('04','06','01','07') WHEN substr(b, 6, 2) = substr(own, 6, 2) THEN b[9] = own[9] OR b[10] = own[10] ELSE false END) END AS birth_ok, CASE WHEN failed IS NULL AND g IS NOT NULL THEN lower(g) = sx END AS gender_ok FROM x1)",
    "x AS (SELECT *, CASE WHEN failed = 'not_applicable' THEN true WHEN failed IS NOT NULL THEN false ELSE coalesce(birth_ok, true) AND coalesce(gender_ok, true) END AS valid, CASE WHEN failed IS NOT NULL THEN failed WHEN NOT (coalesce(birth_ok, true) AND coalesce(gender_ok, true)) THEN 'mismatch_detected' WHEN coalesce(birth_ok, false) OR coalesce(gender_ok, false) THEN 'verified' ELSE 'partially_verified' END AS status, concat_ws(',', CASE WHEN failed LIKE 'invalid%' THEN failed END, CASE WHEN NOT birth_ok THEN 'birth_date_mismatch' END, CASE WHEN NOT gender_ok THEN 'gender_mismatch' END) AS alerts FROM x2)",
]


def _cross(src: str, pin: str, birth: str, gender: str) -> list[str]:
    return [c.format(src=src, pin=pin, birth=birth, gender=gender) for c in _CROSS]


def _parsed(passport: bool) -> str:
    birth = f"concat(CASE WHEN substr(dob, 1, 2) <= '12' THEN '20' ELSE '19' END, substr(dob, 1, 2), '-', substr(dob, 3, 2), '-', substr(dob, 5, 2))"
    # a card's birth date goes by the pivot of the year, a passport's by the number's century
    form = "TD3 (Passport 2-line)" if passport else "TD1 (ID Card 3-line)"
    return _with(f"SELECT k, true AS mrz_detected, '{form}' AS format, doc AS document_number, pinfl AS jshshir, surname, first_name, {'birth' if passport else birth} AS birth_date, expiry AS expiry_date, gender, 'O''zbekiston' AS nationality FROM idn")


def _parsed_noisy() -> str:
    """As the clean lines, but for numbers with a C, which is noise in the zone: nine of the digits behind it are taken for the number, and corrected."""
    behind = f"concat(substr(doc, 3), {ck('doc')}, pinfl)"
    fixed = "SELECT idn.k, CASE WHEN k % 6 <> 2 THEN doc WHEN v0 THEN n ELSE coalesce(one.s, two.s, n) END AS document_number FROM idn JOIN b USING (k) LEFT JOIN one USING (k) LEFT JOIN two USING (k)"
    clean = _parsed(False)
    head, last = _autocorrect(f"left({behind}, 9)", f"({behind})[10]", fixed).rsplit("\n", 1)
    return f"{head},\nfixed AS ({last})\n" + clean.rsplit("\n", 1)[1].replace("doc AS document_number", "document_number").replace("FROM idn", "FROM idn JOIN fixed USING (k)")


_CLIENT = "CASE WHEN k % 2 = 0 THEN surname END AS s, first_name AS f, 'KARIM QIZI' AS p, CASE WHEN k % 3 = 0 THEN pinfl END AS j, doc AS d, CASE WHEN k % 5 = 0 THEN birth END AS b"
_PROFILE = f"pr AS (SELECT k, concat_ws(' ', s, f, p) AS full_name, coalesce(s, '') AS surname, f AS first_name, p AS patronymic, coalesce(j, '') AS personal_number, d AS document_number, coalesce(b, concat(CASE WHEN j[1] IN ('3', '4') THEN '19' WHEN j IS NOT NULL THEN '20' END, substr(j, 6, 2), CASE WHEN j IS NOT NULL THEN '-' END, substr(j, 4, 2), CASE WHEN j IS NOT NULL THEN '-' END, substr(j, 2, 2))) AS date_of_birth, CASE WHEN j[1] IN ('1','3','5') THEN 'Erkak' ELSE 'Ayol' END AS gender, 'O''zbekiston' AS nationality FROM (SELECT k, {_CLIENT} FROM idn))"

_FUSED = "fu AS (SELECT k, doc AS document_number, CASE WHEN k % 6 <> 0 THEN pinfl END AS jshshir, surname, first_name, CASE WHEN k % 6 <> 0 THEN birth END AS birth_date, expiry AS expiry_date, 'Erkak' AS gender, 'O''zbekiston' AS nationality FROM idn)"


def _sides() -> list[str]:
    cut = lambda fields, p: ", ".join(f"{e.format(s='VARCHAR')} AS {p}_{n}" for n, e in fields.items())
    return [
        f"m0 AS (SELECT k, {cut(fx.FRONT, 'f')}, {cut(fx.BACK, 'b')} FROM idn)",
        f"m1 AS (SELECT *, {_document('f_document_number')} AS fd, {_document('b_document_number')} AS bd FROM m0)",
        f"m2 AS (SELECT *, CASE WHEN {_documents_match('fd', 'bd')} THEN 'MATCH' ELSE 'MISMATCH' END AS doc, CASE WHEN {_dates_match('f_birth_date', 'b_birth_date')} THEN 'MATCH' ELSE 'MISMATCH' END AS birth0, CASE WHEN {_dates_match('f_expiry_date', 'b_expiry_date')} THEN 'MATCH' ELSE 'MISMATCH' END AS exp, CASE WHEN starts_with(f_surname, b_surname) OR starts_with(b_surname, f_surname) THEN 'MATCH' ELSE 'MISMATCH' END AS name0 FROM m1)",
        *_cross("m2", "b_jshshir", "f_birth_date", "f_gender"),
        "m3 AS (SELECT m2.*, x.valid, x.alerts AS pa, CASE WHEN doc = 'MATCH' THEN 'MATCH' ELSE birth0 END AS birth, CASE WHEN doc = 'MATCH' THEN 'MATCH' ELSE name0 END AS name, doc = 'MISMATCH' AS differs FROM m2 JOIN x USING (k))",
        "m4 AS (SELECT *, concat_ws(',', CASE WHEN differs THEN 'different_cards' END, CASE WHEN doc = 'MISMATCH' THEN 'document_number' END, CASE WHEN birth = 'MISMATCH' THEN 'birth_date' END, CASE WHEN exp = 'MISMATCH' THEN 'expiry_date' END, CASE WHEN name = 'MISMATCH' THEN 'name' END, CASE WHEN b_jshshir IS NOT NULL AND NOT valid THEN array_to_string([concat('pinfl_', a) for a in string_split(pa, ',')], ',') END) AS alerts, round_even(100.0 * ((doc = 'MATCH')::INT + (birth = 'MATCH')::INT + (exp = 'MATCH')::INT + (name = 'MATCH')::INT) / 4, 1) AS raw_score FROM m3)",
        "mg AS (SELECT *, CASE WHEN differs THEN least(raw_score, 25.0) ELSE raw_score END AS score FROM m4)",
        "ms AS (SELECT *, CASE WHEN alerts = '' AND score >= 80 THEN 'VERIFIED_MATCH' WHEN alerts <> '' THEN 'SUSPECTED_FRAUD' ELSE 'WARNING' END AS status FROM mg)",
    ]


_MERGE = "SELECT k AS key, status AS overall_status, CAST(score AS DOUBLE) AS match_score, differs AS different_cards, k % 5 = 0 AS auto_swapped, CASE WHEN differs THEN 35.0::DOUBLE ELSE 94.0::DOUBLE END AS confidence, alerts, fd AS document_number, CASE WHEN differs THEN f_jshshir ELSE b_jshshir END AS personal_number, f_surname AS surname, concat_ws(' ', f_surname, f_first_name, f_patronymic) AS full_name, CASE WHEN differs THEN f_birth_date ELSE b_birth_date END AS date_of_birth, CASE WHEN differs THEN f_expiry_date ELSE b_expiry_date END AS date_of_expiry, CASE WHEN differs THEN f_birth_place ELSE b_birth_place END AS place_of_birth, 'O''zbekiston' AS nationality FROM ms"

_PAGES = "pg AS (SELECT o_custkey AS dossier_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page_number, CASE o_orderkey % 4 WHEN 0 THEN 'id_front' WHEN 1 THEN 'id_back' WHEN 2 THEN 'passport' ELSE 'general_document' END AS page_type FROM orders)"
_FRAMES = "fr AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events), ff AS (SELECT user_id, rn // 3 AS part, rn % 3 AS idx, value FROM fr), mv AS (SELECT a.user_id, a.part, a.idx, a.value / (b.value + 1e-4) AS ratio FROM ff a JOIN ff b ON a.user_id = b.user_id AND a.part = b.part AND b.idx = 0 WHERE a.idx > 0)"
_PERCENT = "CASE WHEN r <= 0.55 THEN r / 0.55 * 35.0 WHEN r <= 0.72 THEN 35.0 + (r - 0.55) / 0.17 * 35.0 ELSE 70.0 + (r - 0.72) / 0.28 * 30.0 END"
_BLEND = "bl0 AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, [(a.vec_id % 6) / 5 * a.embedding[i]::DOUBLE + (1 - (a.vec_id % 6) / 5) * b.embedding[i]::DOUBLE for i in range(1, len(a.embedding) + 1)] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings)), bl AS (SELECT vec_id, round(greatest(0.0, least(1.0, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))))), 6) AS c FROM bl0)"


def _hmac(message: str, secret: str) -> str:
    from ..functions.tokens import _pads

    inner, outer = (f"unhex('{p.hex()}')" for p in _pads(secret))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


def _token(sid: str, chn: str, exp: str, secret: str) -> tuple[str, str]:
    payload = f"""concat('{{"sid":"', {sid}, '","chn":[{chn}],"exp":', {exp}, '}}')"""
    body = f"translate(base64(encode({payload})), '+/=', '-_')"
    return body, secret


def _name_like(t: str) -> str:
    return f"(length({t}) >= 3 AND NOT regexp_matches({t}, '{'|'.join(extract_words.LABEL_STEMS)}') AND {t} NOT IN ({', '.join(repr(x) for x in extract_words.NOT_NAMES)}))"


def sql() -> dict[str, str]:
    from .registry import QUERY_SECRET

    letters, digits = mrz.DATE_LETTERS, mrz.DATE_DIGITS
    md = "regexp_full_match(substr(d, 3), '(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])')"
    ymd = lambda year: f"CASE WHEN {md} THEN concat({year}, '-', substr(d, 3, 2), '-', substr(d, 5, 2)) END"
    yy = "CAST(substr(d, 1, 2) AS INT)"
    body1, _ = _token("concat('s', event_id)", '"BLINK","SMILE"', "event_id * 10", QUERY_SECRET)
    noise, cyr, lat = mrz.NOISE, mrz.CYRILLIC, mrz.LATIN
    clean = f"upper(regexp_replace(translate(x, '{noise}{cyr}', '{'<' * len(noise)}{lat}'), '[^\\p{{L}}\\p{{Nd}}<]', '', 'g'))"
    sharp = "least(40.0, l_quantity * 8 / 250.0 * 40.0)"
    g, br = "(abs(l_discount) * 40)", "(floor(l_extendedprice) % 256)"
    w, h = "(200 + l_partkey % 900)", "(300 + l_suppkey % 900)"
    exposure = f"CASE WHEN {br} < 55 THEN {br} / 55.0 * 12.0 WHEN {br} > 215 THEN (255.0 - {br}) / 40.0 * 12.0 ELSE 20.0 END"
    size = f"CASE WHEN least({w}, {h}) < 300 OR greatest({w}, {h}) < 450 THEN 4.0 WHEN least({w}, {h}) < 600 OR greatest({w}, {h}) < 900 THEN 8.0 ELSE 10.0 END"
    patches, ratio, std = "(floor(l_quantity) % 6)", "(1 + abs(l_tax) * 60)", "(floor(l_extendedprice) % 30)"
    risk = f"(CASE WHEN {patches} > 0 THEN least(50.0, {patches} * 12.0) ELSE 0.0 END + CASE WHEN {ratio} > 3.8 THEN 25.0 ELSE 0.0 END + CASE WHEN {std} > 22 THEN 15.0 ELSE 0.0 END)"
    kyc = "(l_quantity / 50 * 0.35 + l_quantity / 50 * 0.40 + 0.2 * 0.25) * CASE WHEN abs(l_discount) < 0.10 THEN 0.70 ELSE 1.0 END * CASE WHEN abs(l_tax) < 0.10 THEN 0.75 ELSE 1.0 END"
    out = {
        "icao_check_digit": _with(f"SELECT k, doc, {ck('doc')} AS doc_digit, {ck('dob')} AS dob_digit FROM idn"),
        "icao_verify": _with(f"SELECT k, CASE WHEN k % 5 = 0 THEN false WHEN k % 5 = 1 THEN {ck('doc')} = '3' ELSE true END AS valid FROM idn"),
        "doc_normalize": _with(f"SELECT k, {_nine('n')} AS nine, {_document('n2')} AS document FROM z", "z0 AS (SELECT k, concat(translate(substr(doc, 1, 2), 'ABDE', '48DE'), translate(substr(doc, 3, 7), '0158', 'OISB')) AS n FROM idn)", "z AS (SELECT k, n, concat(substr(n, 1, 2), '- ', lower(substr(n, 3, 7))) AS n2 FROM z0)"),
        "doc_match": _with(f"SELECT k, {_documents_match('a', 'b')} AS matches FROM z", f"z AS (SELECT k, {_document('doc')} AS a, {_document(fx.CORRUPT)} AS b FROM idn)"),
        "mrz_autocorrect": _autocorrect(),
        "pinfl_check": _with(f"SELECT k, CASE WHEN k % 10 = 0 THEN -1 ELSE CAST({ck('p13')} AS BIGINT) END AS digit FROM idn"),
        "pinfl_autocorrect": _pinfl_autocorrect(),
        "pinfl_cross_check": _with("SELECT k, status, valid AS is_valid, birth_ok, gender_ok, CASE WHEN failed IS NULL THEN own END AS own_birth, alerts FROM x", *_cross("idn", "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN '123' WHEN k % 13 = 2 THEN concat('9', substr(pinfl, 2)) WHEN k % 13 = 3 THEN concat(substr(pinfl, 1, 1), '45', substr(pinfl, 4)) ELSE pinfl END", "CASE WHEN k % 7 = 0 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) WHEN k % 7 = 1 THEN NULL ELSE birth END", "CASE WHEN k % 11 = 0 THEN 'Erkak' WHEN k % 11 = 1 THEN NULL ELSE gender END")),
        "mrz_dates": f"WITH z AS (SELECT o_orderkey, lpad(concat(o_orderkey * 37 % 1000000, ''), 6, '0') AS d FROM orders) SELECT o_orderkey, {ymd(f'CASE WHEN {yy} <= 12 THEN 2000 ELSE 1900 END + {yy}')} AS birth, {ymd(f'CASE WHEN o_orderkey % 2 = 0 THEN 1900 ELSE 2000 END + {yy}')} AS birth_century, {ymd(f'2000 + {yy} - CASE WHEN {yy} BETWEEN 50 AND 59 THEN 20 ELSE 0 END')} AS expiry FROM z",
        "date_digits": f"SELECT p_partkey, translate(p_name, '{letters}', '{digits}') AS digits FROM part",
        "mrz_clean": _with("SELECT k, array_to_string([y for y in ls if length(y) >= 20 AND (contains(y, '<') OR (length(y) >= 30 AND regexp_matches(y, '[0-9]{6}')))], '\n') AS lines FROM z", f"z AS (SELECT k, [{clean} for x in string_split(concat('x\n ', translate(l1, '<', '«'), ' \nМ', lower(l2), '\n', replace(l3, '<', ' ('), '\n', p2), '\n')] AS ls FROM idn)"),
        "mrz_score": _with("SELECT k, CAST(CASE WHEN k % 17 <> 0 THEN 10 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 10 ELSE 35 END + CASE WHEN k % 5 <> 0 THEN 35 ELSE 0 END + CASE WHEN k % 7 <> 0 THEN 20 ELSE 0 END + CASE WHEN k % 11 <> 0 THEN 15 ELSE 0 END + CASE WHEN k % 13 <> 0 THEN 15 ELSE 0 END AS BIGINT) AS score FROM idn"),
        "mrz_best_candidate": "WITH c AS (SELECT l_orderkey, l_linenumber AS ratio, CAST(l_partkey * 7 % 131 AS INT) AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN score >= 120 THEN 0 ELSE 1 END, CASE WHEN score >= 120 THEN 0 ELSE -score END, ratio, score) AS n FROM c) SELECT l_orderkey, ratio, score FROM r WHERE n = 1",
        "mrz_parse_td1": _parsed(False),
        "mrz_parse_td3": _parsed(True),
        "mrz_parse_noisy": _parsed_noisy(),
        "pinfl_overlap_search": _with("SELECT k, list_max([i for i in range(1, length(s) - 12) if regexp_full_match(substr(s, i, 14), '[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}')]) AS at, substr(s, list_max([i for i in range(1, length(s) - 12) if regexp_full_match(substr(s, i, 14), '[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}')]), 14) AS value FROM z", "z AS (SELECT k, concat(pinfl, substr(pinfl, 2, 9), '<') AS s FROM idn)"),
        "mrz_checksums_td3": _with("SELECT k, true AS has_mrz, true AS document_number_valid, true AS birth_date_valid, true AS expiry_date_valid, true AS composite_valid, true AS all_passed, CAST(0 AS BIGINT) AS corrections FROM idn"),
        "extract_docnum": _with("SELECT k, doc AS document_number FROM idn"),
        "extract_pinfl": _with("SELECT k, pinfl AS jshshir FROM idn"),
        # a token with a label's stem is no name: the next line's token takes its place as surname, and none is left for the given name
        "extract_names": _with("SELECT k, CASE WHEN sn THEN surname WHEN gn THEN first_name END AS surname, CASE WHEN sn AND gn THEN first_name END AS first_name, 'KARIMOVICH' AS patronymic FROM z", f"z AS (SELECT *, {_name_like('surname')} AS sn, {_name_like('first_name')} AS gn FROM idn)"),
        "extract_other": _with("SELECT k, gender, 'O''zbekiston' AS nationality, 'CHUST TUMANI' AS birth_place, concat('IIV ', 10000 + k % 90000) AS issuing_authority FROM idn"),
        "translit_match": _with("SELECT k, k % 3 <> 2 AS same FROM idn"),
        "strong_first_name": _with(f"SELECT k, CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false ELSE regexp_matches(substr(first_name, 1, 4), '({'|'.join(fixed.NAME_SUFFIXES)})$') END AS strong FROM idn"),
        "patronymic_repair": _with("SELECT k, concat(surname, CASE WHEN k % 4 IN (0, 1) THEN 'ICH' ELSE 'NA' END) AS patronymic FROM idn"),
        "fuse_fields": _with("SELECT * FROM fu", _FUSED),
        "derive_gender_birth": _with("SELECT k, CASE WHEN k % 3 = 0 THEN 'Ayol' WHEN k % 3 = 1 THEN 'Erkak' ELSE gender END AS derived_gender, birth AS derived_birth FROM idn"),
        "side_classify": _with("SELECT k, CASE WHEN k % 12 = 0 THEN 'id_both_sides' ELSE CASE k % 6 WHEN 0 THEN 'id_back' WHEN 1 THEN 'passport' WHEN 2 THEN 'passport' WHEN 3 THEN 'id_front' WHEN 4 THEN 'id_front' ELSE 'document' END END AS side FROM idn"),
        "field_confidence": _with("SELECT k, CAST(least(99.0, greatest(((k % 2 <> 0)::INT + (k % 3 <> 0)::INT + (k % 5 <> 0)::INT + (k % 7 <> 0)::INT) * 22.5, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 98.0 WHEN k % 3 = 0 THEN 92.0 WHEN k % 4 <> 0 THEN 88.0 ELSE 0.0 END)) AS DOUBLE) AS confidence FROM idn"),
        "profile_build": _with("SELECT k, concat_ws(' ', surname, first_name, 'KARIMOVICH') AS full_name, document_number, birth_date AS date_of_birth, nationality, true AS is_valid_pair FROM fu", _FUSED),
        "normalize_profile": _with("SELECT k, full_name, surname, personal_number, document_number, date_of_birth, gender, nationality FROM pr", _PROFILE),
        "export_long": _with("""SELECT k, field, value, concat('"', field, '","', replace(value, '"', '""'), '"') AS csv FROM (UNPIVOT (SELECT k, full_name, surname, first_name, patronymic, personal_number, document_number, date_of_birth, gender, nationality FROM pr) ON COLUMNS(* EXCLUDE k) INTO NAME field VALUE value) WHERE value <> ''""", _PROFILE),
        "copy_text": _with("SELECT k, concat_ws('\n', " + ", ".join("CASE WHEN {0} <> '' THEN concat('{1}: ', {0}) END".format(n, fusion.LABELS[n].replace("'", "''")) for n in fusion.LABELS if n not in ("place_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority")) + ") AS labelled, concat_ws(' | ', full_name, CASE WHEN personal_number <> '' THEN concat('JSHSHIR: ', personal_number) END) AS compact FROM pr", _PROFILE),
        "client_validate": _with("SELECT k, coalesce(bo, true) AND coalesce(go, true) AS is_authentic, CASE WHEN NOT (coalesce(bo, true) AND coalesce(go, true)) THEN 'FAIL' WHEN k % 2 = 0 OR k % 9 <> 0 THEN 'PASS' ELSE 'NOT_APPLICABLE' END AS overall_status, bo AS birth_date_matches, go AS gender_matches FROM z", "z AS (SELECT k, CASE WHEN k % 9 = 0 OR k % 4 = 1 THEN NULL ELSE k % 4 <> 0 END AS bo, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 5 = 0 THEN gender = 'Erkak' ELSE true END AS go FROM idn)"),
        "two_sided_merge": _with(_MERGE, *_sides()),
        "merge_status_counts": _with("SELECT status AS overall_status, count(*) AS n FROM ms GROUP BY 1", *_sides()),
        "auto_swap": _with("SELECT k AS key, k % 5 = 0 AS swapped FROM idn"),
        "date_match": _with(f"SELECT k, {_dates_match('birth', 'o')} AS matches FROM z", "z AS (SELECT k, birth, CASE WHEN k % 6 = 0 THEN birth WHEN k % 6 = 1 THEN concat(substr(birth, 9, 2), '.', substr(birth, 6, 2), '.', substr(birth, 1, 4)) WHEN k % 6 = 2 THEN dob WHEN k % 6 = 3 THEN concat(substr(birth, 1, 8), lpad(concat(k % 28 + 2, ''), 2, '0')) WHEN k % 6 = 4 THEN concat(substr(birth, 1, 5), '07', substr(birth, 8)) ELSE expiry END AS o FROM idn)"),
        "name_compatible": _with("SELECT k, k % 4 <> 3 AS compatible FROM idn"),
        "dossier_first_page": f"WITH {_PAGES} SELECT dossier_id, page_type, page_number, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY dossier_id, page_type ORDER BY page_number) AS n FROM pg WHERE page_number <= 10) WHERE n = 1",
        "dossier_merge": f"WITH {_PAGES}, d AS (SELECT dossier_id, min(CASE WHEN page_type = 'id_front' THEN page_number END) AS front_page, min(CASE WHEN page_type = 'id_back' THEN page_number END) AS back_page, min(CASE WHEN page_type = 'passport' THEN page_number END) AS passport_page, count(*) AS pages FROM pg WHERE page_number <= 10 GROUP BY 1) SELECT *, CASE WHEN front_page IS NOT NULL AND back_page IS NOT NULL THEN 'TWO_SIDED_ID_DOSSIER' WHEN passport_page IS NOT NULL THEN 'PASSPORT_DOSSIER' WHEN front_page IS NOT NULL THEN 'ID_FRONT_ONLY' WHEN back_page IS NOT NULL THEN 'ID_BACK_ONLY' ELSE 'GENERAL_DOCUMENT' END AS dossier_type FROM d",
        "dossier_profiles": _with("SELECT k AS dossier_id, 'TWO_SIDED_ID_DOSSIER' AS dossier_type, status AS overall_status, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS front_page, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS back_page FROM ms", *_sides()),
        "page_classify": _with("SELECT k, CASE WHEN k % 7 = 0 THEN 'id_back' WHEN k % 7 = 3 AND k % 2 <> 0 THEN 'id_back' WHEN k % 7 = 1 THEN 'passport' WHEN k % 7 = 2 OR (k % 7 = 4 AND k % 2 = 0) THEN 'id_front' WHEN k % 7 = 5 THEN CASE WHEN k % 2 = 0 THEN 'id_front' ELSE 'id_back' END ELSE 'general_document' END AS page_type FROM idn"),
        "token_sign_verify": f"WITH z AS (SELECT event_id, {body1} AS body FROM events) SELECT event_id, concat(body, '.', {_hmac('body', QUERY_SECRET)}) AS token, CASE WHEN event_id % 3 = 0 THEN 'forged' WHEN event_id < 0 THEN 'expired' ELSE 'ok' END AS reason FROM z",
        "token_ttl": "SELECT event_id, event_id % 97 * 300 <= event_id * 10 AS valid, CASE WHEN event_id % 97 * 300 <= event_id * 10 THEN 'ok' ELSE 'expired' END AS reason, CASE WHEN event_id % 97 * 300 <= event_id * 10 THEN event_id * 10 END AS exp FROM events",
        "quality_score": f"WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 8 AS v, {g} AS g, {br} AS br, {size} AS sz, least(100.0, greatest(0.0, round_even({sharp} + greatest(0.0, 30.0 - {g} * 10.0) + {exposure} + {size}, 1))) AS score FROM lineitem), t AS (SELECT *, score >= 60 AND v >= 50 AS ok, concat_ws(',', CASE WHEN v < 95 THEN 'refocus' END, CASE WHEN g > 1.2 THEN 'avoid_glare' END, CASE WHEN br < 55 THEN 'more_light' END, CASE WHEN br > 215 THEN 'less_light' END, CASE WHEN sz = 4 THEN 'larger_image' END) AS rec FROM s) SELECT l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS score, ok AS is_acceptable, v < 95 AS is_blurry, g > 1.2 AS has_glare, CASE WHEN br < 55 THEN 'TOO_DARK' WHEN br > 215 THEN 'OVEREXPOSED' ELSE 'OPTIMAL' END AS brightness_level, CASE WHEN ok AND rec = '' THEN 'excellent' ELSE rec END AS recommendations FROM t",
        "tamper_risk": f"WITH s AS (SELECT l_orderkey, l_linenumber, CAST({risk} AS DOUBLE) AS r, concat_ws(',', CASE WHEN {patches} > 0 THEN 'anomalous_patches' END, CASE WHEN {ratio} > 3.8 THEN 'uneven_noise' END, CASE WHEN {std} > 22 THEN 'high_error_level' END) AS flags FROM lineitem) SELECT l_orderkey, l_linenumber, r AS risk_score, CASE WHEN r >= 60 THEN 'HIGH' WHEN r >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, r >= 30 AS tampering_detected, flags FROM s",
        "patch_outliers": "WITH p AS (SELECT l_orderkey % 500 AS image, floor(l_quantity) AS m FROM lineitem), l AS (SELECT image, avg(m) + greatest(12.0, 2.2 * stddev_pop(m)) AS lim FROM p GROUP BY 1) SELECT image, CAST(sum(CASE WHEN m > lim THEN 1 ELSE 0 END) AS BIGINT) AS suspicious_patches, sum(CASE WHEN m > lim THEN 1 ELSE 0 END) >= 2 AS anomaly FROM p JOIN l USING (image) GROUP BY 1",
        "face_cosine": f"WITH {_BLEND} SELECT vec_id, c AS cosine FROM bl",
        "face_calibrate": f"WITH z AS (SELECT event_id, event_id % 1001 / 1000.0::DOUBLE AS r FROM events) SELECT event_id, round_even(greatest(0.0, least(100.0, {_PERCENT})), 1) AS percent FROM z",
        "face_verdict": f"WITH {_BLEND}, z AS (SELECT vec_id, c AS r FROM bl), p AS (SELECT round_even(greatest(0.0, least(100.0, {_PERCENT})), 1) AS p FROM z) SELECT CASE WHEN p >= 72 THEN 'VERIFIED_MATCH' WHEN p >= 55 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS verdict, p >= 60 AS match, count(*) AS n FROM p GROUP BY ALL",
        "kyc_match": f"WITH z AS (SELECT l_orderkey, l_linenumber, {kyc} AS r, l_orderkey % 2 = 0 AND l_linenumber / 8 > 0.35 AS cut FROM lineitem), p AS (SELECT *, round_even(greatest(0.0, least(100.0, {_PERCENT})), 1) AS p FROM z) SELECT l_orderkey, l_linenumber, CASE WHEN cut THEN 0.0::DOUBLE ELSE p END AS similarity, CASE WHEN cut THEN 'SELFIE_CUT_OFF' WHEN p >= 72 THEN 'VERIFIED_MATCH' WHEN p >= 55 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS verdict, NOT cut AND p >= 72 AS match FROM p",
        "movement_check": f"WITH {_FRAMES} SELECT CASE WHEN ratio >= 1.15 THEN 'closer' WHEN ratio <= 0.88 THEN 'away' ELSE 'neither' END AS movement, count(*) AS n FROM mv GROUP BY 1",
        "challenge_draw": "WITH c AS (SELECT event_id, c, md5(concat(event_id, '-', c)) AS r FROM events, (SELECT unnest([" + ", ".join(f"'{c}'" for c in fixed.CHALLENGES) + "]) AS c)), m AS (SELECT *, row_number() OVER (PARTITION BY event_id, starts_with(c, 'MOVE') ORDER BY r) AS n FROM c) SELECT event_id, array_to_string(list(c ORDER BY r)[1:3], ',') AS challenges FROM m WHERE NOT starts_with(c, 'MOVE') OR n = 1 GROUP BY event_id",
        "liveness_session": f"WITH {_FRAMES}, s AS (SELECT *, CASE WHEN idx = 1 THEN ratio >= 1.15 ELSE ratio <= 0.88 END AS ok FROM mv), c AS (SELECT *, CASE WHEN NOT ok THEN 0.0 WHEN idx = 1 THEN round_even(least(98.0, 70.0 + (ratio - 1.15) * 60.0), 1) ELSE round_even(least(98.0, 70.0 + (0.88 - ratio) * 80.0), 1) END AS conf FROM s), g AS (SELECT user_id, part, count(*) AS n_steps, bool_and(ok) AS all_passed, round_even((6 * sum(conf::DECIMAL(9,1)) / count(*)::DECIMAL(9,0) + 4 * (100 - user_id % 4 * 20)) , 0) / 10 AS sc, user_id % 5 + 1 < 2 AS few, user_id % 4 * 20.0 >= 50 AS spoof FROM c GROUP BY user_id, part) SELECT user_id, part, n_steps, all_passed, CASE WHEN few OR spoof THEN 0.0::DOUBLE ELSE sc END AS liveness_score, NOT few AND NOT spoof AND all_passed AND sc >= 65 AS is_live, CASE WHEN few THEN 'INSUFFICIENT_FRAMES' WHEN spoof THEN 'SPOOF_ATTACK_DETECTED' WHEN all_passed AND sc >= 65 THEN 'LIVE_AUTHENTIC' ELSE 'CHALLENGE_FAILED' END AS verdict FROM g",
        "spoof_score": "WITH z AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 > 4.2 AS a, l_linenumber % 4 >= 2 AS b, abs(l_discount) * 100 < 5 AND abs(l_tax) * 100 < 5 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(45 * a::INT + 25 * b::INT + 30 * c::INT AS DOUBLE) AS score, 45 * a::INT + 25 * b::INT + 30 * c::INT >= 50 AS is_spoof, concat_ws(',', CASE WHEN a THEN 'moire' END, CASE WHEN b THEN 'specular' END, CASE WHEN c THEN 'flat_chrominance' END) AS flags FROM z",
        "stability_counter": "WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'error' AS p, value >= 20 AS s FROM events), r AS (SELECT user_id, n, CASE WHEN p AND s THEN 1 ELSE 0 END AS c, CASE WHEN p AND s THEN 1 ELSE 0 END >= 3 AS f FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, CASE WHEN o.p AND o.s THEN r.c + 1 WHEN o.p THEN greatest(0, r.c - 1) ELSE 0 END, r.f OR CASE WHEN o.p AND o.s THEN r.c + 1 ELSE 0 END >= 3 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, CAST(arg_max(c, n) AS BIGINT) AS counter, bool_or(f) AS fired FROM r GROUP BY user_id",
        "throttle_window": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) > 4 AS throttled FROM events GROUP BY ALL",
        "media_sniff": "WITH z AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'image/tiff' WHEN 6 THEN 'image/tiff' ELSE 'unknown' END AS kind, 50 + c_custkey % 300 AS s FROM customer) SELECT c_custkey, kind, CASE WHEN c_custkey = 0 THEN 'missing' WHEN c_custkey * 20000 > 10485760 THEN 'too_large' WHEN kind = 'unknown' THEN 'bad_format' WHEN s * s * 200 > 25000000 THEN 'too_many_pixels' WHEN s < 100 THEN 'too_small' END AS rejection FROM z",
        "face_rank": "WITH z AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey % 300 AS INT) AS y, CAST(floor(l_quantity + 20) AS INT) AS w, CAST(floor(l_quantity * 1.2 + 20) AS INT) AS h FROM lineitem), s AS (SELECT *, w * h * (1.0 - least(abs(h / w - 1.25), 1.0)) * CASE WHEN x + w / 2.0 < 640 * 0.55 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS sc FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sc DESC, l_linenumber, x, y, w, h) AS n FROM s) SELECT l_orderkey, x, y, w, h, x <= 4 OR y <= 4 OR x + w >= 636 OR y + h >= 476 AS is_cut_off FROM r WHERE n = 1",
        "page_confidence": "SELECT l_orderkey, round_even(avg(floor(l_quantity)), 1) AS confidence FROM lineitem GROUP BY 1",
        "response_status": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 0 THEN 400 WHEN c_custkey % 7 = 0 THEN 500 WHEN c_custkey % 2 = 0 THEN 200 ELSE 422 END AS BIGINT) AS status_code FROM customer",
    }
    out["extract_dates"] = _with("SELECT k, CASE WHEN n >= 3 THEN ds[1] WHEN y[1] < 2012 THEN ds[1] END AS birth_date, CASE WHEN n >= 3 THEN ds[2] WHEN n = 2 THEN CASE WHEN y[1] >= 2012 THEN ds[1] WHEN y[2] <= 2026 THEN ds[2] END END AS issue_date, CASE WHEN n >= 3 THEN ds[3] WHEN n = 2 AND (y[1] >= 2012 OR y[2] > 2026) THEN ds[2] END AS expiry_date FROM z", "z0 AS (SELECT k, unnest([birth, concat('2020', substr(expiry, 5)), expiry]) AS d FROM idn)", "z1 AS (SELECT k, substr(d, 1, 4) AS yr, min(d) AS d FROM (SELECT k, d, count(*) AS c, max(count(*)) OVER (PARTITION BY k, substr(d, 1, 4)) AS mx FROM z0 GROUP BY k, d) WHERE c = mx AND substr(d, 1, 4) BETWEEN '1920' AND '2045' GROUP BY k, substr(d, 1, 4))", "z AS (SELECT k, list(d ORDER BY d) AS ds, list(CAST(yr AS INT) ORDER BY d) AS y, count(*) AS n FROM z1 GROUP BY k)")
    return out
