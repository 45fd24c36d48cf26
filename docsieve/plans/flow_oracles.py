"""DuckDB SQL for the queries of ``flows``. Tables of letters are written out here and not taken from the code that they check."""

from __future__ import annotations

from . import fixtures as fx
from . import flows

_ALIKE = "('A4', '4A', 'O0', '0O', 'D0', '0D', 'I1', '1I', 'L1', '1L', 'Z2', '2Z', 'S5', '5S', 'B8', '8B', 'G6', '6G')"
_NOT_DIGITS = "'[^0-9]', '', 'g'"


def _number(x: str) -> str:
    bare = f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]', '', 'g'))"
    return f"(CASE WHEN length({bare}) = 9 THEN concat(translate({bare}[1], '4018257', 'AOIBZST'), translate({bare}[2], '40182573', 'AOIBZSTE'), translate(substr({bare}, 3), 'ODQILTZBSGA', '00011128564')) ELSE {bare} END)"


def _name(x: str) -> str:
    return f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z]', '', 'g'))"


def _dates(x: str, y: str) -> str:
    """Whether two strings of digits are the same date; every digit is compared on its own."""
    months, days = "('01', '04', '06', '07')", "('24', '22', '21', '27', '04', '02', '14', '12')"
    m, d = (lambda z: f"substr({z}, 5, 2)"), (lambda z: f"substr({z}, 7, 2)")
    fuzzy = f"(({d(x)} = {d(y)} AND {m(x)} IN {months} AND {m(y)} IN {months}) OR ({m(x)} = {m(y)} AND {d(x)} IN {days} AND {d(y)} IN {days}) OR hamming({x}, {y}) <= 1)"
    return f"({x} = {y} OR (length({x}) = 8 AND length({y}) = 6 AND substr({x}, 3) = {y}) OR (length({x}) = 6 AND length({y}) = 8 AND substr({y}, 3) = {x}) OR CASE WHEN length({x}) = 8 AND length({y}) = 8 THEN left({x}, 4) = left({y}, 4) AND {fuzzy} ELSE false END)"


def _names(a: str, b: str) -> str:
    """Letters alone: a missing one, a beginning, or one spelling for the other."""
    x = lambda s: f"translate(replace({s}, 'KH', 'X'), 'W', 'V')"
    q = lambda s: f"translate(translate(replace({s}, 'KH', 'X'), 'K', 'Q'), 'W', 'V')"
    same = [f"{q(a)} = {q(b)}", f"{q(a)} = {b}", f"{x(b)} = translate({a}, 'W', 'V')", f"translate(replace({a}, 'X', 'KH'), 'W', 'V') = translate({b}, 'W', 'V')", f"translate({b}, 'K', 'Q') = {a}", f"translate({a}, 'Q', 'K') = {b}"]
    return f"({a} = '' OR {b} = '' OR starts_with({a}, {b}) OR starts_with({b}, {a}) OR {' OR '.join(same)})"


def _fuzzy() -> str:
    """All pairs of profiles, compared place by place."""
    one, two = (", ".join(f"{e} AS {n}" for n, e in fields.items()) for fields in flows.RECORDS.values())
    l, r = "l.number", "r.number"
    place = "list_filter(range(1, 10), lambda i: l.number[i] <> r.number[i])[1]"
    return f"""WITH {fx.duck_identities()},
w AS (SELECT {one} FROM idn UNION ALL SELECT {two} FROM idn UNION ALL SELECT id + 10000000, * EXCLUDE (id) FROM (SELECT {one} FROM idn WHERE k % 4 = 0)),
b AS (SELECT id, {_number("document_number")} AS number, regexp_replace(coalesce(birth_date, ''), {_NOT_DIGITS}) AS birth, {_name("surname")} AS surname, {_name("first_name")} AS first_name FROM w),
p AS MATERIALIZED (SELECT number, birth, surname, first_name, min(id) AS profile, count(*) AS copies FROM b WHERE number <> '' AND birth <> '' GROUP BY ALL),
n AS MATERIALIZED (SELECT DISTINCT number FROM p),
m AS MATERIALIZED (SELECT {l} AS x, {r} AS y FROM n l, n r WHERE {l} = {r} OR CASE WHEN length({l}) = 9 AND length({r}) = 9 THEN hamming({l}, {r}) = 1 AND concat({l}[{place}], {r}[{place}]) IN {_ALIKE} ELSE false END)
SELECT l.profile AS a, r.profile AS b, l.copies AS copies_a, r.copies AS copies_b, {l} <> {r} AS look_alike FROM p l JOIN m ON {l} = m.x JOIN p r ON {r} = m.y AND l.profile < r.profile
WHERE {_dates("l.birth", "r.birth")} AND {_names("l.surname", "r.surname")} AND {_names("l.first_name", "r.first_name")}"""


_EVENTS = "e AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events)"


def _leaky(requests: int, millis: int, burst: int) -> str:
    fits = f"next <= {burst * millis}"
    return f"""WITH RECURSIVE {_EVENTS},
r(user_id, event_id, rn, admitted, level, last) AS (SELECT user_id, event_id, rn, true, 0::HUGEINT, t FROM e WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, {fits}, CASE WHEN {fits} THEN next ELSE level END, CASE WHEN {fits} THEN t ELSE last END
  FROM (SELECT e.*, r.level, r.last, greatest(0, r.level - {requests} * (e.t - r.last) + {millis})::HUGEINT AS next FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, admitted FROM r"""


def _log(limit: int, millis: int) -> str:
    return f"""WITH RECURSIVE {_EVENTS},
r(user_id, event_id, rn, admitted, log) AS (SELECT user_id, event_id, rn, true, [t] FROM e WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, len(log) < {limit}, CASE WHEN len(log) < {limit} THEN list_append(log, t) ELSE log END
  FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.t - {millis}) AS log FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, admitted FROM r"""


def _sessions() -> str:
    """Frames ranked among those that decode, challenges drawn and laid beside them, the branches in their order."""
    f = flows.FRAMES
    measured = ", ".join(f"{e} AS {n}" for n, e in f.items())
    kinds = "'LOOK_LEFT', 'LOOK_RIGHT', 'MOVE_CLOSER', 'MOVE_AWAY', 'BLINK', 'SMILE'"
    both = "coalesce(b.found AND a.found, false)"
    ratio = "a.area / (b.area + 1e-4)"
    passed = f"coalesce(CASE c WHEN 'MOVE_CLOSER' THEN {both} AND {ratio} >= 1.15 WHEN 'MOVE_AWAY' THEN {both} AND {ratio} <= 0.88 WHEN 'BLINK' THEN a.found WHEN 'SMILE' THEN a.found AND a.smiles > 0 ELSE a.profile OR ({both} AND abs((a.center - b.center) / a.width) > 0.04) END, false)"
    sure = f"CASE c WHEN 'MOVE_CLOSER' THEN least(98.0, 70.0 + ({ratio} - 1.15) * 60.0) WHEN 'MOVE_AWAY' THEN least(98.0, 70.0 + (0.88 - {ratio}) * 80.0) WHEN 'BLINK' THEN CASE WHEN a.eyes = 0 THEN 85.0 ELSE 70.0 END WHEN 'SMILE' THEN 88.0 ELSE CASE WHEN a.profile THEN 88.0 ELSE 75.0 END END"
    return f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
fr AS (SELECT user_id, rn // 4 AS part, concat(user_id, '-', rn // 4) AS session, rn % 4 AS idx, {measured} FROM e),
ct AS (SELECT session, user_id * 1000 + part AS seed, part, count(*) AS n, count(*) FILTER (WHERE decoded) AS good FROM fr GROUP BY ALL),
ok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx) - 1 AS r FROM fr WHERE decoded),
cd AS (SELECT session, part, c, md5(concat(seed, '-', c)) AS h FROM ct, (SELECT unnest([{kinds}]) AS c)),
cm AS (SELECT *, row_number() OVER (PARTITION BY session, starts_with(c, 'MOVE') ORDER BY h) AS m FROM cd),
ch AS (SELECT session, c, row_number() OVER (PARTITION BY session ORDER BY h) AS i, part FROM cm WHERE NOT starts_with(c, 'MOVE') OR m = 1),
st AS (SELECT session, i, c, passed, round_even(CASE WHEN passed THEN sure ELSE 0.0 END::DOUBLE, 1) AS sure FROM (SELECT ch.session, i, c, {passed} AS passed, {sure} AS sure FROM ch JOIN ok a ON a.session = ch.session AND a.r = ch.i JOIN ok b ON b.session = ch.session AND b.r = 0 WHERE i <= 1 + ch.part % 3)),
ag AS (SELECT session, bool_and(passed) AS all_passed, sum(round(sure * 10))::HUGEINT AS tenths, count(*) AS k, string_agg(concat(c, ' ', passed, ' ', printf('%.1f', sure)), ',' ORDER BY i) AS told FROM st GROUP BY session),
v AS (SELECT ct.*, 2 + ct.part % 3 AS need, CASE WHEN seed % 19 = 0 THEN 'malformed' WHEN seed % 13 = 0 THEN 'forged' WHEN seed % 17 = 0 THEN 'expired' ELSE 'ok' END AS reason, ok.spoof_score AS spoof, all_passed, tenths, k, told FROM ct LEFT JOIN ok ON ok.session = ct.session AND ok.r = 0 LEFT JOIN ag ON ag.session = ct.session),
x AS (SELECT *, 6 * tenths + k * 4 * (1000 - (spoof * 10)::HUGEINT) AS over, 10 * k AS under FROM v),
y AS (SELECT *, ((over // under) + CASE WHEN 2 * (over % under) > under OR (2 * (over % under) = under AND (over // under) % 2 = 1) THEN 1 ELSE 0 END) / 10 AS score FROM x),
z AS (SELECT *, CASE WHEN reason <> 'ok' THEN 'INVALID_TOKEN' WHEN n < need THEN 'INSUFFICIENT_FRAMES' WHEN good < need THEN 'DECODE_ERROR' WHEN spoof >= 50 THEN 'SPOOF_ATTACK_DETECTED' WHEN all_passed AND score >= 65 THEN 'LIVE_AUTHENTIC' ELSE 'CHALLENGE_FAILED' END AS verdict FROM y)
SELECT session, verdict NOT IN ('INVALID_TOKEN', 'INSUFFICIENT_FRAMES', 'DECODE_ERROR') AS success, verdict, verdict = 'LIVE_AUTHENTIC' AS is_live, CASE WHEN verdict IN ('INVALID_TOKEN', 'INSUFFICIENT_FRAMES', 'DECODE_ERROR') THEN 0.0 WHEN verdict = 'SPOOF_ATTACK_DETECTED' THEN 100.0 - spoof ELSE score END::DOUBLE AS liveness_score, reason, CASE WHEN verdict IN ('LIVE_AUTHENTIC', 'CHALLENGE_FAILED') THEN told ELSE '' END AS challenges FROM z"""


def _zone_search() -> str:
    """What each part reads is known by its number, and with it what the record is worth."""
    points = "CASE WHEN kind IN (1, 2, 5) THEN 10 + 35 + 35 + 20 + 15 + 15 WHEN kind = 3 THEN 10 + 35 + 35 + 20 + 15 ELSE -1 END"
    return f"""WITH {fx.duck_identities()},
c AS (SELECT k, part, doc, pinfl, surname, (k + 2 * part) % 6 AS kind FROM idn, range({flows.PARTS}) t(part) WHERE k % 7 <> 0 OR (k + 2 * part) % 6 IN (0, 3, 4)),
s AS (SELECT *, {points} AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN score >= 120 THEN 0 ELSE 1 END, CASE WHEN score < 120 THEN -score END, part) AS n FROM s)
SELECT k, part, score, CASE WHEN score >= 0 THEN doc END AS document_number, CASE WHEN score >= 0 THEN pinfl END AS jshshir, CASE WHEN score >= 120 THEN surname END AS surname FROM r WHERE n = 1"""


def _cards() -> str:
    """Dates of the front by their order, the back's birth by the pivot of the year; then checks, score, alerts and profile of each pair."""
    from . import oracles

    sides = ", ".join(f"{e} AS {n}" for n, e in flows.SIDES.items())
    pivot = "concat(CASE WHEN substr(dob, 1, 2) <= '12' THEN '20' ELSE '19' END, substr(dob, 1, 2), '-', substr(dob, 3, 2), '-', substr(dob, 5, 2))"
    digits = lambda x: f"regexp_replace({x}, {_NOT_DIGITS})"
    state = lambda there, same: f"CASE WHEN NOT ({there}) THEN 'SKIPPED' WHEN {same} THEN 'MATCH' ELSE 'MISMATCH' END"
    n = lambda what: " + ".join(f"({c} {what})::INT" for c in ("doc_state", "birth", "exp_state", "name"))
    return "WITH " + ",\n".join(
        [
            fx.duck_identities(),
            f"t AS (SELECT *, {sides} FROM idn)",
            "d0 AS (SELECT k, unnest([fbirth, concat('2020', substr(expiry, 5)), fexpiry]) AS d FROM t)",
            "d1 AS (SELECT k, substr(d, 1, 4) AS yr, min(d) AS d FROM (SELECT k, d, count(*) AS c, max(count(*)) OVER (PARTITION BY k, substr(d, 1, 4)) AS mx FROM d0 GROUP BY k, d) WHERE c = mx GROUP BY k, substr(d, 1, 4))",
            "d2 AS (SELECT k, list(d ORDER BY d) AS ds, list(yr::INT ORDER BY d) AS y, count(*) AS n FROM d1 GROUP BY k)",
            "d AS (SELECT k, CASE WHEN n >= 3 OR y[1] < 2012 THEN ds[1] END AS fb, CASE WHEN n >= 3 THEN ds[n] WHEN n = 2 AND (y[1] >= 2012 OR y[2] > 2026) THEN ds[2] END AS fe FROM d2)",
            f"w AS (SELECT *, {oracles._name_like('surname')} AS sn, {oracles._name_like('first_name')} AS gn FROM t)",
            # a word with a label's stem is no name: the next line's takes its place
            "nm AS (SELECT k, CASE WHEN sn THEN surname WHEN gn THEN first_name END AS fs, CASE WHEN sn AND gn THEN first_name END AS ff FROM w)",
            f"m0 AS (SELECT t.* EXCLUDE (birth), fs, ff, coalesce(fs, '') AS n1, coalesce(ff, '') AS n2, t.birth AS own_birth, fb, fe, {pivot} AS kb, {_number('fdoc')} AS fd, {_number('doc')} AS kd FROM t JOIN d USING (k) JOIN nm USING (k))",
            f"m1 AS (SELECT *, {digits('fb')} AS x, {digits('kb')} AS y, {digits('fe')} AS ex, {digits('expiry')} AS ey, coalesce(fb, kb) AS known FROM m0)",
            f"m2 AS (SELECT *, CASE WHEN fd = kd THEN 'MATCH' ELSE 'MISMATCH' END AS doc_state, {state('fb IS NOT NULL', _dates('x', 'y'))} AS birth0, {state('fe IS NOT NULL', _dates('ex', 'ey'))} AS exp_state FROM m1)",
            *oracles._cross("m2", "pinfl", "known", "gender"),
            f"m3 AS (SELECT m2.*, x.valid, x.alerts AS pa, CASE WHEN doc_state = 'MATCH' AND birth0 = 'MISMATCH' THEN 'MATCH' ELSE birth0 END AS birth, CASE WHEN doc_state = 'MATCH' OR ({_names('n1', 'surname')} AND {_names('n2', 'first_name')}) THEN 'MATCH' ELSE 'MISMATCH' END AS name, doc_state = 'MISMATCH' AS differs FROM m2 JOIN x USING (k))",
            f"m4 AS (SELECT *, concat_ws(',', CASE WHEN differs THEN 'different_cards' END, CASE WHEN doc_state = 'MISMATCH' THEN 'document_number' END, CASE WHEN birth = 'MISMATCH' THEN 'birth_date' END, CASE WHEN exp_state = 'MISMATCH' THEN 'expiry_date' END, CASE WHEN name = 'MISMATCH' THEN 'name' END, CASE WHEN NOT valid THEN array_to_string([concat('pinfl_', a) for a in string_split(pa, ',')], ',') END) AS alerts, round_even(100.0 * ({n('= ' + repr('MATCH'))}) / ({n('<> ' + repr('SKIPPED'))}), 1) AS raw FROM m3)",
            "m5 AS (SELECT *, CASE WHEN differs THEN least(raw, 25.0) ELSE raw END AS score FROM m4)",
        ]
    ) + """
SELECT k AS key, CASE WHEN alerts = '' AND score >= 80 THEN 'VERIFIED_MATCH' WHEN alerts <> '' THEN 'SUSPECTED_FRAUD' ELSE 'WARNING' END AS overall_status, score::DOUBLE AS match_score, differs AS different_cards, k % 5 = 0 AS auto_swapped,
CASE WHEN differs THEN 35.0 ELSE round_even((round_even((1 + (fs IS NOT NULL)::INT + (ff IS NOT NULL)::INT + (fb IS NOT NULL)::INT) * 22.5, 1) + 92.0)::DOUBLE / 2, 1) END::DOUBLE AS confidence, alerts, fd AS document_number, CASE WHEN NOT differs THEN pinfl END AS personal_number, CASE WHEN differs THEN fs ELSE coalesce(fs, surname) END AS surname, concat_ws(' ', CASE WHEN differs THEN fs ELSE coalesce(fs, surname) END, CASE WHEN differs THEN ff ELSE coalesce(ff, first_name) END, 'KARIMOVICH') AS full_name,
CASE WHEN differs THEN fb ELSE own_birth END AS date_of_birth, CASE WHEN differs THEN fe ELSE expiry END AS date_of_expiry, CASE WHEN NOT differs THEN 'POP TUMANI' END AS place_of_birth, 'O''zbekiston' AS nationality FROM m5"""


def _pixels(table: str, key: str) -> str:
    """px: a row for each pixel, with its gray level and its brightest and darkest colour."""
    colours = ", ".join(f"({e})::INT AS {c}" for c, e in flows.PIXEL.items())
    axis = f"range({flows.SIDE})"
    return f"px AS MATERIALIZED (SELECT *, round_even(b * 0.114e0 + g * 0.587e0 + r * 0.299e0, 0) AS gray, greatest(b, g, r) AS v, least(b, g, r) AS w FROM (SELECT k, x, y, {colours} FROM (SELECT {key} AS k FROM {table}) t, {axis} h(x), {axis} i(y)))"


def _var(x: str) -> str:
    """Population variance of whole numbers, exact in a double where their count is a power of two."""
    return f"((sum({x} * {x}) - sum({x}) * sum({x}) / count(*)::DOUBLE) / count(*))"


def _raster_quality() -> str:
    near = lambda f, g, by, along: f"coalesce({f}(gray) OVER (PARTITION BY k, {by} ORDER BY {along}), {g}(gray) OVER (PARTITION BY k, {by} ORDER BY {along}))"
    around = " + ".join(near(f, g, by, along) for by, along in (("y", "x"), ("x", "y")) for f, g in (("lag", "lead"), ("lead", "lag")))
    n = flows.SIDE**2
    return f"""WITH {_pixels("part", "p_partkey")},
n AS (SELECT *, {around} - 4 * gray AS edge, v > 245 AND round_even(CASE WHEN v > 0 THEN (v - w) / v::DOUBLE * 255 ELSE 0 END, 0) < 35 AS shines FROM px),
f AS (SELECT k, {_var('edge')} AS variance, round_even(count(*) FILTER (WHERE shines) / {n}e0 * 100, 2) AS glare, avg(gray) AS brightness, sqrt({_var('gray')}) AS contrast FROM n GROUP BY k),
s AS (SELECT *, least(40.0, variance / 250 * 40) + greatest(0.0, 30 - glare * 10) + CASE WHEN brightness < 55 THEN brightness / 55 * 12 WHEN brightness > 215 THEN (255 - brightness) / 40 * 12 ELSE 20 END + 4 AS points FROM f)
SELECT k, true AS success, variance, glare, brightness, round(contrast, 3) AS contrast, least(100.0, greatest(0.0, round_even(points::DOUBLE, 1)))::DOUBLE AS score, variance < 95 AS is_blurry, glare > 1.2 AS has_glare, CASE WHEN brightness < 55 THEN 'TOO_DARK' WHEN brightness > 215 THEN 'OVEREXPOSED' ELSE 'OPTIMAL' END AS brightness_level FROM s"""


def _raster_spoofing() -> str:
    """Regions by what each bright pixel reaches over its eight neighbours."""
    chroma = lambda c, m: f"sqrt({_var(f'round_even(({c} - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b)) * {m}e0 + 128, 0)')})"
    return f"""WITH RECURSIVE {_pixels("supplier", "s_suppkey")},
br AS MATERIALIZED (SELECT k, x, y, y * {flows.SIDE} + x AS id FROM px WHERE v > 248),
e AS MATERIALIZED (SELECT a.k, a.id AS a, b.id AS b FROM br a JOIN br b ON a.k = b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r(k, a, b) AS (SELECT k, a, b FROM e UNION SELECT r.k, r.a, e.b FROM r JOIN e ON e.k = r.k AND e.a = r.b),
l AS (SELECT k, a, min(b) AS label FROM r GROUP BY k, a),
g AS (SELECT k, label, count(*) AS area FROM l GROUP BY k, label),
t AS (SELECT k, sum(area) AS bright, count(*) FILTER (WHERE area > 80) AS spots FROM g GROUP BY k),
f AS (SELECT k, {chroma("r", "0.713")} AS cr, {chroma("b", "0.564")} AS cb FROM px GROUP BY k),
s AS (SELECT f.*, CASE WHEN coalesce(bright, 0) > 100 THEN spots ELSE 0 END AS spots FROM f LEFT JOIN t USING (k)),
z AS (SELECT *, spots >= 2 AS glass, cr < 5 AND cb < 5 AS flat FROM s)
SELECT k, spots AS glare_spots, round(cr, 3) AS cr_std, round(cb, 3) AS cb_std, (glass::INT * 25 + flat::INT * 30)::DOUBLE AS score, glass::INT * 25 + flat::INT * 30 >= 50 AS is_spoof, concat_ws(',', CASE WHEN glass THEN 'specular' END, CASE WHEN flat THEN 'flat_chrominance' END) AS flags FROM z"""


#: Digits that are read for one another; letters can't stand in a date that is accepted.
_DIGITS = {"0": "86", "1": "7", "2": "47", "3": "58", "4": "26", "5": "36", "6": "405", "7": "1", "8": "30"}


def _checked() -> list[str]:
    """ck: the checks of each card whose second line has a wrong check digit of the birth date in every fourth row; a birth date holds if one or two changed digits meet the digit."""
    ck = fx.duck_check
    alike = ", ".join(f"('{d}', '{a}')" for d, alts in _DIGITS.items() for a in alts)
    put = "concat(substr({s}, 1, {i} - 1), {a}, substr({s}, {i} + 1))"
    return [
        "c0 AS (SELECT *, CASE WHEN k % 4 = 0 THEN concat(substr(l2, 1, 6), (substr(l2, 7, 1)::INT + 5) % 10, substr(l2, 8)) ELSE l2 END AS s2 FROM idn)",
        "c1 AS (SELECT *, s2[7] AS told, concat(substr(l1, 6), substr(s2, 1, 7), substr(s2, 9, 7), substr(s2, 19, 11)) AS whole FROM c0)",
        f"alike(ch, alt) AS (VALUES {alike})",
        f"one AS (SELECT k, dob, told, i, {put.format(s='dob', i='i', a='alt')} AS s FROM c1, range(1, 7) t(i) JOIN alike ON alike.ch = dob[i] WHERE {ck('dob')} <> told)",
        f"two AS (SELECT k, told, {put.format(s='s', i='j', a='alt')} AS s FROM (SELECT *, unnest(range(i + 1, 7)) AS j FROM one) JOIN alike ON alike.ch = dob[j])",
        f"hit AS (SELECT DISTINCT k FROM (SELECT k, s, told FROM one WHERE regexp_full_match(s, '[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])') UNION ALL SELECT k, s, told FROM two) WHERE {ck('s')} = told)",
        f"ck AS (SELECT c1.*, {ck('dob')} = told OR hit.k IS NOT NULL AS birth_holds, {ck('whole')} = s2[30] AS composite FROM c1 LEFT JOIN hit USING (k))",
    ]


def _mrz_checksums() -> str:
    return "WITH " + ",\n".join([fx.duck_identities(), *_checked()]) + " SELECT k, true AS has_mrz, true AS document_number_valid, true AS expiry_date_valid, composite AS composite_valid, birth_holds AS birth_date_valid, birth_holds AS all_passed FROM ck"


def _verification_report() -> str:
    from . import oracles

    cross = oracles._cross("idn", "pinfl", "CASE WHEN k % 3 = 0 THEN '1931-05-05' ELSE birth END", "gender")
    return "WITH " + ",\n".join([fx.duck_identities(), *_checked(), *cross, "al AS (SELECT k, concat_ws(',', nullif(x.alerts, ''), CASE WHEN NOT birth_holds THEN 'mrz_birth_date' END) AS alerts FROM ck JOIN x USING (k))"]) + " SELECT k, CASE WHEN alerts = '' THEN 'PASS' WHEN alerts = 'mrz_birth_date' THEN 'WARN' ELSE 'FAIL' END AS overall_status, alerts = '' AS is_authentic, alerts FROM al"


def _extract_negative() -> str:
    """Numbers by their strict form, by a look-alike with a known prefix, and after a label; births by the order of a text's dates."""
    strict = r"\b([A-Z]{2}\s*[0-9]{7})\b"
    denied = "^(UZ|RE|SH|GU|KA|DA|PE|ZB|OT|TU|AM)"
    tail = "translate(substr({0}, 3), 'IlSsZBO', '{1}')"
    label = r"(?i)(?:karta\s*raqami|pasport\s*raqami|document\s*no|card\s*number)[:\s\w/]*?([A-Z]{2}\s*[A-Z0-9]{7})"
    day = r"(?:0[1-9]|[12][0-9]|3[01])\s*(?:0[1-9]|1[0-2])\s*(?:19[0-9]{2}|20[0-9]{2})"
    fits = "(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])(19[2-9][0-9]|20[0-3][0-9]|204[0-5])"
    return rf"""WITH t AS (SELECT doc_id, text, regexp_replace(translate(text, 'АВЕСР', 'ABECP'), '\bA0([0-9]{{7}})\b', 'AD\1', 'g') AS u FROM documents),
n AS (SELECT doc_id, text, [x for x in regexp_extract_all(u, '{strict}', 1) if NOT regexp_matches(regexp_replace(x, '\s+', '', 'g'), '{denied}')] AS a,
 [x for x in regexp_extract_all(u, '\b([A-Z]{{2}}[A-Z0-9]{{7}})\b', 1) if left(x, 2) IN ('AA', 'AB', 'AC', 'AD', 'AE', 'AF', 'FA') AND regexp_full_match({tail.format('x', '1155380')}, '[0-9]{{7}}')] AS b,
 regexp_replace(regexp_extract(text, '{label}', 1), '\s+', '', 'g') AS c FROM t),
d AS (SELECT doc_id, len(a) > 0 OR len(b) > 0 OR (length(c) = 9 AND NOT regexp_matches(c, '{denied}') AND regexp_full_match({tail.format('c', '1155280')}, '[0-9]{{7}}')) AS numbered, list_concat([regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(text, '\b([0-9]{{2}}[./\-\s]+[0-9]{{2}}[./\-\s]+[0-9]{{4}})\b', 1)], [regexp_replace(x, '\s', '', 'g') for x in list_concat(regexp_extract_all(text, '\b({day})\b', 1), regexp_extract_all(text, '\b[0-9]({day})\b', 1))]) AS ds FROM n),
e AS (SELECT doc_id, concat(substr(x, 5, 4), substr(x, 3, 2), substr(x, 1, 2)) AS x FROM (SELECT doc_id, unnest(ds) AS x FROM d) WHERE regexp_full_match(x, '{fits}')),
y AS (SELECT doc_id, count(DISTINCT left(x, 4)) AS years, min(left(x, 4)) AS first FROM e GROUP BY doc_id)
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM d WHERE numbered) AS numbers, (SELECT count(*) FROM y WHERE years >= 3 OR first < '2012') AS births"""


def _metadata() -> str:
    told = """('LOOK_LEFT', 'Chapga qarang|Boshingizni biroz chap tomonga buring|👈'), ('LOOK_RIGHT', 'O''ngga qarang|Boshingizni biroz o''ng tomonga buring|👉'), ('MOVE_CLOSER', 'Yaqinroq keling|Yuzingizni kameraga yaqinlashtiring|🔍'),
('MOVE_AWAY', 'Uzoqroq qiling|Kameradan biroz uzoqlashing|↔️'), ('BLINK', 'Ko''zingizni yuming|Ko''zingizni bir marta yumib oching|😉'), ('SMILE', 'Jilmaying|Kameraga qarab samimiy jilmaying|😊')"""
    return f"""WITH m(c, told) AS (VALUES {told}), d AS (SELECT concat('s-', event_id) AS session, c, told, md5(concat('s-', event_id, '-', c)) AS h FROM events, m),
o AS (SELECT *, row_number() OVER (PARTITION BY session, starts_with(c, 'MOVE') ORDER BY h) AS n FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY h) AS i FROM o WHERE NOT starts_with(c, 'MOVE') OR n = 1)
SELECT session, 90::BIGINT AS expires_in_seconds, count(*) AS challenges_count, string_agg(concat(c, '|', told), ';' ORDER BY i) AS challenges FROM p WHERE i <= 2 GROUP BY session"""


def _docnum() -> str:
    """The first of four ways that gives a number."""
    denied = "^(UZ|RE|SH|GU|KA|DA|PE|ZB|OT|TU|AM)"
    tail = lambda x, digits: f"concat(left({x}, 2), translate(substr({x}, 3), 'IlSsZBO', '{digits}'))"
    whole = "'[A-Z]{2}[0-9]{7}'"
    label = r"(?i)(?:karta\s*raqami|pasport\s*raqami|document\s*no|card\s*number)[:\s\w/]*?([A-Z]{2}\s*[A-Z0-9]{7})"
    return rf"""WITH {fx.duck_identities()},
t AS (SELECT k, {flows.NUMBERED} AS text FROM idn),
u AS (SELECT k, text, regexp_replace(translate(text, 'АВЕСР', 'ABECP'), '\bA0([0-9]{{7}})\b', 'AD\1', 'g') AS u FROM t),
c AS (SELECT k, [y for y in [regexp_replace(x, '\s+', '', 'g') for x in regexp_extract_all(u, '\b([A-Z]{{2}}\s*[0-9]{{7}})\b', 1)] if NOT regexp_matches(y, '{denied}')][1] AS one,
 [y for y in [{tail('x', '1155380')} for x in regexp_extract_all(u, '\b([A-Z]{{2}}[A-Z0-9]{{7}})\b', 1) if left(x, 2) IN ('AA', 'AB', 'AC', 'AD', 'AE', 'AF', 'FA')] if regexp_full_match(y, {whole})][1] AS two,
 regexp_replace(regexp_extract(text, '{label}', 1), '\s+', '', 'g') AS l, regexp_extract_all(u, '\b([0-9]{{9}})\b', 1)[1] AS four FROM u)
SELECT k, coalesce(one, two, CASE WHEN length(l) = 9 AND NOT regexp_matches(l, '{denied}') AND regexp_full_match({tail('l', '1155280')}, {whole}) THEN {tail('l', '1155280')} END, four) AS document_number FROM c"""


def _pinfl() -> str:
    number, fits = r"([1-6](?:[\s-]*[0-9]){13})", "'[1-6](0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{9}'"
    bare = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return rf"""WITH {fx.duck_identities()},
t AS (SELECT k, {flows.PERSONAL} AS text FROM idn),
c AS (SELECT k, {bare("regexp_extract(text, '(?i)(?:shaxsiy" + chr(92) + "s*raqam[i|e]?|personal" + chr(92) + "s*number)[:" + chr(92) + "s]*" + number + "', 1)")} AS label, [y for y in [{bare('x')} for x in regexp_extract_all(text, '\b{number}\b', 1)] if regexp_full_match(y, {fits})][1] AS other FROM t)
SELECT k, CASE WHEN regexp_full_match(label, {fits}) THEN label ELSE other END AS jshshir FROM c"""


def _name_tokens() -> str:
    cut = "trim(regexp_replace(trim(replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(t), '^[0-9]+', ''), '<{2,}.*$', '')), '<+$', '')), '<', ' ')), '^[A-Z]\\s+', ''))"
    last = lambda x: f"trim(regexp_replace({x}, '\\s+[SKCE]$', ''))"
    sur, first = "regexp_replace(c, '(OVA|EVA|IYEV|IYEVA|OV|EV|LI|QIZI)[SKCE]+$', '\\1')", "regexp_replace(c, '([AEIOUY])S+$', '\\1')"
    return f"WITH {fx.duck_identities()}, n AS (SELECT k, {flows.TOKEN} AS t FROM idn), c AS (SELECT k, {cut} AS c FROM n) SELECT k, {last(sur)} AS surname, {last(first)} AS first_name FROM c"


def _shown() -> str:
    return f"WITH {fx.duck_identities()}, p AS (SELECT k, surname, CASE WHEN k % 2 = 0 THEN 'profile' WHEN k % 3 = 0 THEN 'fields' WHEN k % 5 = 0 THEN 'merged' WHEN k % 7 = 0 THEN 'page' END AS part FROM idn) SELECT k, part, CASE WHEN part IS NOT NULL THEN concat_ws(' ', surname, part) END AS full_name FROM p"


def _uploads() -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in flows.UPLOAD.items())
    return f"WITH {fx.duck_identities()}, u AS (SELECT k, {made} FROM idn) SELECT k, path, CASE WHEN size > 26214400 THEN 'too_large' WHEN NOT ends_with(lower(path), '.pdf') THEN 'bad_name' WHEN left(head, 10) <> '255044462D' THEN 'bad_format' END AS rejection FROM u"


def _json() -> str:
    body = """concat('{"k":', k, ',"surname":"', surname, '","success":', k % 3 <> 0, ',"quoted":"say ', chr(92), '"', doc, chr(92), '""}')"""
    return f"WITH {fx.duck_identities()}, j AS (SELECT k, CASE WHEN k % 5 = 0 THEN 400 WHEN k % 3 <> 0 THEN 200 ELSE 422 END::BIGINT AS status_code, {body} AS body FROM idn) SELECT k, status_code, body, concat('data:application/json;base64,', base64(encode(body))) AS uri FROM j"


def _folding() -> str:
    made = ", ".join(f"{e} AS {n}" for n, e in flows.WORDS.items())
    ends = "^[^A-ZА-Яa-zа-я]+|[^A-ZА-Яa-zа-я]+$"
    place = "CASE k % 4 WHEN 0 THEN 'POP' WHEN 1 THEN 'NAMANGAN VILOYATI' WHEN 2 THEN 'CHUST' ELSE 'POP TUMANI' END"
    return f"""WITH {fx.duck_identities()}, w AS (SELECT k, surname, {made} FROM idn)
SELECT k, trim(regexp_replace(word, '{ends}', '', 'g')) AS word, concat(surname, '3O ') AS folded, concat('O', surname) AS plain, concat({place}, CASE k % 3 WHEN 0 THEN ' TUMANI' WHEN 1 THEN ' SHAHRI' ELSE '' END) AS place FROM w"""


def sql() -> dict[str, str]:
    return {"fuzzy_pairs": _fuzzy(), "admission_leaky": _leaky(*flows.LEAKY), "admission_log": _log(*flows.LOG), "liveness_verify": _sessions(), "zone_search": _zone_search(), "card_verification": _cards(), "raster_quality": _raster_quality(), "challenge_metadata": _metadata(), "docnum_fallbacks": _docnum(), "pinfl_fallbacks": _pinfl(), "name_tokens": _name_tokens(), "shown_record": _shown(), "pdf_uploads": _uploads(), "json_export": _json(), "word_folding": _folding(), "mrz_checksums": _mrz_checksums(), "verification_report": _verification_report(), "extract_negative": _extract_negative(), "raster_spoofing": _raster_spoofing()}
