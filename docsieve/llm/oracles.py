"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import centroids, jumphash, linefreq, variants

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DEDUP = rf"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

RULES = rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_WORD}')] AS ls FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
u AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
v AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM u, range(0, 3) o(j) GROUP BY 1),
x AS MATERIALIZED (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(y), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(y, '{_WORD}')) AS words FROM (SELECT doc_id, source, unnest(ls) AS y FROM d)),
f AS (SELECT source, line FROM x GROUP BY ALL HAVING count(DISTINCT doc_id) > {linefreq.LINE_DOCS}),
q AS (SELECT doc_id, sum(words) AS lost FROM x JOIN f ON f.source IS NOT DISTINCT FROM x.source AND f.line = x.line GROUP BY 1),
z AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN v USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {linefreq.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {linefreq.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * lost > {linefreq.DEPLETED} * n_words AS kept FROM z"""

#: crc32 by half bytes: t.t has sixteen steps of the reversed polynomial, ``_crc`` folds a list of half bytes, the low half of each byte first.
_STEPS = "b(i, k, x) AS (SELECT i, 0, i::BIGINT FROM range(16) r(i) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM b WHERE k < 4), t AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM b WHERE k = 4)"


def _digits(text: str) -> str:
    return f"list_transform(string_split(hex(encode({text})), ''), lambda x: strpos('0123456789ABCDEF', x)::BIGINT - 1)"


def _low_first(digits: str) -> str:
    return f"list_transform(range(1, len({digits}) // 2 * 2 + 1), lambda i: {digits}[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END])"


def _crc(halves: str) -> str:
    return f"coalesce(xor(list_reduce({halves}, lambda c, x: xor(c // 16, t.t[xor(c % 16, x) + 1]), 4294967295::BIGINT), 4294967295), 0)"


_RUN = r"[a-z\x{00C0}-\x{00FF}]+"
_CUT = lambda word, at: f"left({word}, {at}) || substr({word}, {at} + 2)"

#: Near words meet by their deletions: one word is a deletion of the other, or both give the same text at the same place.
VARIANTS = rf"""WITH RECURSIVE {_STEPS},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_RUN}')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, k, {_digits("concat(doc_id, ':', run)")} AS d FROM r WHERE length(run) >= {variants.MIN_LENGTH}),
c AS MATERIALIZED (SELECT run, k, {_crc("z")} AS h FROM (SELECT run, k, {_low_first("d")} AS z FROM h), t),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {variants.DAMAGED} = 0 THEN {_CUT("run", "h % length(run)")} ELSE run END AS word, k FROM c) WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY word HAVING sum(k) >= {variants.MIN_COUNT}),
x AS MATERIALIZED (SELECT word, i, {_CUT("word", "i")} AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
y AS (SELECT DISTINCT x.word AS long, v.word AS short FROM x JOIN v ON v.word = x.cut),
p AS (SELECT long AS word, short AS near FROM y UNION ALL SELECT short, long FROM y UNION ALL SELECT l.word, r.word FROM x l JOIN x r ON l.cut = r.cut AND l.i = r.i AND l.word <> r.word),
g AS (SELECT p.word, count(*) AS n_near, list(p.near ORDER BY v.n DESC, p.near)[1] AS near, max(v.n) AS most FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {variants.RATIO} * v.n THEN near END AS form, CASE WHEN most >= {variants.RATIO} * v.n THEN most END AS form_n FROM v LEFT JOIN g ON g.word = v.word),
w(word, root) AS (SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f e ON e.word = w.root AND e.form IS NULL"""

SHARDS = rf"""WITH RECURSIVE {_STEPS},
d AS MATERIALIZED (SELECT doc_id, coalesce(doc_id, 0) AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_digits("coalesce(text, '')")} AS h FROM documents),
c AS (SELECT doc_id, key, size, {_crc("z")} AS text_crc32 FROM (SELECT doc_id, key, size, {_low_first("h")} AS z FROM d), t),
j(key, state, jump) AS (SELECT key, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END, 0::BIGINT FROM (SELECT DISTINCT key FROM d)
  UNION ALL SELECT key, state, floor((jump + 1) * (2147483648::DOUBLE / ((state // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT key, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state, jump FROM j WHERE jump < {jumphash.SHARDS + 1})),
s AS (SELECT key, max(jump) FILTER (WHERE jump < {jumphash.SHARDS}) AS shard, max(jump) FILTER (WHERE jump < {jumphash.SHARDS + 1}) AS grown_shard FROM j GROUP BY key)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM c JOIN s USING (key)"""


def _round(i: int) -> str:
    """a{i}: the nearest centroid of c{i} and its distance for each vector; c{i + 1}: the centroids after that round."""
    return f"""a{i} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, c := c)) AS near FROM (SELECT row, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM k, c{i}) GROUP BY row),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(v) AS x, unnest(range(len(v))) AS i FROM k JOIN a{i} USING (row)) GROUP BY c, i) GROUP BY c) m USING (c))"""


CENTROIDS = rf"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.SIZE} AND len(embedding) = {centroids.SIZE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256(concat('{centroids.SEED}:', vec_id)) AS h FROM k ORDER BY h, v LIMIT {centroids.CLUSTERS})),
{", ".join(_round(i) for i in range(centroids.ROUNDS + 1))}
SELECT vec_id, near.c::INT AS cluster, near.d::BIGINT AS distance, sum(near.d) OVER (PARTITION BY near.c)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{centroids.ROUNDS}.v, ',')) AS centroid_sha256
FROM k JOIN a{centroids.ROUNDS} USING (row) JOIN c{centroids.ROUNDS} ON c{centroids.ROUNDS}.c = near.c"""


def sql() -> dict[str, str]:
    return {"op2_minhash_dedup": DEDUP, "op10_quality_rules": RULES, "op11_spelling_variants": VARIANTS, "op12_jump_sharding": SHARDS, "op13_centroid_clusters": CENTROIDS}
