import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docsieve.llm import flat, minhash
from docsieve.llm.components import components

from .conftest import prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **kw).collect()}


def test_same_as_brute_force(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 4)
    assert found(docs, words=4) == want


def test_repeated_and_empty(repeated, empty):
    got = minhash.near_duplicates(repeated, words=4).collect()
    assert len(got) == 20 and {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert minhash.near_duplicates(empty, words=4).count() == 0
    assert minhash.one_of_each(repeated).count() == len({r["component_id"] for r in minhash.near_duplicates(repeated, words=5).collect()})


def test_one_repeat_costs_no_other_row(spark):
    """Null ids, an id with two texts (one of them a copy of a lower id's), and a row that stands twice."""
    a, b, c, d = (prose(400 + k, 80) for k in range(4))
    near = a.split()
    near[40] = "changed"
    rows = [(None, a), (None, a), (None, c), (1, a), (5, " ".join(near)), (5, b), (6, c), (6, c), (7, None), (8, None), (9, d), (9, d + " " + c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(None, a), (None, a), (None, c), (1, a), (5, b), (6, c), (7, None), (8, None), (9, d), (9, d + " " + c)], key=str)


def test_families_lose_no_link(spark):
    """Passages with own and with shared tails, and copies edited ever more heavily, alone and in chains."""
    rows = []
    for f in range(6):
        passage = prose(900 + f, 60).split()
        for i in range(12):
            own = prose(1000 + 50 * f + i // 2, 10 if f < 3 else 40).split()
            own[0] = f"v{i}"
            rows.append((len(rows), " ".join(passage + own)))
    for f in range(2):
        base = prose(2000 + f, 150).split()
        for i in range(40):
            if f == 0 or i % 8 == 0:
                copy = list(base)
            for k in range(i // 3 if f == 0 else 2):
                copy[(37 * i + 11 * k) % 150] = f"e{i}x{k}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, words=3) == brute(rows, 3)


def test_signature_is_one_slice_a_shingle_and_estimates_similarity():
    c = minhash.Circulant()
    h = flat.mix(np.arange(3000, dtype=np.uint64))
    a, b = h[:2000], h[400:2400]
    equal = (c.signature(a) == c.signature(b)).mean()
    assert abs(equal - 1600 / 2400) < 0.12
    assert (c.signature(a) == np.minimum(c.signature(a[:700]), c.signature(a[700:]))).all()


def test_shingle_sets_fold_ascii_case_only():
    data, offsets = flat.flat(pa.array(["A b\tC d e", "a B c\x0bD e", "É b c d e", "é b c d e", None, "x"]))
    s = flat.shingle_sets(data, offsets, 4)
    assert (s[0] == s[1]).all() and len(s[0]) == 2 and set(s[2]) != set(s[3]) and len(s[4]) == 0 and len(s[5]) == 1


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}


def test_one_id_with_two_texts_loses_no_link(spark):
    """A family around a hub that is not near enough to documents 3 and 5, which are near each other; document 5 has another, unrelated text."""
    base = prose(700, 120).split()

    def edited(*places):
        return " ".join(f"e{p}" if p in places else w for p, w in enumerate(base))

    rows = [(10 + i, edited(100, 105 + i)) for i in range(8)] + [(3, edited(10, 30, 50, 70)), (5, edited(10, 30, 50, 70, 71)), (5, prose(701, 90)), (6, prose(701, 90) + " end"), (5, prose(702, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in minhash.near_duplicates(df, words=4).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    want = brute([((i, k), t) for k, (i, t) in enumerate(rows)], 4)
    for k, (i, _) in enumerate(rows):
        n, (least, _) = want[i, k]
        assert (n, least) in got[i], (i, got[i])
    assert (len(shingles(rows[9][1], 4)), 3) in got[5] and got[6][0][1] == 5


def test_a_hot_id_with_many_texts(spark):
    rows = [(1, prose(3000 + i, 30)) for i in range(60)] + [(2, prose(3005, 30) + " more"), (None, prose(3006, 30))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert len(got) == len(rows) and [r["component_id"] for r in got if r["doc_id"] == 2] == [1]
