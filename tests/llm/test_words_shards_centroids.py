import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsieve.llm import centroids, jumphash, variants

from .conftest import prose


def brute_words(rows, letters=None):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    out = {}
    for w in n:
        found = sorted((-n[v], v) for v in n if v != w and near(w, v))
        form = found[0][1] if found and -found[0][0] >= 5 * n[w] else None
        out[w] = (form, n[w], len(found), n[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), k, m, f) for w, (form, k, m, f) in out.items()}


def found_words(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.variants(df).collect()}


WORDS = [("banana", 200), ("bananna", 30), ("banannna", 6), ("bannna", 5), ("Banan", 50), ("çédille", 40), ("çèdille", 8), ("cédille", 5), ("aaaaaa", 25), ("aaaaaaa", 5), ("baaaaaa", 5), ("monkey", 30), ("donkey", 30), ("honkey", 6), ("only÷here×", 7), ("Straße", 9), ("once-seen", 1)]


def test_words_same_as_brute_force(spark):
    rows = [(i % 7, f"{word}! 12") for word, k in WORDS for i in range(k)] + [(None, "Banana, BANANA banana"), (3, None), (4, ""), (5, "12 ... !!"), (6, prose(3, 20_000)), (6, "Ä" * 5000 + " ΑΒΓ"), (-5, "monkey\x00donkey")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("own"), "n": F.lit(1), "form": F.lit("x")}).repartition(3)
    want = brute_words(rows)
    assert found_words(df) == want
    assert want["bannna"][0] == "banana" and want["banannna"][:2] == ("bananna", "banana") and want["honkey"][0] == "donkey"


def test_words_by_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(variants, "small", lambda df: df)
    rows = [(i, word) for word, k in WORDS for i in range(k)]
    assert found_words(spark.createDataFrame(rows, "doc_id long, text string")) == brute_words(rows)


def test_blocks_of_words_add_up(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(variants, "BLOCK_WORDS", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": ["banana monkey donkey"] * 300})
    blocks = list(variants._counted(iter([batch, batch]), 6, 199))
    assert len(blocks) > 2 and sum(sum(b.column(1).to_pylist()) for b in blocks) > 1780


def test_neighbourhood_makes_each_text_once(spark):
    letters = ["a", "b", "é"]
    for word in ("aab", "a", "éaéé"):
        got = [r["near"] for r in variants.neighbourhood(spark.createDataFrame([(word,)], "word string"), letters).collect()]
        want = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ["", *letters]}
        assert len(got) == len(set(got)) and set(got) == want - {word}


def test_words_of_nothing(spark, empty):
    assert variants.variants(empty).count() == 0
    assert variants.variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")).count() == 0


def test_roots_of_a_long_chain(spark):
    links = spark.range(37).select(F.col("id").cast("string").alias("word"), (F.col("id") + 1).cast("string").alias("form"))
    assert {r["root"] for r in variants.roots(links).df.collect()} == {"37"}


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 40, 41, 1000])
def test_jumps_same_as_published(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567] + [k * 7919 for k in range(60)]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in jumphash.sharded(df, shards).collect()}
    assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_jumps_beyond_the_usual_number_of_draws(spark, monkeypatch):
    monkeypatch.setattr(jumphash, "DRAWS", 2)
    df = spark.createDataFrame([(k, "x") for k in range(200)], "doc_id long, text string")
    assert {r["doc_id"]: r["shard"] for r in jumphash.sharded(df, 30).collect()} == {k: jump(k, 30) for k in range(200)}


def test_shards_of_odd_rows(spark, docs, empty):
    both = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "a", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    hot = both.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(300).select()), allowMissingColumns=True)
    source = [(r["doc_id"], r["text"] or "") for r in hot.select("doc_id", "text").collect()]
    got = jumphash.sharded(hot).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in source)
    by_shard = {}
    for r in got:
        assert r["law"] == "key" and r["shard"] == jump(r["doc_id"] or 0, 16) and r["grown_shard"] in (r["shard"], 16)
        by_shard.setdefault(r["shard"], []).append(r)
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in sorted(rows, key=lambda r: r["slot"])]
        assert order == sorted(order)
    assert jumphash.sharded(empty).count() == 0


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**53 else 64 * int(x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        cs = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, of) if o == j]) else c for j, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept]
    most = 2**63 - 1
    own = Counter()
    for _, d, j in last:
        own[j] += min(d, most)
    return sorted((str(i), j, min(d, most), min(own[j], most), min(sum(own.values()), most), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in last)


def found_clusters(df, **kw):
    return sorted((str(r["vec_id"]), *list(r)[1:]) for r in centroids.cluster(df, **kw).collect())


def vector(seed, scale=0.5):
    x = seed * 2654435761 + 1
    out = []
    for _ in range(64):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(((x >> 33) / 2**31 * 2 - 1) * scale)
    return out


ODD = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [math.nan] * 64), (904, [math.inf] + [0.0] * 63), (905, []), (None, vector(5)), (3, vector(3)), (3, vector(3)), (3, vector(4))]


@pytest.mark.parametrize("scale, kind", [(0.5, "float"), (70_000.0, "double"), (3e6, "double"), (1e17, "double"), (1e306, "double")])
def test_clusters_same_as_brute_force(spark, scale, kind):
    """Small vectors by matrix products; a few or all beyond its bound, up to 64 * x beyond a double."""
    rows = [(i, vector(i, scale if i % 5 == 0 else 0.5)) for i in range(80)] + ODD
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"cluster": F.lit("own"), "x": F.lit(1), "distance": F.lit(None)}).repartition(3)
    assert found_clusters(df) == brute_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_clusters_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert found_clusters(spark.createDataFrame([], schema)) == []
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    assert found_clusters(spark.createDataFrame(rows, schema)) == brute_clusters(rows)
    assert found_clusters(spark.createDataFrame(rows[:2] * 40, schema)) == brute_clusters(rows[:2] * 40)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(40)] + [(99, [0.5] + [0.0] * 63)]
    assert found_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=2) == brute_clusters(rows, 2)
