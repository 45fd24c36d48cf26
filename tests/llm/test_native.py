import collections
import hashlib
import re

from pyspark.sql import functions as F

from docsieve.llm import linefreq, mixing, simhash
from docsieve.llm.ranks import ranked

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_as_brute_force(docs, repeated, empty):
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in linefreq.judge(docs).collect():
        t = text[r["doc_id"]]
        w = WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(tri)
        cover = {i + j for i, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed, not failed)
    assert linefreq.judge(repeated).count() == 20 and linefreq.judge(empty).count() == 0


def test_common_lines_deplete(spark):
    own = lambda i: "\n".join(prose(700 + 20 * i + j, 6) for j in range(12))
    many = own(30).replace(" ", "  ")
    rows = [(i, "h", many if i < 6 else own(i) + "\n" + own(30).split("\n")[1].upper()) for i in range(12)] + [(20, "other", many), (21, None, many)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r["doc_id"]: r["kept"] for r in linefreq.judge(df.union(df.where("doc_id = 0")), least=4).collect()}
    assert [kept[i] for i in (0, 5, 6, 20, 21)] == [False, False, True, True, True]


def test_no_host_excuses_a_line(spark):
    """Verdicts stay when unrelated rows are added to the host."""
    shared = prose(40, 90)
    rows = [(i, "h", shared + "\n" + prose(3000 + i, 60 if i < 12 else 5)) for i in range(24)] + [(90, "h", prose(4999, 60))]
    more = [(100 + i, "h", prose(5000 + i, 20)) for i in range(6000)]
    verdicts = []
    for extra in ([], more):
        df = spark.createDataFrame(rows + extra, "doc_id long, source string, text string")
        assert linefreq.frequent(linefreq.base(df)).count() == 1
        verdicts.append({r["doc_id"]: r["kept"] for r in linefreq.judge(df).where("doc_id < 100").collect()})
    assert verdicts[0] == verdicts[1] and not any(verdicts[0][i] for i in range(12, 24)) and verdicts[0][90]


def test_a_repeated_document_is_one_document(spark):
    text = "\n".join(prose(900 + j, 8) for j in range(10))
    df = spark.createDataFrame([(1, "h", text)] * 25 + [(2, "h", prose(950, 60))], "doc_id long, source string, text string")
    assert linefreq.frequent(linefreq.base(df)).count() == 0
    assert {(r["doc_id"], r["kept"]) for r in linefreq.judge(df).collect()} == {(1, True), (2, True)}
    many = spark.createDataFrame([(i, "h", text) for i in range(25)], df.schema)
    assert linefreq.frequent(linefreq.base(many.union(many))).count() == 10 and not linefreq.judge(many.union(many)).where("kept").count()


def test_fingerprints(docs, repeated, empty):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in simhash.edited(docs).collect()}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        e = t[: len(t) - k] + u[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1 and got[3]["fingerprint"] == got[8]["fingerprint"] == "0" * 32
    apart = bin(int(got[10]["fingerprint"], 16) ^ int(got[11]["fingerprint"], 16)).count("1")
    assert got[10]["near_next"] == 1 - apart / 128
    assert simhash.edited(repeated).count() == 20 and simhash.edited(empty).count() == 0


def test_fingerprints_as_plain_python(docs):
    import xxhash

    def hashed(*parts):
        seed = 42
        for p in parts:
            if p is not None:
                seed = xxhash.xxh64_intdigest(p, seed=seed)
        return seed

    def plain(text):
        w = [x.encode() for x in WORD.findall(text)]
        size, votes = 0, [0] * 128
        for one, two in zip(w, [*w[1:], None]):
            n = len(one.decode()) + (len(two.decode()) if two else 0)
            weight = max(1, min(4, n // 4))
            size += weight
            for half, h in ((64, hashed(one, two)), (0, hashed(two, one, (1).to_bytes(4, "little")))):
                for b in range(64):
                    votes[half + b] += weight * (h >> b & 1)
        return sum(1 << b for b in range(128) if 2 * votes[b] > size)

    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in simhash.edited(docs).collect()}
    prints = {i: plain(t) for i, t in text.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    asked = {prints[i] for i in text if i % simhash.QUERIES == 0}
    assert {i: r["n_near"] for i, r in got.items()} == {i: sum((p ^ q).bit_count() <= simhash.RADIUS for q in asked) for i, p in prints.items()}
    ids = sorted(text)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        k = len(text[i]) // 2
        edited = plain(text[i][: len(text[i]) - k] + text[j][:k])
        assert int(got[i]["edited_fingerprint"], 16) == edited
        assert got[i]["near_edited"] == 1 - (prints[i] ^ edited).bit_count() / 128 and got[i]["near_next"] == 1 - (prints[i] ^ prints[j]).bit_count() / 128


def test_block_tables_find_all_within_radius(spark):
    import random

    r = random.Random(1)
    prints = [r.getrandbits(128) for _ in range(40)]
    for p in prints[:20]:
        x = p
        for b in r.sample(range(128), r.randint(1, 5)):
            x ^= 1 << b
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints + prints[:5]], "hi long, lo long")
    want = sorted(bin(a ^ b).count("1") for i, a in enumerate(prints) for b in prints[:i] if 0 < bin(a ^ b).count("1") <= 3)
    assert sorted(x["distance"] for x in simhash.within(df, 3).collect()) == want and want


def test_mix(docs, repeated, empty):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(out, key=str) == sorted(again, key=str) and len(out) == 42
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.select("doc_id", "text").collect()}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    total = {r["source"]: r["source_size"] for r in out}
    assert total == {s: sum(r["size"] for r in out if r["source"] == s) for s in total}
    goal = {r["source"]: r["target"] for r in out}
    # weights 1, 2, 3 for a, b, null; targets stop at 3 times the source's size and the rest is reshared
    want, left, open_ = {}, float(sum(total.values())), {"a": 1, "b": 2, None: 3}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * total[s]
            left -= want[s]
            del open_[s]
    assert all(abs(goal[s] - want[s]) < 1e-6 for s in want)
    assert mixing.mix(repeated).count() == 20 and mixing.mix(empty).count() == 0
    copies = {r["doc_id"]: r["copies"] for r in out}
    made = collections.Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect())
    assert made == collections.Counter({i: c for i, c in copies.items() if c})


def test_taken_words_come_near_targets(spark):
    """Forty sources of very different sizes, many above their caps: targets as a plain loop gives them, taken words beside them."""
    rows = [(i, f"s{i % 40:02d}", " ".join(["w"] * (1 + i * 7919 % 50 * (1 + i % 40)))) for i in range(8000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    total, taken = collections.Counter(), collections.Counter()
    for r in out:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(total))}
    level, full = 0.0, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(weight[s] for s in weight if s not in full)
        more = {s for s in weight if level * weight[s] > 3 * total[s]}
        if more == full:
            break
        full = more
    goal = {r["source"]: r["target"] for r in out}
    assert full and all(abs(goal[s] - min(level * weight[s], 3 * total[s])) < 1e-6 * goal[s] for s in goal)
    assert all(abs(taken[s] - goal[s]) < 0.01 * goal[s] + 50 for s in goal)


def test_pivotal_keeps_the_sum(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("source_key"), "id", (F.col("id") % 900 + 1).alias("size"), (0.1 + 0.25 * (F.col("id") % 3)).alias("f"))
    got = mixing.pivotal(df, block=16).join(df, ["source_key", "id"])
    assert got.count() == 5000
    for r in got.groupBy("source_key").agg(F.sum("take").alias("n"), F.sum("f").alias("f"), F.sum(F.col("take") * F.col("size")).alias("words"), F.sum(F.col("f") * F.col("size")).alias("goal")).collect():
        assert abs(r["n"] - r["f"]) < 1 and abs(r["words"] - r["goal"]) < 0.01 * r["goal"]


def test_ranks(spark):
    df = spark.range(0, 300, 3).repartition(5)
    assert [(r["id"], r["rank"]) for r in ranked(df.withColumn("o", -F.col("id")), "o").orderBy("id").collect()] == [(3 * i, 99 - i) for i in range(100)]
