import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import bytecnn, kneserney, nbsvm, registry, xent

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return docs, marks


def test_language_held_out(spark, truth):
    got = registry.op1_language_id(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and 150 < len(held) < 350
    assert np.mean([r["lang_pred"] == truth[0][r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_held_out(spark, truth):
    got = [r for r in registry.op9_quality(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth[1]]
    right = [r["predicted"] == truth[1][r["doc_id"]]["quality"] for r in got]
    assert np.mean(right) > 0.9


def test_toxicity_held_out(spark, truth):
    got = [r for r in registry.op4_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth[1]]
    toxic = [r["score"] for r in got if truth[1][r["doc_id"]]["toxic"] == 1]
    plain = [r["score"] for r in got if truth[1][r["doc_id"]]["toxic"] == 0]
    # the small table has some thirty toxic rows to learn from
    assert np.mean([a > b for a in toxic for b in plain]) > 0.7 and np.mean([x >= 0.7 for x in plain]) < 0.1


def test_defined_cases(docs, labels, repeated, empty):
    by = {r["doc_id"]: r for r in bytecnn.predict(docs).collect()}
    assert len(by) == 42 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 8, 9))
    assert by[0]["lang_pred"] == by[1]["lang_pred"] and by[0]["score"] == by[1]["score"] and by[40]["lang_pred"] != "und"
    for run in (lambda d: nbsvm.classify(d, labels), lambda d: kneserney.classify(d, labels), lambda d: xent.differences(d, labels)):
        got = {r["doc_id"]: r for r in run(docs).collect()}
        assert len(got) == 42 and got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"] is not None
        assert run(repeated).count() == 20 and run(empty).count() == 0
    assert bytecnn.predict(empty).count() == 0 and nbsvm.keep_good(docs, docs, labels).columns == docs.columns


def test_no_labels(docs, labels):
    none = labels.where("false")
    assert {r["score"] for r in nbsvm.classify(docs, none).collect()} == {0.5} == {r["score"] for r in kneserney.classify(docs, none).collect()}
    assert {r["lang_pred"] for r in bytecnn.predict(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false").unionByName(docs.drop("lang").selectExpr("*", "cast(null as string) lang").select(*docs.columns))).collect()} == {"und"}


def test_samples_are_bounded(spark, monkeypatch):
    """Thousands of labels: those of most rows are learnt. Texts beyond the bytes: the first by dice that fit, the same in each run."""
    from docsieve.llm import sample

    rows = [(i, f"text {i} " + "x" * (i % 50), "en" if i % 3 else f"dirty{i:05d}") for i in range(15_000)]
    df = spark.createDataFrame(rows + [(20_000, "y" * 5000, "en")], "doc_id long, text string, label string").repartition(5)
    got = sample.own_labels(df, 300)
    by = {y: sum(1 for _, z in got if z == y) for _, y in got}
    assert len(by) <= sample.MOST_LABELS and 200 < by["en"] < 400 and "dirty00000" in by and "dirty14997" not in by
    bounded, most = sample._share(df, 300)
    few = sample._texts(bounded, most, 4000)
    assert few == sample._texts(bounded.repartition(3), most, 4000) and 0 < sum(len(t) for t, _ in few) <= 4000 and max(len(t) for t, _ in few) < 100
    net = bytecnn.train(df.withColumnRenamed("label", "lang"))
    assert len(net.languages) <= sample.MOST_LABELS and "en" in net.languages


def test_toxicity_probabilities_as_brute_force():
    """A plain Python count of both models; after each word the probabilities of all words and of one not seen sum to 1."""
    from collections import Counter
    from math import exp, log

    from docsieve.llm import flat

    texts = [("you are a fool and a liar", 1), ("a fool you are", 1), ("the fool and the liar", 1), ("a fool", 1), ("you are a friend and a guest", 0), ("the guest and the friend", 0), ("a friend you are", 0), ("the river and the hill", 0), ("you are a fool", 0)]
    model = kneserney.count_models(texts, discount=1.0)
    n, words = [Counter(), Counter()], sorted({w for t, _ in texts for w in t.split()})
    for t, y in texts:
        w = ["", *t.split()]
        for p in set(zip(w, w[1:])):
            n[y][p] += 1
    pairs = sorted(set(n[0]) | set(n[1]))
    heads = {v for v, _ in pairs}
    after = [{v: sum(c[p] for p in c if p[0] == v) for v in heads} for c in n]

    def weight(k, total, tilt, sure):
        ratio = (log(k[1] / total[1]) if k[1] else -1e9) - (log(k[0] / total[0]) if k[0] else -1e9)
        null = exp(min(max(ratio, tilt - log(kneserney.FACTOR)), tilt + log(kneserney.FACTOR))) * total[1] / total[0]
        share = [1 / (1 + null), null / (1 + null)]
        g = 2 * sum(x * log(x / sum(k) / s) for x, s in zip(k, share) if x)
        return 1 / (1 + exp((sure - g) / 2))

    contexts = [{w: sum((v, w) in c for v in heads) for w in words} for c in n]
    total = [sum(c.values()) for c in contexts]
    took = {w: sum(min(c[w], 1) for c in contexts) for w in words}
    all_took, lower = sum(took.values()), [{}, {}]
    for w in words:
        k, shared = [c[w] for c in contexts], took[w] / (all_took + 1)
        own = [(k[c] - min(k[c], 1)) / total[c] + sum(min(x, 1) for x in contexts[c].values()) / total[c] * shared for c in (0, 1)]
        both = (sum(max(x - 1, 0) for x in k) + all_took * shared) / sum(total)
        a = weight(k, total, 0.0, kneserney.SURE)
        for c in (0, 1):
            lower[c][w] = a * own[c] + (1 - a) * both
    unseen = all_took / (all_took + 1) / sum(total)
    whole = [sum(lower[c].values()) + unseen for c in (0, 1)]
    lower = [{w: p / whole[c] for w, p in lower[c].items()} for c in (0, 1)]
    gain = [{}, {}]
    for v, w in pairs:
        k = [c[v, w] for c in n]
        mean = sum(lower[c][w] * total[c] for c in (0, 1)) / sum(total)
        a = weight(k, [max(after[c][v], 0.5) for c in (0, 1)], log(lower[1][w] / lower[0][w]), 2 * log(len(pairs)))
        for c in (0, 1):
            own = max(k[c] - 1, 0) / max(after[c][v], 1)
            gain[c][v, w] = a * own + (1 - a) * max(sum(k) - 2, 0) / (after[0][v] + after[1][v]) * lower[c][w] / mean
    data, offsets = flat.flat(pa.array([" ".join([v, w]).strip() for v in sorted(heads) for w in [*words, "unheard"]]))
    pair, before, word, first = kneserney._events(data, offsets)
    got = model.probabilities(pair, before, word)[:, first[1:] - 1].reshape(2, len(heads), -1)
    assert np.allclose(got.sum(axis=2), 1)
    for i, v in enumerate(sorted(heads)):
        for c in (0, 1):
            left = 1 - sum(p for (x, _), p in gain[c].items() if x == v)
            want = [gain[c].get((v, w), 0) + left * lower[c][w] for w in words]
            assert np.allclose(got[c, i, :-1], want)


def test_language_as_a_plain_forward_pass():
    """Windows, filters, maxima and softmax one by one."""
    rows = [("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de"), ("el perro y la gata", "es")]
    net = bytecnn.fit(rows, steps=30, batch=16)
    texts = ["The dog", "und die Katze " * 60, "x", "la gata y el perro " * 30]
    lang, score = net.predict(pa.array(texts))
    for k, t in enumerate(texts):
        raw, step = t.lower().encode(), bytecnn.WINDOW - bytecnn.OVERLAP
        total, size = 0.0, 0
        for s in range(0, len(raw), step):
            window = raw[s : s + bytecnn.WINDOW].ljust(bytecnn.WINDOW, b"\0")
            best = np.full(net.bias.shape, -np.inf)
            for at in range(step):
                seen = np.concatenate([net.embed[b] for b in window[at : at + max(bytecnn.WIDTHS)]])
                best = np.maximum(best, seen @ net.kernel)
            z = np.maximum(best + net.bias, 0) @ net.dense + net.shift
            z = z - z.max() - np.log(np.exp(z - z.max()).sum())
            n = min(step, len(raw) - s)
            total, size = total + n * z, size + n
        p = np.exp(total / size)
        assert lang[k] == p.argmax() and abs(score[k] - p.max() / p.sum()) < 1e-4


def test_quality_margin_as_a_plain_sum():
    """The fitted weights over the set of a text's n-grams, by plain sets."""
    from docsieve.llm import flat

    rows = [(f"good plain words number {i} stand here", 1) for i in range(30)] + [(f"## BUY {i} $$ NOW $$ {i}", 0) for i in range(30)]
    model = nbsvm.fit(rows)
    data, offsets = flat.flat(pa.array([t for t, _ in rows] + [""]))
    margins = model.margins(data, offsets)
    for i, parts in enumerate(nbsvm.grams(data, offsets)):
        kinds = sorted({int(b) for p in parts for b in p})
        weight, square = model.table[kinds].astype(float).sum(axis=0) if kinds else (0.0, 0.0)
        assert abs(margins[i] - (weight / square**0.5 if square else 0.0)) < 1e-5
    assert (margins[:30] > margins[30:60].max()).all() and margins[60] == 0


def test_windows_cover_whole_texts():
    data = np.arange(1, 1000, dtype=np.int64).astype(np.uint8)
    row, start, stop, size = bytecnn.windows(np.array([0, 0, 5, 999]))
    assert size.sum() == 999 and stop[-1] == 999 and set(row) == {1, 2}
    assert (bytecnn.cut(data, start, stop)[0, 5:] == 0).all()


def test_word_models_as_brute_force(spark, monkeypatch):
    """Losses as counted by plain Python over several blocks; texts that differ in case, digits, punctuation or script only are apart."""
    import collections
    import math

    monkeypatch.setattr(xent, "BLOCK", 40)
    texts = ["Pay 12 now!", "pay 34 now?", "\u043c\u0438\u0440 \u0434\u043e\u043c", "\u0434\u043e\u043c \u043c\u0438\u0440", "a b a b a", "a b", None, " "] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, 1, 0) for i in (0, 2, 5)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    runs = [["<s>", *(t or "").split(), "</s>"] if (t or "").split() else [] for t in texts]
    models = []
    for some in ([runs[i] for i in (0, 2, 5)], runs):
        models.append((collections.Counter(p for r in some for p in zip(r, r[1:])), collections.Counter(w for r in some for w in r)))
    vocabulary = len({w for r in runs for w in r} - {"<s>"})
    got = {r["doc_id"]: r for r in xent.differences(df, marks).collect()}
    assert len(got) == len(texts)
    for i, r in enumerate(runs):
        want = []
        for pairs, words in models:
            total = sum(n for w, n in words.items() if w != "<s>")
            lower = lambda w: (words[w] + xent.PRIOR / vocabulary) / (total + xent.PRIOR)
            bits = [-math.log2((pairs[a, b] + xent.PRIOR * lower(b)) / (words[a] + xent.PRIOR)) for a, b in zip(r, r[1:])]
            want.append(sum(bits) / max(len(bits), 1))
        # the background less the document itself
        own_pairs, own_words = collections.Counter(zip(r, r[1:])), collections.Counter(r)
        lower = lambda w: (words[w] - own_words[w] + xent.PRIOR / vocabulary) / (total - max(len(r) - 1, 0) + xent.PRIOR)
        bits = [-math.log2((pairs[a, b] - own_pairs[a, b] + xent.PRIOR * lower(b)) / (words[a] - own_words[a] + xent.PRIOR)) for a, b in zip(r, r[1:])]
        want.append(sum(bits) / max(len(bits), 1))
        assert np.allclose([got[i]["loss_target"], got[i]["loss_background"], got[i]["loss_rest"]], want) and got[i]["n_scored"] == max(len(r) - 1, 0)
    # each context's probabilities sum to 1
    pairs, words = models[1]
    total = sum(n for w, n in words.items() if w != "<s>")
    kinds = [w for w in words if w != "<s>"]
    for a in ("a", "<s>"):
        n = [np.array(x, float) for x in zip(*((pairs[a, w], words[a], words[w]) for w in kinds))]
        assert abs((2.0 ** -xent.losses(*n, total, vocabulary)).sum() - 1) < 1e-9
    assert got[0]["score"] < got[1]["score"] and got[2]["score"] < got[3]["score"]


def test_blocks_are_bounded_in_rows(spark, monkeypatch):
    """Texts without bytes fill blocks by their number."""
    monkeypatch.setattr(xent, "BLOCK_ROWS", 7)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": [None, "", " "] * 10, "target": [False] * 30})
    assert [b.column(1).to_pylist()[0] for b in xent._blocks(iter([batch]))] == [list(range(i, min(i + 7, 30))) for i in range(0, 30, 7)]
    df = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(40)], "doc_id long, text string")
    got = xent.differences(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 40 and {r["score"] for r in got} == {0.0}


def test_operators_leave_their_result_alone(spark, docs, labels):
    """Of the tables that an operator writes only its result stays."""
    import os

    from docsieve.llm import jumphash, mixing, simhash, store

    root = store.shared_dir(spark)
    for run in (lambda: jumphash.sharded(docs), lambda: mixing.mix(docs), lambda: simhash.edited(docs), lambda: xent.differences(docs, labels)):
        before = set(os.listdir(root))
        assert run().count() == 42
        assert len(set(os.listdir(root)) - before) == 1
