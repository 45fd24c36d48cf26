"""The stages row by row against plain Python over each one's own input, and the whole run on odd tables."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsieve.llm import bpe, bytecnn, nbsvm

from .test_dedup import brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """The documents and labels of the small table, beside nulls, repeated rows, null ids, an id with two texts, and columns with clashing names."""
    at = str(tmp_path_factory.mktemp("odd"))
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source")
    some = base.where("doc_id < 8")
    again = some.unionByName(some.where("doc_id < 4")).unionByName(some.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    other = some.where("doc_id = 5").withColumn("doc_id", F.lit(6).cast("long"))
    clash = {"score": F.lit("own"), "label": F.lit("z"), "copies": F.lit(None).cast("int"), "kept": F.lit(1), "size": F.lit("s"), "id": F.lit(7)}
    base.unionByName(more).unionByName(again).unionByName(other).withColumns(clash).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def made(spark, odd, tmp_path_factory):
    """The rows of documents and of each stage, the next one's input."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    tables = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, odd).write.parquet(path)
        docs = tables[name] = spark.read.parquet(path)
    return {name: [r.asDict() for r in df.collect()] for name, df in tables.items()}


def bag(rows):
    return collections.Counter(repr(sorted(r.items())) for r in rows)


def test_quality_keeps_what_the_model_scores(spark, odd, made):
    """Scores by loops over a text's n-grams, from the weights of the same training."""
    from docsieve.llm import flat

    labels = spark.read.parquet(f"{odd}/labels.parquet")
    model = nbsvm.train(spark.read.parquet(f"{odd}/documents.parquet"), labels)

    def plain(text):
        data, offsets = flat.flat(pa.array([text or ""]))
        found = {int(g) for parts in nbsvm.grams(data, offsets) for p in parts for g in p}
        total, square = (sum(float(model.table[g][i]) for g in found) for i in (0, 1))
        margin = total / square**0.5 if square > 0 else 0.0
        return 1 / (1 + np.exp(-(model.slope * margin + model.shift)))

    want = [r for r in made["documents"] if plain(r["text"]) >= nbsvm.THRESHOLD]
    assert bag(made["quality"]) == bag(want) and 0 < len(want) < len(made["documents"])


def test_language_keeps_what_is_sure(spark, odd, made):
    net = bytecnn.train(spark.createDataFrame(made["quality"], spark.read.parquet(f"{odd}/documents.parquet").schema))

    def plain(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return 0.0
        data = np.frombuffer(text.encode(), np.uint8)
        row, start, stop, size = bytecnn.windows(np.array([0, len(data)]))
        total = sum(net.log_probs(bytecnn.cut(data, start[i : i + 1], stop[i : i + 1]))[0] * size[i] for i in range(len(row))) / size.sum()
        return float(1 / np.exp(total - total.max()).sum())

    sure = {r["text"]: plain(r["text"]) for r in made["quality"]}
    assert bag(made["language"]) == bag([r for r in made["quality"] if sure[r["text"]] >= bytecnn.LEAST])


def test_dedup_keeps_one_of_each_group(made):
    rows = made["language"]
    named = {}
    for r in rows:
        if r["doc_id"] is not None:
            named.setdefault((r["doc_id"], r["text"] or ""), r)
    # the documents of an id in the order of the ids, as ties go to any of its texts
    groups = brute([(key, key[1]) for key in named], 5)
    kept = [r for r in made["dedup"] if r["doc_id"] is not None]
    of = collections.Counter(groups[r["doc_id"], r["text"] or ""][1] for r in kept)
    assert set(of) == {g for _, g in groups.values()} and set(of.values()) == {1}
    least = {g: min(k[0] for k in groups if groups[k][1] == g) for g in of}
    assert all(r["doc_id"] == least[groups[r["doc_id"], r["text"] or ""][1]] for r in kept)
    assert bag(r for r in made["dedup"] if r["doc_id"] is None) == bag(r for r in rows if r["doc_id"] is None)


def test_mixing_takes_rows_whole(made):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    there, taken = bag(made["dedup"]), bag(made["mixing"])
    assert set(taken) <= set(there) and all(n <= 3 * there[k] for k, n in taken.items())
    total, mixed = collections.Counter(), collections.Counter()
    for r in made["dedup"]:
        total[r["source"]] += size(r)
    for r in made["mixing"]:
        mixed[r["source"]] += size(r)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in weight if level * weight[s] > 3 * total[s]}
        if more == full:
            break
        full = more
    largest = max(map(size, made["dedup"]))
    assert all(abs(mixed[s] - min(level * weight[s], 3 * total[s])) <= 3 * largest for s in total)


def test_encoding_as_the_whole_text(made):
    tree = bpe.Tree(*bpe.vocabulary())
    want = collections.Counter()
    for r in made["mixing"]:
        want[r["doc_id"], tuple(tree.codec.encode_ordinary(r["text"] or ""))] += 1
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in made["encoding"]) == want
    assert all(r["restored"] and r["n_tokens"] == len(r["ids"]) for r in made["encoding"])


def test_columns_and_order(made):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "dedup", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    for name in names[:-1]:
        assert set(made[name][0]) == set(made["documents"][0])
    counts = [len(made[n]) for n in ["documents", *names]]
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[4] == counts[5]


def test_run_is_its_stages(spark, odd, made):
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, odd).collect())
    assert got == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in made["encoding"])


def test_run_on_an_empty_table(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
