import hashlib
import random

import pyarrow as pa
import pytest

from docsieve.llm import bpe, tokencount

PARTS = ["a", "b", " ", "  ", "\n", "'s", "é", " ", "　", "!", "12", "\t", "the ", "ß", "'", "𝔘", "\x1c", ".", ",", "<|endoftext|>"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("leaf,reach", [(5, 1), (7, 2), (64, 32)])
def test_tree_encodes_as_the_whole_text(leaf, reach):
    t = bpe.Tree(*bpe.vocabulary(), leaf=leaf, reach=reach)
    for x in texts(3000) + ["", "x" * 300, " " * 300, "a" * 50 + " " * 50 + "é" * 80]:
        ids = t.encode(x)
        assert ids == t.codec.encode_ordinary(x) and t.decode(ids) == x.encode()


@pytest.mark.parametrize("kind", ["cjk", "base64", "letters", "marks", "spaces", "mixed"])
def test_tree_encodes_long_texts_without_borders(kind):
    """A million bytes without white space: windows end inside runs, where only pairs of tokens prove them."""
    r = random.Random(11)
    alphabet = {"cjk": "的一是不了人我在有他这中大来上国到说们为子和你地出道也时年得就那要下以生会自着去之过家学", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "letters": "etaoinshrdlu", "marks": "!?.,'#-=", "spaces": " \n\t　", "mixed": "aé7的'. \u0301𝔘"}[kind]
    x = "".join(r.choices(alphabet, k=20_000 if kind == "spaces" else 300_000))
    t = bpe.tree(*bpe.vocabulary())
    assert t.encode(x) == t.codec.encode_ordinary(x)
    for k in range(300):
        y = "".join(r.choices(alphabet, k=r.randint(100, 900)))
        assert t.encode(y) == t.codec.encode_ordinary(y)


def test_most_texts_of_a_corpus_are_joined(spark):
    t = bpe.tree(*bpe.vocabulary())
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        x = row["text"] or ""
        assert t.encode(x) == t.codec.encode_ordinary(x) and t.decode(t.encode(x)) == x.encode()


def test_counts_as_the_library():
    c = tokencount.Counter(tokencount.default_path())
    xs = texts(3000, 5)
    want = [len(c.tokenizer.encode(x, add_special_tokens=False)) for x in xs]
    assert c.splits and c.count(pa.array(xs)).tolist() == want and c.count(pa.array([None, ""])).tolist() == [0, 0]


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 5)
    c = tokencount.Counter(tokencount.default_path())
    xs = texts(200, 9)
    assert c.count(pa.array(xs)).tolist() == [len(c.tokenizer.encode(x, add_special_tokens=False)) for x in xs]


def test_queries(docs, repeated, empty):
    t = bpe.tree(*bpe.vocabulary())
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = r["text"] or ""
        ids = t.codec.encode_ordinary(x)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    c = tokencount.Counter(tokencount.default_path())
    for r in tokencount.counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        n = len(c.tokenizer.encode(r["text"] or "", add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024)
    for run in (bpe.digests, tokencount.counts, bpe.tokenised):
        assert run(repeated).count() == 20 and run(empty).count() == 0
    assert all(r["restored"] for r in bpe.tokenised(docs).collect())
