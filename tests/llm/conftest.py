import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew green potions under silver moons near old stone bridges".split()


def prose(seed: int, n: int) -> str:
    """n words drawn by a small linear congruence: the same for the same seed, no two seeds alike."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [(0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, "one", "en", "b"), (6, "one", "fr", None), (7, "a b c", "en", "b"), (8, "  \n\t ", "en", "a"), (9, "... 12 !!", "en", "a")]
    out += [(10 + i, prose(50 + i, 40 + 5 * i), "en" if i % 3 else "fr", "ab"[i % 2]) for i in range(30)]
    out += [(40, prose(99, 30_000), "en", "a"), (41, "x" * 20_000, "en", "b")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, copies, ties, and extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    return df.withColumns({"score": F.lit("own"), "size": F.lit(1), "n": F.lit(2), "component": F.lit(3), "label": F.lit("z"), "kept": F.lit(True)}).cache()


@pytest.fixture(scope="session")
def repeated(docs):
    """Each row of the first ten twice."""
    return docs.where("doc_id < 10").union(docs.where("doc_id < 10"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    marks = [(i, i % 2, (i // 2) % 2) for i in range(40)] + [(3, None, None), (None, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int").cache()
