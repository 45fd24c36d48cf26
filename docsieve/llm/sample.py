"""Bounded training samples. Fitting alone reads a sample of rows, each text whole; every score, count and statistic covers all rows.

Bounds of a sample, all parameters: rows a label (``per_class`` of the operator, about), labels (``MOST_LABELS``, those of most rows, ties in their
order) and bytes of text (``MOST_BYTES``: rows are taken in the order of their dice while they fit; one that alone is larger is passed over).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Settled

MOST_LABELS = 64
MOST_BYTES = 64 << 20


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id has no fold and counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % divisor, F.lit(0))


def _share(rows: DataFrame, per_class: int) -> tuple[DataFrame, int]:
    """About ``per_class`` rows of each label with ``dice``, a hash of doc_id so that reruns agree, and the most that may be read."""
    counts = rows.groupBy("label").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(MOST_LABELS)
    known = [(r["label"], r["rows"]) for r in counts.collect()]
    table = rows.sparkSession.createDataFrame(known, counts.schema)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("dice", dice).join(F.broadcast(table), "label").where(F.col("dice") * F.col("rows") < per_class).drop("rows")
    return drawn, 2 * per_class * len(known)


def _texts(rows: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> list[tuple[str, object]]:
    """The first ``most`` rows by dice, id and text, as far as their bytes go; more rows than that are drawn only where an id stands in many."""
    if not most:
        return []
    drawn = Settled(rows.select("doc_id", "text", "label", "dice", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("bytes")), "drawn")
    order = ["dice", "doc_id", "mark"]
    left, fits = most_bytes, []
    for r in drawn.df.where(F.col("bytes") <= most_bytes).orderBy(*order).limit(most).select(*order, "bytes").collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            fits.append((r["dice"], r["doc_id"], r["mark"]))
    chosen = drawn.df.sparkSession.createDataFrame(fits, "dice double, id long, mark long").distinct()
    same = (drawn.df["dice"] == chosen["dice"]) & drawn.df["doc_id"].eqNullSafe(chosen["id"]) & (drawn.df["mark"] == chosen["mark"])
    found = drawn.df.join(F.broadcast(chosen), same).select(drawn.df["doc_id"], "text", "label").limit(len(fits)).collect() if fits else []
    drawn.drop()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], str(r["label"])))]


def own_labels(docs: DataFrame, per_class: int) -> list[tuple[str, object]]:
    """(text, label) of a sample of docs (doc_id, text, label); at most ``2 * per_class`` rows a label reach the driver."""
    rows, most = _share(docs.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "label"), per_class)
    return _texts(rows, most)


def joined_labels(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held: int, per_class: int) -> list[tuple[str, object]]:
    """As ``own_labels`` with labels of another table, outside the held-out fold. A doc labelled twice has the larger label.

    The sample is drawn from the labels alone, so what is broadcast to the texts is bounded by it (24 bytes a row) and no text is shuffled.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held))
    drawn, most = _share(marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), per_class)
    ids = [(r["doc_id"], r["label"], r["dice"]) for r in drawn.orderBy("dice", "doc_id").limit(most).collect()] if most else []
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, label int, dice double")
    return _texts(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), most)
