"""From recognised text to a verdict in one plan: zone search over candidates, the fields of a side, two sides to a merged profile.

Both sides of a card are rows of one table, so every step is planned and run once for all; the only shuffle is on the session, when the sides meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mrz, scores
from . import fusion, linkage
from .extract import structured
from .zone import Stage, parse

#: What an upload may be declared as.
DOC_TYPES = ("id_card", "passport", "auto")
#: Points from which a candidate is good enough to end the search.
ENOUGH = 120


def zone_search(candidates: DataFrame, key: list[str], index: str, first: str, second: str, as_of_year: int = 2026, enough: int = ENOUGH) -> DataFrame:
    """(key, index, score, mrz): of each image the candidate that a search in the order of ``index`` ends with.

    candidates has a row for each part of the image (``sources.boundaries.zone_ratios``) with two readings. The second counts only where
    the first has under two lines and it has more; only candidates with two lines are parsed. The first with ``enough`` points wins, else the first of the
    best; with no record anywhere the first candidate, score -1 and a null record.
    """
    z = Stage(candidates.select(*key, F.col(index).alias("_index"), F.col(first).alias("_first"), F.col(second).alias("_second")))
    z(one=mrz.clean_lines(F.col("_first")))
    z(two=F.when(F.size(z.one) < 2, mrz.clean_lines(F.col("_second"))))
    df = z.done(_lines=F.when((F.size(z.one) < 2) & (F.size(z.two) > F.size(z.one)), z.two).otherwise(z.one))
    readable = parse(df.where(F.size("_lines") >= 2), "_lines", as_of_year)
    scored = readable.select(*key, "_index", mrz.score_candidate(F.col("mrz")).alias("_score"), "mrz")
    none = df.where(F.size("_lines") < 2).select(*key, "_index", F.lit(-1).alias("_score"), F.lit(None).cast(scored.schema["mrz"].dataType).alias("mrz"))
    row = lambda *order: F.struct(*order, F.col("_index").alias("i"), F.col("_score").alias("s"), F.col("mrz").alias("m"))
    good = F.min(F.when(F.col("_score") >= enough, row(F.col("_index").alias("o"))))
    best = F.min(row((-F.col("_score")).alias("o"), F.col("_index").alias("p")))
    out = scored.unionByName(none).groupBy(*key).agg(good.alias("g"), best.alias("b"))
    return out.select(*key, *[F.coalesce(f"g.{a}", f"b.{a}").alias(n) for a, n in (("i", index), ("s", "score"), ("m", "mrz"))])


def read_sides(texts: DataFrame, text: str = "text", as_of_year: int = 2026, lines: str | None = None, doc_type: str = "auto") -> DataFrame:
    """texts with a side's record (``linkage.FIELDS``, detected_side, mrz_format, confidence) from its recognised text.

    The zone is looked for in the text's own lines, or in ``lines`` where another reading of it is there. Extra columns stay, a ``face_detected`` column among them.
    A side declared as a passport or a card is taken for one where the text alone would not tell.
    """
    if doc_type not in DOC_TYPES:
        raise ValueError(f"doc_type must be one of {', '.join(DOC_TYPES)}")
    z = Stage(texts.drop(*[c for c in (*linkage.FIELDS, "detected_side", "mrz_format", "confidence", "mrz", "fields") if c in texts.columns and c not in (text, lines)]))
    z(lines=mrz.clean_lines(F.col(text)) if lines is None else F.col(lines))
    df = structured(parse(z.df, "_z_lines", as_of_year), text).drop("_z_lines")
    z = Stage(df)
    z(fused=fusion.fuse(F.col("fields"), F.col("mrz"), F.col(text)))
    side = fusion.side(F.col("mrz.format"), F.col(text), *[z.fused[n] for n in ("document_number", "surname", "first_name", "patronymic")])
    if doc_type != "auto":
        side = F.when(side == "document", "passport" if doc_type == "passport" else "id_front").otherwise(side)
    z(side=side)
    four = sum((F.when(F.coalesce(z.fused[n], F.lit("")) != "", 1).otherwise(0) for n in ("document_number", "surname", "first_name", "birth_date")), F.lit(0))
    sure = scores.confidence(four, F.col("mrz").isNotNull(), F.lit(""), z.fused["jshshir"])
    patronymic = F.when(z.side != "id_back", z.fused["patronymic"])
    fields = {n: patronymic if n == "patronymic" else z.fused[n] for n in linkage.FIELDS}
    return z.done(**fields, detected_side=z.side, mrz_format=F.col("mrz.format"), confidence=sure).drop("mrz", "fields")


def verified_cards(texts: DataFrame, keys: list[str], text: str = "text", as_of_year: int = 2026, tasks: int | None = None) -> DataFrame:
    """keys and ``merged`` of every session, from rows (keys, upload 0 or 1, text, face_detected): read, told apart, compared and merged. ``tasks``: that many share the sessions."""
    sides = read_sides(texts, text, as_of_year)
    records = sides.select(*keys, "upload", *linkage.FIELDS, "detected_side", "mrz_format", "face_detected", "confidence")
    return linkage.merge(linkage.pair_up(records, keys, tasks=tasks)).select(*keys, "merged")
