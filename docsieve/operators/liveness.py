"""Liveness sessions from frames, patch outliers, candidate and box ranking, rate windows, stability of a frame sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores


def movements(frames: DataFrame, session: list[str], idx: str = "idx", area: str = "area", center: str = "center", width: str = "width") -> DataFrame:
    """Action frames (idx > 0) beside their session's baseline: area_ratio and shift. One shuffle on the session, no self-join."""
    base = Window.partitionBy(*session)
    first = lambda c: F.max(F.when(F.col(idx) == 0, F.col(c))).over(base)
    wide = frames.withColumns({"base_area": first(area), "base_center": first(center)})
    ratio = F.when(F.col("base_area").isNotNull(), F.col(area) / (F.col("base_area") + 1e-4))
    return wide.where(F.col(idx) > 0).withColumns({"area_ratio": ratio, "shift": (F.col(center) - F.col("base_center")) / F.col(width)}).drop("base_area", "base_center")


def movement(area_ratio: Column) -> Column:
    return F.when(area_ratio >= 1.15, "closer").when(area_ratio <= 0.88, "away").otherwise("neither")


def composite(active: Column, rated: Column, spoof_score: Column) -> Column:
    """60 percent of the mean of ``rated`` confidences with the sum ``active``, 40 percent of what the spoof score leaves; to tenths, halves to the even one.

    Decimals throughout: ten times the score as a fraction of whole hundredths over the number of steps, 6 * active / rated + 4 * (100 - spoof).
    """
    rated = F.greatest(rated, F.lit(1))
    over = ((6 * active + rated * 4 * F.greatest(100 - spoof_score.cast("decimal(9,2)"), F.lit(0))) * 100).cast("long")
    under = rated * 100
    tenths = F.floor(over / under)
    rest = 2 * (over - tenths * under)
    return (tenths + F.when((rest > under) | ((rest == under) & (tenths % 2 == 1)), 1).otherwise(0)) / 10


def sessions(steps: DataFrame, session: list[str]) -> DataFrame:
    """verdict, is_live and score of each session from its steps (passed, confidence), its baseline's spoof score and number of frames.

    Too few frames, then a spoof, decide before the steps do. Scores are exact decimals, halves go to the even tenth, so a tie has one result.
    """
    out = steps.groupBy(*session).agg(F.count("passed").alias("n_steps"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"), F.coalesce(F.sum(F.col("confidence").cast("decimal(9,2)")), F.lit(0).cast("decimal(9,2)")).alias("active"), F.count("confidence").alias("rated"), F.max("spoof_score").alias("spoof_score"), F.max("frames").alias("frames"))
    score = composite(F.col("active"), F.greatest(F.col("rated"), F.lit(1)), F.col("spoof_score"))
    few, spoofed = F.col("frames") < 2, F.col("spoof_score") >= 50.0
    live = ~few & ~spoofed & F.col("all_passed") & (score >= 65.0)
    verdict = F.when(few, "INSUFFICIENT_FRAMES").when(spoofed, "SPOOF_ATTACK_DETECTED").when(live, "LIVE_AUTHENTIC").otherwise("CHALLENGE_FAILED")
    return out.select(*session, "n_steps", "all_passed", F.when(few | spoofed, 0.0).otherwise(score).alias("liveness_score"), live.alias("is_live"), verdict.alias("verdict"))


def outlier_patches(patches: DataFrame, image: list[str], mean: str = "mean") -> DataFrame:
    """For each image the patches whose mean exceeds its own mean by max(12, 2.2 sigma); at least two are an anomaly."""
    w = Window.partitionBy(*image)
    limit = F.avg(mean).over(w) + F.greatest(F.lit(12.0), 2.2 * F.stddev_pop(mean).over(w))
    marked = patches.select(*image, (F.col(mean) > limit).cast("int").alias("out"))
    return marked.groupBy(*image).agg(F.sum("out").cast("long").alias("suspicious_patches"), (F.sum("out") >= 2).alias("anomaly"))


def best_face(candidates: Column, width: Column) -> Column:
    """Of struct<x, y, w, h> boxes the portrait: area by closeness to aspect 1.25, with a bonus in the left 55 percent; of equals the first."""
    aspect = lambda b: 1.0 - F.least(F.abs(b["h"] / b["w"] - 1.25), F.lit(1.0))
    bonus = lambda b: F.when(b["x"] + b["w"] / 2.0 < width * 0.55, 1.2).otherwise(1.0)
    ranked = F.transform(F.filter(candidates, lambda b: b["w"] > 0), lambda b, i: F.struct((b["w"] * b["h"] * aspect(b) * bonus(b)).alias("s"), (-i).alias("i"), b.alias("b")))
    return F.array_max(ranked)["b"]


def framed(box: Column, width: Column, height: Column, pad: float = 0.15) -> Column:
    """struct<box, is_cut_off, is_well_framed>: the box padded inside the image, and whether the face touches an edge or fills too little or much."""
    pw, ph = (box["w"] * pad).cast("int"), (box["h"] * (pad + 0.05)).cast("int")
    x1, y1 = F.greatest(F.lit(0), box["x"] - pw), F.greatest(F.lit(0), box["y"] - ph)
    x2, y2 = F.least(width, box["x"] + box["w"] + pw), F.least(height, box["y"] + box["h"] + ph)
    cut = (box["x"] <= 4) | (box["y"] <= 4) | (box["x"] + box["w"] >= width - 4) | (box["y"] + box["h"] >= height - 4)
    share = box["w"] * box["h"] / (width * height)
    return F.struct(F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")).alias("box"), cut.alias("is_cut_off"), (~cut & share.between(0.05, 0.85)).alias("is_well_framed"))


def best_candidate(candidates: DataFrame, key: list[str], index: str, score: str, enough: int = 120) -> DataFrame:
    """The first candidate with enough points, else the first of the best: what stopping early at a good one gives."""
    found = F.min(F.when(F.col(score) >= enough, F.struct(F.col(index).alias("i"), F.col(score).alias("s"))))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i")))
    out = candidates.groupBy(*key).agg(found.alias("f"), best.alias("b"))
    return out.select(*key, F.coalesce("f.i", -F.col("b.i")).alias(index), F.coalesce("f.s", "b.s").alias(score))


def rate_windows(events: DataFrame, key: str, at: str, width: str, limit: int) -> DataFrame:
    """Requests of each key in tumbling windows, and whether they exceed the limit."""
    out = events.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("throttled"))


def stability(frames: Column, fire_at: int = 18) -> Column:
    """struct<counter, fired>: fold over struct<present, stable> in order: +1 if both, -1 (not under 0) if present only, else back to 0; fired once it reached ``fire_at``."""
    start = F.struct(F.lit(0).alias("counter"), F.lit(False).alias("fired"))

    def step(s, f):
        n = F.when(f["present"] & f["stable"], s["counter"] + 1).when(f["present"], F.greatest(F.lit(0), s["counter"] - 1)).otherwise(F.lit(0))
        return F.struct(n.alias("counter"), (s["fired"] | (n >= fire_at)).alias("fired"))

    return F.aggregate(frames, start, step)


def present_and_stable(contrast: Column, mean: Column, difference: Column) -> Column:
    """struct<present, stable> of a camera frame: contrast over 65 and mean luma between 45 and 225; mean difference to the last frame under 7."""
    return F.struct(((contrast > 65) & (mean > 45) & (mean < 225)).alias("present"), (difference < 7.0).alias("stable"))


def page_confidence(pages: DataFrame, key: str, confidence: str) -> DataFrame:
    return pages.groupBy(key).agg(F.bround(F.avg(confidence), 1).alias("confidence"))


def kyc(pairs: DataFrame, threshold: float = 72.0) -> DataFrame:
    """pairs (lbp, structure, keypoints, eyes, mouth, selfie_coverage, selfie_cut_off) with ``face``: a cut-off selfie that covers over 35 percent is rejected before scores count."""
    percent = scores.face_percent(scores.face_raw(*[F.col(c) for c in ("lbp", "structure", "keypoints", "eyes", "mouth")]))
    verdict = scores.face_verdict(percent, threshold)
    cut = F.col("selfie_cut_off") & (F.col("selfie_coverage") > 0.35)
    return pairs.withColumn("face", F.struct(F.when(cut, 0.0).otherwise(percent).alias("similarity"), F.when(cut, "SELFIE_CUT_OFF").otherwise(verdict["verdict"]).alias("verdict"), (~cut & verdict["match"]).alias("match")))
