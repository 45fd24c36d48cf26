"""Scores and verdicts from features, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def present(xs: list[Column]) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def quality(variance: Column, glare: Column, brightness: Column, width: Column, height: Column) -> Column:
    """struct<score, is_acceptable, is_blurry, has_glare, brightness_level, recommendations> of an image's features (glare in percent)."""
    sharp = clamp(variance / 250.0 * 40.0, 0.0, 40.0)
    clear = F.greatest(F.lit(0.0), 30.0 - glare * 10.0)
    exposed = F.when(brightness < 55.0, F.greatest(F.lit(0.0), brightness / 55.0 * 12.0)).when(brightness > 215.0, F.greatest(F.lit(0.0), (255.0 - brightness) / 40.0 * 12.0)).otherwise(F.lit(20.0))
    short, long = F.least(width, height), F.greatest(width, height)
    size = F.when((short < 300) | (long < 450), 4.0).when((short < 600) | (long < 900), 8.0).otherwise(10.0)
    level = F.when(brightness < 55.0, "TOO_DARK").when(brightness > 215.0, "OVEREXPOSED").otherwise("OPTIMAL")
    score = clamp(F.bround(sharp + clear + exposed + size, 1), 0.0, 100.0)
    blurry, glaring = variance < 95.0, glare > 1.2
    accepted = (score >= 60.0) & ~(variance < 50.0)
    advice = present([F.when(blurry, "refocus"), F.when(glaring, "avoid_glare"), F.when(brightness < 55.0, "more_light"), F.when(brightness > 215.0, "less_light"), F.when(size == 4.0, "larger_image")])
    advice = F.when(accepted & (F.size(advice) == 0), F.array(F.lit("excellent"))).otherwise(advice)
    return F.struct(score.alias("score"), accepted.alias("is_acceptable"), blurry.alias("is_blurry"), glaring.alias("has_glare"), level.alias("brightness_level"), advice.alias("recommendations"))


def tampering(patches: Column, noise_ratio: Column, global_std: Column) -> Column:
    """struct<risk_score, risk_level, tampering_detected, flags>."""
    points = F.when(patches > 0, F.least(F.lit(50.0), patches * 12.0)).otherwise(F.lit(0.0)) + F.when(noise_ratio > 3.8, 25.0).otherwise(0.0) + F.when(global_std > 22.0, 15.0).otherwise(0.0)
    score = F.bround(clamp(points, 0.0, 100.0), 1)
    level = F.when(score >= 60.0, "HIGH").when(score >= 30.0, "MEDIUM").otherwise("LOW")
    flags = present([F.when(patches > 0, "anomalous_patches"), F.when(noise_ratio > 3.8, "uneven_noise"), F.when(global_std > 22.0, "high_error_level")])
    return F.struct(score.alias("risk_score"), level.alias("risk_level"), (score >= 30.0).alias("tampering_detected"), flags.alias("flags"))


def face_raw(lbp: Column, structure: Column, keypoints: Column, eyes: Column, mouth: Column) -> Column:
    """Weighted composite, less when eyes or mouth do not correlate."""
    return (lbp * 0.35 + structure * 0.40 + keypoints * 0.25) * F.when(eyes < 0.10, 0.70).otherwise(1.0) * F.when(mouth < 0.10, 0.75).otherwise(1.0)


def face_percent(raw: Column) -> Column:
    """Piecewise calibration of a raw similarity to percent, one decimal."""
    p = F.when(raw <= 0.55, raw / 0.55 * 35.0).when(raw <= 0.72, 35.0 + (raw - 0.55) / 0.17 * 35.0).otherwise(70.0 + (raw - 0.72) / 0.28 * 30.0)
    return F.bround(clamp(p, 0.0, 100.0), 1)


def face_verdict(percent: Column, threshold: float = 72.0) -> Column:
    """struct<verdict, match>: the verdict's limits are fixed, the match follows the caller's threshold (10 to 99)."""
    if not 10 <= threshold <= 99:
        raise ValueError("threshold must be from 10 to 99")
    verdict = F.when(percent >= 72.0, "VERIFIED_MATCH").when(percent >= 55.0, "UNCERTAIN").otherwise("MISMATCH")
    return F.struct(verdict.alias("verdict"), (percent >= threshold).alias("match"))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to 0..1; a zero vector has cosine 0."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return clamp(F.when(norm > 0, product(a, b) / norm).otherwise(F.lit(0.0)), 0.0, 1.0)


def spoof(moire: Column, glare_spots: Column, cr_std: Column, cb_std: Column) -> Column:
    """struct<score, is_spoof, flags>: peak over mean of the spectrum, bright spots, chrominance spread."""
    grid, glass, flat = moire > 4.2, glare_spots >= 2, (cr_std < 5.0) & (cb_std < 5.0)
    score = F.when(grid, 45.0).otherwise(0.0) + F.when(glass, 25.0).otherwise(0.0) + F.when(flat, 30.0).otherwise(0.0)
    flags = present([F.when(grid, "moire"), F.when(glass, "specular"), F.when(flat, "flat_chrominance")])
    return F.struct(score.alias("score"), (score >= 50.0).alias("is_spoof"), flags.alias("flags"))


def challenge(kind: Column, base_found: Column, found: Column, area_ratio: Column, shift: Column, profile: Column, eyes: Column, smiles: Column, strict_blink: bool = False) -> Column:
    """struct<passed, confidence> of one step. A blink passes once a face is there unless strict_blink asks for closed eyes."""
    both = base_found & found
    closer, away = both & (area_ratio >= 1.15), both & (area_ratio <= 0.88)
    turn = profile | (both & (F.abs(shift) > 0.04))
    open_blink = F.lit(False) if strict_blink else found
    passed = F.when(kind == "MOVE_CLOSER", closer).when(kind == "MOVE_AWAY", away).when(kind.startswith("LOOK"), turn).when(kind == "BLINK", (found & (eyes == 0)) | open_blink).when(kind == "SMILE", found & (smiles > 0)).otherwise(F.lit(False))
    sure = F.when(kind == "MOVE_CLOSER", F.least(F.lit(98.0), 70.0 + (area_ratio - 1.15) * 60.0)).when(kind == "MOVE_AWAY", F.least(F.lit(98.0), 70.0 + (0.88 - area_ratio) * 80.0)).when(kind.startswith("LOOK"), F.when(profile, 88.0).otherwise(75.0)).when(kind == "BLINK", F.when(eyes == 0, 85.0).otherwise(70.0)).when(kind == "SMILE", F.lit(88.0))
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(passed.alias("passed"), F.bround(F.when(passed, sure).otherwise(F.lit(0.0)), 1).alias("confidence"))


def confidence(present_fields: Column, has_mrz: Column, status: Column, pinfl: Column) -> Column:
    """Share of four key fields, with floors for what was verified, at most 99."""
    base = present_fields / 4.0 * 90.0
    floor = F.when(has_mrz & status.isin("PASS", "VERIFIED_MATCH"), 98.0).when(has_mrz, 92.0).when(F.coalesce(pinfl, F.lit("")) != "", 88.0).otherwise(0.0)
    return F.bround(F.least(F.greatest(base, floor), F.lit(99.0)), 1)


def match_score(statuses: Column) -> Column:
    """Share of MATCH among MATCH and MISMATCH in percent; 100 if none was evaluated."""
    n = F.size(F.filter(statuses, lambda s: s.isin("MATCH", "MISMATCH")))
    return F.when(n == 0, F.lit(100.0)).otherwise(F.bround(F.size(F.filter(statuses, lambda s: s == "MATCH")) / n * 100.0, 1))
