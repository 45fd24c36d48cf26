"""From two images to a match: portrait and selfie are cut by their face boxes, described and compared in one Arrow pass, and judged as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.boundaries import keypoints as known_keypoints
from . import pixels
from .liveness import best_face, framed, kyc

MEASURES = ("lbp", *pixels.REGIONS, "structure")


def _cut(image: dict, box: dict | None) -> np.ndarray | None:
    """The equalised face inside the box, of the whole image without one; None where there are no pixels."""
    try:
        x = pixels.raster(image["height"], image["width"], image["nChannels"], image["data"])
        if box is not None and not pd.isna(box["w"]):
            left, top = max(0, int(box["x"])), max(0, int(box["y"]))
            x = x[top : int(box["y"]) + int(box["h"]), left : int(box["x"]) + int(box["w"])]
        return pixels.equalised(pixels.resize(pixels.gray(x), pixels.FACE_SIDE, pixels.FACE_SIDE)) if x.size else None
    except (TypeError, ValueError):
        return None


def likeness(portrait: Column, portrait_box: Column, selfie: Column, selfie_box: Column) -> Column:
    """struct of MEASURES: cosine of the pattern histograms, and the correlation of each region; null fields where one of the faces has no pixels."""

    @F.pandas_udf(pixels._struct(MEASURES))
    def run(a: pd.DataFrame, p: pd.DataFrame, b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for one, r, two, s in zip(*(x.to_dict("records") for x in (a, p, b, q))):
            faces = _cut(one, r), _cut(two, s)
            if any(f is None for f in faces):
                rows.append(dict.fromkeys(MEASURES))
                continue
            x, y = (pixels.descriptor(f) for f in faces)
            rows.append({"lbp": float(np.clip(x @ y, 0, 1))} | pixels.regional_similarity(*faces))
        return pd.DataFrame(rows, columns=list(MEASURES), dtype=float)

    return run(portrait, portrait_box, selfie, selfie_box)


def compared(df: DataFrame, portrait: str, selfie: str, portrait_boxes: str, selfie_boxes: str, keypoints: str | None = None, threshold: float = 72.0) -> DataFrame:
    """df with ``face``: struct<similarity, verdict, match, has_portrait, has_selfie>, from two images and their detected boxes (array of struct x, y, w, h).

    The best box of each image is the face; without one there is no face, and no match. A selfie that touches an edge and covers over 35 percent is rejected. Key
    points are a column of the caller's, or their fallback.
    """
    size = lambda image, n: F.col(f"{image}.{n}")
    made = df.withColumns({"_p": best_face(F.col(portrait_boxes), size(portrait, "width")), "_s": best_face(F.col(selfie_boxes), size(selfie, "width"))})
    made = made.withColumn("_f", likeness(F.col(portrait), F.col("_p"), F.col(selfie), F.col("_s")))
    frame = framed(F.col("_s"), size(selfie, "width"), size(selfie, "height"))
    share = F.col("_s.w") * F.col("_s.h") / (size(selfie, "width") * size(selfie, "height"))
    ready = made.withColumns({n: F.col(f"_f.{n}") for n in ("lbp", "structure", "eyes", "mouth")} | {"keypoints": known_keypoints(F.col(keypoints) if keypoints else None), "selfie_coverage": share, "selfie_cut_off": frame["is_cut_off"]})
    has = {n: F.col(c).isNotNull() & F.col("_f.lbp").isNotNull() for n, c in (("has_portrait", "_p"), ("has_selfie", "_s"))}
    both = has["has_portrait"] & has["has_selfie"]
    told = kyc(ready, threshold).withColumn("_told", F.col("face"))
    r = F.col("_told")
    judged = F.struct(F.when(both, r["similarity"]).alias("similarity"), F.when(both, r["verdict"]).otherwise("NO_FACE").alias("verdict"), (both & F.coalesce(r["match"], F.lit(False))).alias("match"), *[v.alias(n) for n, v in has.items()])
    return told.withColumn("face", judged).select(*df.columns, "face")
