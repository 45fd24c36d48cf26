"""Boundaries to libraries that are not here: text recognition, face detection, key points. A plug-in or a precomputed column, never a silent stand-in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which the texts of an image's variants are joined.
LANGUAGES = "uzb+rus+eng"
#: Value of key-point consistency where none was computed.
KEYPOINTS_FALLBACK = 0.2
#: Shares of the height at which the zone is searched, for portrait and landscape images.
PORTRAIT_RATIOS = (0.78, 0.76, 0.74, 0.80, 0.72, 0.68, 0.65)
LANDSCAPE_RATIOS = (0.65, 0.58, 0.72, 0.50, 0.78)


class BoundaryMissing(RuntimeError):
    pass


def recognised(df: DataFrame, image: str = "image", text: str = "ocr_text", engine: Callable[[bytes, int, int, int], str] | None = None) -> DataFrame:
    """df with its OCR text: the column if it is there, else ``engine`` (data, height, width, channels to text) in Arrow batches."""
    if text in df.columns:
        return df
    if engine is None:
        raise BoundaryMissing(f"no column {text!r} and no OCR engine was given")

    @F.pandas_udf("string")
    def read(x: pd.DataFrame) -> pd.Series:
        return pd.Series([engine(d, h, w, c) for d, h, w, c in zip(x["data"], x["height"], x["width"], x["nChannels"])])

    return df.withColumn(text, read(F.col(image)))


def detected(df: DataFrame, image: str = "image", boxes: str = "face_boxes", detector: Callable | None = None) -> DataFrame:
    """df with face boxes (array of struct x, y, w, h): the column if it is there, else ``detector``."""
    if boxes in df.columns:
        return df
    if detector is None:
        raise BoundaryMissing(f"no column {boxes!r} and no face detector was given")

    @F.pandas_udf("array<struct<x:int,y:int,w:int,h:int>>")
    def find(x: pd.DataFrame) -> pd.Series:
        return pd.Series([[dict(zip("xywh", b)) for b in detector(d, h, w, c)] for d, h, w, c in zip(x["data"], x["height"], x["width"], x["nChannels"])])

    return df.withColumn(boxes, find(F.col(image)))


def keypoints(column: Column | None) -> Column:
    return F.lit(KEYPOINTS_FALLBACK) if column is None else F.coalesce(column, F.lit(KEYPOINTS_FALLBACK))


def zone_ratios(height: Column, width: Column) -> Column:
    return F.when(height > width, F.array(*[F.lit(r) for r in PORTRAIT_RATIOS])).otherwise(F.array(*[F.lit(r) for r in LANDSCAPE_RATIOS]))


def joined_text(variants: Column) -> Column:
    """array<struct<order, text>> to one text in order, blank ones left out."""
    return F.array_join(F.filter(F.transform(F.array_sort(variants), lambda v: v["text"]), lambda t: F.trim(t) != ""), "\n")
