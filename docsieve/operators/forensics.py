"""Image to forensic verdict: all features of an image from one decoded raster, in one Arrow pass, and the verdicts as columns over them.

A batch holds few images whatever their size: ``bounded`` limits Arrow batches by bytes, and inside a batch rasters are made one at a time.
An image that is missing or cannot be read has no features and no success; it spoils no row beside it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from . import pixels

QUALITY = ("variance", "glare", "brightness", "contrast")
TAMPERING = ("patches", "noise_ratio", "global_std")
SPOOFING = ("moire", "glare_spots", "cr_std", "cb_std")
#: Bytes of image data in a batch; a larger image makes a batch of its own.
BATCH_BYTES = 32 << 20


def bounded(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of a session that reads images."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def features(image: Column) -> Column:
    """struct of QUALITY, TAMPERING and SPOOFING fields from one decoded raster an image; null fields for an undecodable one."""
    names = (*QUALITY, *TAMPERING, *SPOOFING)

    @F.pandas_udf(pixels._struct(names))
    def run(image: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
            try:
                x = pixels.raster(h, w, c, data)
                if not x.size:
                    raise ValueError("no pixels")
                rows.append(pixels.quality_features(x) | pixels.tamper_features(x) | pixels.spoof_features(x))
            except (ValueError, TypeError):
                rows.append(dict.fromkeys(names))
        return pd.DataFrame(rows, columns=list(names), dtype=float)

    return run(image)


def full_forensics(df: DataFrame, image: str = "image") -> DataFrame:
    """df with ``forensics``: struct<success, error, quality, tampering, spoofing>, each verdict with its features."""
    made = df.withColumn("_f", features(F.col(image)))
    f, there = F.col("_f"), F.col("_f.variance").isNotNull()
    size = lambda n: F.col(f"{image}.{n}")
    error = F.when(F.col(f"{image}.data").isNull() | (F.octet_length(F.col(f"{image}.data")) == 0), "empty").when(~there, "undecodable")
    quality = scores.quality(f["variance"], f["glare"], f["brightness"], size("width"), size("height"))
    judged = {"quality": (quality, QUALITY), "tampering": (scores.tampering(f["patches"], f["noise_ratio"], f["global_std"]), TAMPERING), "spoofing": (scores.spoof(f["moire"], f["glare_spots"], f["cr_std"], f["cb_std"]), SPOOFING)}
    parts = [F.when(there, F.struct(verdict.alias("verdict"), F.struct(*[f[n].alias(n) for n in names]).alias("features"))).alias(part) for part, (verdict, names) in judged.items()]
    return made.withColumn("forensics", F.struct(there.alias("success"), error.alias("error"), *parts)).drop("_f")
