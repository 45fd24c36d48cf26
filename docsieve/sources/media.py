"""Binary inputs: kind by magic bytes, safety checks, images, PDF pages."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: signatures and limits ---
SIGNATURES = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("52494646", "image/webp"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
MAX_BYTES, MAX_PIXELS, MIN_SIDE = 10 * 1024 * 1024, 25_000_000, 100
MAX_PDF_BYTES = 25 * 1024 * 1024
# --- end of fixed values ---


def image_kind(content: Column) -> Column:
    """MIME type by the first bytes; any RIFF file counts as webp, anything else as unknown."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for sign, kind in SIGNATURES:
        test = head.startswith(sign)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def image_rejection(content: Column, length: Column, width: Column, height: Column) -> Column:
    """Why an upload is refused, null if it isn't. Unknown width or height: it could not be decoded."""
    return F.when(F.coalesce(length, F.lit(0)) == 0, "missing").when(length > MAX_BYTES, "too_large").when(image_kind(content) == "unknown", "bad_format").when(width.isNull() | height.isNull(), "undecodable").when(width.cast("long") * height > MAX_PIXELS, "too_many_pixels").when(F.least(width, height) < MIN_SIDE, "too_small")


def pdf_rejection(path: Column, content: Column, length: Column) -> Column:
    return F.when(length > MAX_PDF_BYTES, "too_large").when(~F.lower(path).endswith(".pdf"), "bad_name").when(~F.hex(F.substring(content, 1, 5)).eqNullSafe(F.lit("255044462D")), "bad_format")


def images(spark: SparkSession, path: str) -> DataFrame:
    """``image`` structs of a folder; undecodable files are dropped by the source."""
    return spark.read.format("image").option("dropInvalid", True).load(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def count_pages(content: bytes) -> int:
    """Pages of a PDF whose page objects are not compressed; 0 for anything else."""
    return len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", content)) if content.startswith(b"%PDF-") else 0


def _plugin(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


PAGES = "path string, page_number int, pages int, image binary, error string"


def pages_of(files: DataFrame, max_pages: int = 10, renderer: str | None = None, counter: str | None = None, scale: float = 2.0) -> DataFrame:
    """A row for each page of each file (path, content), rendered in Arrow batches; a file without pages or one that breaks is a row with ``error``.

    renderer ("module:function") takes bytes, page index and scale and gives JPEG bytes, counter ("module:function") bytes to number of pages.
    Without them the pages of plain PDFs are counted and image is null. max_pages: 1 to 20.
    """
    if not 1 <= max_pages <= 20:
        raise ValueError("max_pages must be from 1 to 20")

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            total = (_plugin(counter) or count_pages)(content or b"")
            if not total:
                yield path, None, 0, None, "no pages"
            render = _plugin(renderer)
            for i in range(min(total, max_pages)):
                yield path, i + 1, total, render(content, i, scale) if render else None, None
        except Exception as e:  # a broken file is a row, not a failed job
            yield path, None, None, None, str(e)

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in PAGES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                # one file's pages at a time
                found = list(rows(path.as_py(), content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(read, PAGES)


def pdf_pages(spark: SparkSession, paths: list[str], max_pages: int = 10, **options) -> DataFrame:
    """``pages_of`` the files at these paths, on any file system that Spark reads; a path that isn't there is a row with ``error``."""
    there = [p for p in paths if _exists(spark, p)]
    gone = spark.createDataFrame([(p, None, None, None, "missing") for p in paths if p not in there], PAGES)
    return pages_of(spark.read.format("binaryFile").load(there), max_pages, **options).unionByName(gone) if there else gone
