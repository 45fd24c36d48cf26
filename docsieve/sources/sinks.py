"""Sinks: JSON with a status, quoted CSV in long form, text, and data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_code(success: Column, problem: Column) -> Column:
    """400 for a refused input, 500 for an error, 200 for a result, else 422. problem: 'invalid', 'error' or null."""
    return F.when(problem == "invalid", 400).when(problem == "error", 500).when(F.coalesce(success, F.lit(False)), 200).otherwise(422)


def responses(df: DataFrame, success: str, problem: str | None = None) -> DataFrame:
    """(status_code, body): each row as JSON."""
    kind = F.col(problem) if problem else F.lit(None).cast("string")
    return df.select(status_code(F.col(success), kind).alias("status_code"), F.to_json(F.struct(*[c for c in df.columns if c != problem])).alias("body"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(long: DataFrame, path: str) -> None:
    """Every value in quotes, quotes doubled."""
    long.write.csv(path, header=True, quoteAll=True, escape='"')


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for v in values])


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.coalesce(column, F.lit("")).alias("value")).write.text(path)


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))
