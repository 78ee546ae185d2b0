"""Documents as numbered lines (SRC-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_lines(docs: DataFrame, file: str, text: str) -> DataFrame:
    """file, page and line number from 1, line; blank pages stay as one blank line, a null text is one blank page."""
    pages = docs.select(F.col(file).alias("file"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f", -1)).alias("p", "page_text"))
    x = pages.select("file", (F.col("p") + 1).cast("long").alias("page"), F.posexplode(F.split("page_text", "\n", -1)).alias("l", "line"))
    return x.select("file", "page", (F.col("l") + 1).cast("long").alias("line_no"), "line")
