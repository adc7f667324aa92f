"""Query of main-text extraction over all pages. SQL has no HTML parser; tests compare with worked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .tagpath import extract


@query("op9_html_text")
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"), "html", ["page_id", "url"])
