"""Query of the Lempel-Ziv fingerprints over all documents. SQL cannot parse phrases; tests compare with a plain parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .lzprint import edited_neighbours


@query("op6_lz_fingerprint")
def op6_lz_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return edited_neighbours(table(spark, folder, "documents"))
