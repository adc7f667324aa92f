"""Query of the n-gram Jaccard join over all documents. SQL would pair all documents; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .jaccard import similar_components


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_components(table(spark, folder, "documents"), width=4, percent=85)
