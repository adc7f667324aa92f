"""Query of benchmark decontamination: all documents against all benchmark items. Windows and fingerprints have no practical SQL
text; tests compare with brute force over every window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .decontam import contaminated


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
