"""Query of substring deduplication over all documents. SQL would need every substring; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .suffixdedup import remove_repeats


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(table(spark, folder, "documents"), 200, ["doc_id"])
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
