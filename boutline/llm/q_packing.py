"""Query of best-fit packing over all documents. SQL has no tokenizer and no search; tests check every sequence and the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .packing import pack
from .tokens import default_path


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), default_path(), capacity=4096, end_id=1)
