"""Query of the token files: written for all documents, read back, one digest per document. SQL has no tokenizer; tests compare with the
library and check the exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .repair import read_documents, write_files
from .tokens import default_path


@query("op1_repair_tokens")
def op1_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    written = write_files(table(spark, folder, "documents"), default_path(), end_id=2)
    return read_documents(spark, written, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
