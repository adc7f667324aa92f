"""Query of language identification over all documents; a fifth of them by the hash of their id is held out of the fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .langcrf import predict, train


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame):
    return train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))


@query("op8_language_crf")
def op8_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), trained(docs), "text", ["doc_id", "held_out"])
