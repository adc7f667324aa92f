"""Query of the URL filter over all pages. The fitted model has no SQL counterpart; tests compare rules and scores with plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .urlfilter import judge

# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages"), RULES, carry=["page_id"])
