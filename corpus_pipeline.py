"""Corpus pipeline: documents to packed training sequences in five stages, each written as Parquet and read again.

Language identification rejects texts of no learned language, line deduplication rewrites texts, the n-gram Jaccard join keeps the document with the
smallest id of each group of near copies, decontamination removes documents that hold a benchmark item, and packing returns the
pieces of what is left with their places. All stages but the last return the columns of their input; texts that change get a new ``n_chars``.
Rows that repeat both id and text are one document from the near-copy stage on. Everywhere a row is known by its id and its text's hash, so rows
that share an id, or have none, are judged one by one. An empty table gives an empty result, also of packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.common import table, text_or_empty
from boutline.llm.decontam import contaminated
from boutline.llm.jaccard import similar_components
from boutline.llm.langcrf import UNKNOWN, predict
from boutline.llm.linededup import line_dedup
from boutline.llm.packing import pack
from boutline.llm.q_langcrf import trained
from boutline.llm.tokens import default_path
from boutline.session import materialize

LEAST_SCORE = 0.3  # mean posterior below which no language is taken as the text's own


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or without a language that stands out."""
    scored = predict(docs, trained(docs), "text", docs.columns, nested=True)
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; a document that loses all of them stays, with an empty text."""
    kept = line_dedup(docs, docs.columns, nested=True)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _with_row_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), F.struct(*docs.columns).alias("row"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of texts that are 0.8 alike in their shingles of five words: the smallest id, rows without an id last,
    and of rows with one id the smallest hash of the text. Texts without words are alike to none and stay."""
    found = materialize(similar_components(docs, width=5, percent=80, by_row=True))  # read by two branches
    one = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")).alias("o"))
    alone = found.filter(F.col("component").isNull()).select("doc_id", "row_hash")
    stay = one.select("o.doc_id", "o.row_hash").unionAll(alone)
    rows = _with_row_keys(docs)
    return rows.join(stay, rows["id"].eqNullSafe(stay["doc_id"]) & (rows["hash"] == stay["row_hash"]), "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a window like a benchmark item. Other rows of the same id, or without one, are judged by their own texts."""
    hits = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").cast("long").alias("hit_id"), "row_hash").distinct()
    rows = _with_row_keys(docs)
    return rows.join(hits, rows["id"].eqNullSafe(hits["hit_id"]) & (rows["hash"] == hits["row_hash"]), "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 4096 ids."""
    return pack(docs, default_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontaminate),
    ("packing", packing),
]

ORACLE_SQL = None  # SQL has no tokenizer, no fitted model and no search


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
