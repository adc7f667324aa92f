"""Writers for histories, split runs and metric documents. Everything is written by executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_history(hist: DataFrame, path: str, fmt: str = "csv") -> None:
    """Rating history as CSV or Parquet with a header; many files for a large table."""
    w = hist.write.mode("error")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def finite(c) -> Column:
    """Number for a document: not-a-number and infinities become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def metric_document(run: Column, summary: Column, calibration: DataFrame, breakdown: DataFrame, key: str = "candidate_id", base: DataFrame | None = None) -> DataFrame:
    """Nested document per key: run info, summary, calibration curve and breakdowns (tens of rows per key)."""
    curve = calibration.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "n", finite("mean_prob").alias("mean_prob"), finite("win_rate").alias("win_rate")))).alias("calibration"))
    parts = breakdown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dimension", "bucket", "n", finite("accuracy").alias("accuracy")))).alias("breakdowns"))
    joined = base.join(curve, key, "left").join(parts, key, "left")
    body = F.struct(run.alias("run"), summary.alias("summary"), "calibration", "breakdowns")
    return joined.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_documents(docs: DataFrame, path: str, partition: str | None = None) -> None:
    w = docs.write.mode("error")
    (w.partitionBy(partition) if partition else w).json(path)


def write_split_run(folder: str, best: DataFrame, per_split: DataFrame, evolution: DataFrame, consolidated: DataFrame) -> None:
    """Best parameters as JSON; per-split ROI, evolution and the consolidated table as CSV."""
    best.write.mode("error").json(f"{folder}/best_params")
    for name, df in (("per_split_roi", per_split), ("evolution", evolution), ("consolidated", consolidated)):
        df.write.mode("error").option("header", True).csv(f"{folder}/{name}")


def write_run(folder: str, docs: DataFrame, master: DataFrame) -> None:
    """Documents by configuration, then the master file. The master comes last: a folder without one is an unfinished run."""
    write_documents(docs, f"{folder}/documents", "config")
    master.coalesce(1).write.mode("error").text(f"{folder}/master")


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents (config, candidate_id, document) and the master document of a finished run; an unfinished one raises."""
    master = spark.read.text(f"{folder}/master").withColumnRenamed("value", "document")
    return spark.read.schema("candidate_id int, document string, config string").json(f"{folder}/documents"), master
