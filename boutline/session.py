"""Session set-up and the one way tables are materialised."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "boutline", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitter's settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a fresh local folder only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[sc.applicationId]


class StepTable:
    """A table a loop writes step by step into one shared folder and that is read back as a whole, so neither the plan nor the
    lineage grows with the number of steps."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/boutline-{uuid.uuid4().hex}"
        self.steps = 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write one step and return it as read back."""
        part = f"{self.path}/_step={self.steps}"
        df.write.parquet(part)
        self.steps += 1
        return self.spark.read.schema(df.schema).parquet(part)

    def whole(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one table feeds several branches of a job or a loop would grow its lineage. Unlike a block cache it
    survives the loss of an executor, and unlike an RDD checkpoint the Parquet scan still prunes columns and pushes filters.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/boutline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
