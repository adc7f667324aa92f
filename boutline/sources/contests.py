"""Readers and cleaning steps that turn raw files into the canonical contest, odds and holdout tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S

# Accepted names of the time column, in order of preference.
TIME_COLUMNS = ("DATE", "date", "timestamp", "Timestamp", "Date", "TIMESTAMP")
FLAGS = ("ko", "kod", "subw", "subwd", "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd")
OPTIONAL = {
    "win": "int", "loss": "int", "weight": "double", "opp_weight": "double", "contest_weight": "double",
    "event_name": "string", "round": "int", "time_format": "string", **{f: "string" for f in FLAGS},
}


def time_column(df: DataFrame) -> str | None:
    """Name of the time column of ``df`` (case-sensitive), or None."""
    present = set(df.columns)
    return next((c for c in TIME_COLUMNS if c in present), None)


def parse_time(c) -> F.Column:
    """Timestamp without zone from text, date or timestamp; bad text becomes null."""
    c = S.col(c).try_cast("string")
    zoneless = F.regexp_replace(F.trim(c), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return zoneless.try_cast("timestamp_ntz")


# Column names of the stored files and what they are called here.
STORED_NAMES = {"FIGHTER": "player", "opp_FIGHTER": "opponent", "fighter": "player", "opp_fighter": "opponent", "EVENT": "event_name"}
STORED_PRICES = {"avg_odds": "american", "opp_avg_odds": "opp_american", "draftkings_odds": "draftkings", "fanduel_odds": "fanduel", "betmgm_odds": "betmgm"}
FILE_ORDER = "_file_order"


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Header blanks trimmed, stored names replaced; a name that is already ours stays."""
    df = df.toDF(*[c.strip() for c in df.columns])
    present = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in present and new not in present})


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Row order as a long column ``name``: an own column of that name, else the order ``read_csv_text`` noted. A table with neither is
    numbered as its partitions come, which is only as stable as they are."""
    if name in df.columns:
        return df.withColumn(name, F.col(name).cast("long")).drop(FILE_ORDER)
    if FILE_ORDER not in df.columns:
        return df.withColumn(name, F.monotonically_increasing_id())
    place = W.partitionBy(F.col(f"{FILE_ORDER}.file"), F.col(f"{FILE_ORDER}.block")).orderBy(F.col(f"{FILE_ORDER}.row"))
    blocks = df.groupBy(F.col(f"{FILE_ORDER}.file").alias("_f"), F.col(f"{FILE_ORDER}.block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = blocks.select("_f", "_b", F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per file block
    joined = df.join(before, (F.col(f"{FILE_ORDER}.file") == F.col("_f")) & (F.col(f"{FILE_ORDER}.block") == F.col("_b")))
    return joined.withColumn(name, F.col("_before") + F.row_number().over(place) - 1).drop("_f", "_b", "_before", FILE_ORDER)


def _draws(df: DataFrame) -> Column:
    draw = (F.col("win").try_cast("double") == 0) & (F.col("loss").try_cast("double") == 0)
    return F.coalesce(draw, F.lit(False))


def _time_of(df: DataFrame) -> str:
    t = time_column(df)
    if t is None:
        raise ValueError(f"no time column; expected one of {', '.join(TIME_COLUMNS)}")
    return t


def clean_contests(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical contests from a raw table whose cells may all be text.

    Stored column names become ours (``names`` adds to STORED_NAMES), bad results become null, the time loses its zone, a missing ``seq`` is
    the row's place in its files (by path, then place in the file), and absent optional columns are added as nulls, so later
    operators never test for a column.
    """
    raw = renamed(raw, {**STORED_NAMES, **(names or {})})
    t = _time_of(raw)
    df = raw.withColumn("played_at", parse_time(t)).drop(*([t] if t != "played_at" else []))
    df = _numbered(df, "seq").withColumns({"day": F.to_date("played_at"), "result": F.col("result").try_cast("double")})
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    return df.withColumn("is_draw", _draws(df))


def clean_odds(raw: DataFrame, prices: str | list[str] = "american", names: dict[str, str] | None = None) -> DataFrame:
    """Odds with numeric ``prices``, a day and ``odds_seq``, the row's place in its files; signs and blanks around numbers are accepted."""
    raw = renamed(raw, {**STORED_NAMES, **STORED_PRICES, **(names or {})})
    t = _time_of(raw)
    prices = [prices] if isinstance(prices, str) else prices
    df = _numbered(raw, "odds_seq")
    return df.withColumns({"day": F.to_date(parse_time(t)), **{p: F.col(p).try_cast("double") for p in prices}}).drop(t)


def clean_holdout(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Holdout cards: canonical names, both prices numeric (``" +200"`` is 200), ``seq`` and ``is_draw`` as for contests."""
    raw = renamed(raw, {**STORED_NAMES, **STORED_PRICES, **(names or {})})
    t = _time_of(raw)
    df = _numbered(raw, "seq").withColumns(
        {
            "played_at": parse_time(t),
            "day": F.to_date(parse_time(t)),
            "player": F.trim("player"),
            "opponent": F.trim("opponent"),
            "result": F.col("result").try_cast("double"),
            **{p: F.col(p).try_cast("double") for p in ("american", "opp_american") if p in raw.columns},
        }
    )
    draw = _draws(df) if {"win", "loss"} <= set(df.columns) else F.coalesce(F.col("result") == 0.5, F.lit(False))
    return df.withColumn("is_draw", draw).drop(*([t] if t != "played_at" else []))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every cell as text; blanks are kept so the cleaning step decides. A struct column notes each row's file, block and place there,
    which number the rows the same way however files are split and scheduled."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(FILE_ORDER, order)


def books_long(odds: DataFrame, books: list[str]) -> DataFrame:
    """One row per contest side and book."""
    keep = [c for c in odds.columns if c not in books]
    return odds.unpivot(keep, books, "book", "price")
