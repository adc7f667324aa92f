"""Contest, odds and holdout tables derived from the ``events`` and ``orders`` tables of a data folder.

Consecutive events (2i, 2i+1) form one contest between their users; consecutive orders one between their customers. Both
are built with one pre-aggregated shuffle on the contest number: every aggregated column is a fixed-width primitive, so the
hash aggregate combines both sides on the map side and no self-join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

_FIRST = ("Ana", "José", "Zoë", "Björn", "Rębecki")
_METHODS = ("ko", "sub", "udec", "mdec", "sdec")
_OWN = {"ko": "ko", "sub": "subw", "udec": "udec", "mdec": "mdec", "sdec": "sdec"}
_OTHER = {"ko": "kod", "sub": "subwd", "udec": "udecd", "mdec": "mdecd", "sdec": "sdecd"}


def display_name(u: Column) -> Column:
    return F.concat(S.first_match([(u % 5 == i, F.lit(n)) for i, n in enumerate(_FIRST[:4])], _FIRST[4]), F.lit(" P"), u.cast("string"))


def _flags(code: Column, result: Column) -> dict[str, Column]:
    out = {}
    for i, m in enumerate(_METHODS):
        out[_OWN[m]] = F.when((code == i) & (result >= 0.5), F.lit(" 1 "))
        out[_OTHER[m]] = F.when((code == i) & (result < 0.5), F.lit("True"))
    return out


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events_contests(self) -> DataFrame:
        even = F.col("event_id") % 2 == 0
        kinds = ("purchase", "signup", "view", "error")
        code = S.first_match([(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(kinds)], 4)
        weight = F.get_json_object("props", "$.k").try_cast("int")
        ev = self.read("events").select("event_id", "user_id", "ts", F.floor("value").alias("v"), "value", code.alias("code"), weight.alias("w"))
        c = ev.groupBy(F.shiftright("event_id", 1).alias("seq")).agg(
            *[F.max(F.when(even, F.col(x))).alias(f"a_{x}") for x in ("user_id", "v", "value", "w", "code", "ts")],
            *[F.max(F.when(~even, F.col(x))).alias(f"b_{x}") for x in ("user_id", "v", "value", "w")],
        )
        c = c.filter(F.col("a_user_id") != F.col("b_user_id"))
        result = S.first_match([(F.col("a_v") > F.col("b_v"), F.lit(1.0)), (F.col("a_v") == F.col("b_v"), F.lit(0.5))], 0.0)
        return c.select(
            "seq",
            F.col("a_ts").cast("timestamp_ntz").alias("played_at"),
            F.to_date("a_ts").alias("day"),
            display_name(F.col("a_user_id")).alias("player"),
            display_name(F.col("b_user_id")).alias("opponent"),
            result.alias("result"),
            (result == 1.0).cast("int").alias("win"),
            (result == 0.0).cast("int").alias("loss"),
            (result == 0.5).alias("is_draw"),
            *[v.alias(k) for k, v in _flags(F.col("a_code"), result).items()],
            F.when(F.col("seq") % 3 != 0, (F.floor(F.col("a_w") / 10) * 10).cast("double")).alias("weight"),
            F.when(F.col("seq") % 4 != 0, (F.floor(F.col("b_w") / 10) * 10).cast("double")).alias("opp_weight"),
            (F.floor((F.col("a_w") + F.col("b_w")) / 20) * 10).cast("double").alias("contest_weight"),
            F.col("a_value").alias("stat"),
            F.col("b_value").alias("opp_stat"),
            (F.col("seq") % 3 + 1).cast("int").alias("round"),
        )

    def orders_contests(self) -> DataFrame:
        even = F.col("o_orderkey") % 2 == 0
        kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
        code = S.first_match([(F.col("o_orderpriority") == k, F.lit(i)) for i, k in enumerate(kinds)], 4)
        o = self.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", code.alias("code"))
        c = o.groupBy(F.shiftright("o_orderkey", 1).alias("seq")).agg(
            *[F.max(F.when(even, F.col(x))).alias(f"a_{x}") for x in ("o_custkey", "o_totalprice", "code", "o_orderdate")],
            *[F.max(F.when(~even, F.col(x))).alias(f"b_{x}") for x in ("o_custkey", "o_totalprice")],
        )
        c = c.filter(F.col("a_o_custkey") != F.col("b_o_custkey"))
        result = S.first_match(
            [(F.col("a_o_totalprice") > F.col("b_o_totalprice"), F.lit(1.0)), (F.col("a_o_totalprice") == F.col("b_o_totalprice"), F.lit(0.5))], 0.0
        )
        return c.select(
            "seq",
            F.col("a_o_orderdate").cast("timestamp_ntz").alias("played_at"),
            F.to_date("a_o_orderdate").alias("day"),
            display_name(F.col("a_o_custkey")).alias("player"),
            display_name(F.col("b_o_custkey")).alias("opponent"),
            result.alias("result"),
            (result == 1.0).cast("int").alias("win"),
            (result == 0.0).cast("int").alias("loss"),
            (result == 0.5).alias("is_draw"),
            *[v.alias(k) for k, v in _flags(F.col("a_code"), result).items()],
        )

    def odds(self, contests: DataFrame) -> DataFrame:
        """Both sides' prices; a seventh of the contests has none and a tenth lacks the other side's row."""
        seq = F.col("seq")
        base = F.when(seq % 7 != 0, F.when(seq % 3 == 0, -(seq * 37 % 300 + 100)).otherwise(seq * 53 % 300 + 100)).cast("double")
        side = F.explode(
            F.when(seq % 10 == 3, F.array(F.struct(F.lit(0).alias("side"), F.col("player"), F.col("opponent"), base.alias("american")))).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("side"), F.col("player"), F.col("opponent"), base.alias("american")),
                    F.struct(F.lit(1).alias("side"), F.col("opponent").alias("player"), F.col("player").alias("opponent"), (-base).alias("american")),
                )
            )
        ).alias("o")
        rows = contests.select("seq", "day", "result", side)
        a = F.col("o.american")
        grow = F.signum(a)
        return rows.select(
            (seq * 2 + F.col("o.side")).alias("odds_seq"),
            "seq",
            "day",
            F.col("o.player").alias("player"),
            F.col("o.opponent").alias("opponent"),
            a.alias("american"),
            (a + grow * 5).alias("book_a"),
            (a + grow * (seq % 11)).alias("book_b"),
            F.when(seq % 5 != 0, a + grow * (seq % 23)).alias("book_c"),
            F.when(F.col("o.side") == 0, F.col("result")).otherwise(F.lit(1.0) - F.col("result")).alias("result"),
        )

    def holdout(self, contests: DataFrame, days: int | None) -> DataFrame:
        """Contests of the last ``days`` days (None: all) with names spelt differently: plain, shouted, with a middle token, or unknown."""
        recent = contests if days is None else contests.filter(F.col("day") > contests.agg(F.date_sub(F.max("day"), days)).scalar())
        seq = F.col("seq")

        def respell(name: str, tag: str) -> Column:
            n = F.col(name)
            return S.first_match(
                [(seq % 4 == 0, n), (seq % 4 == 1, F.upper(n)), (seq % 4 == 2, F.replace(n, F.lit(" "), F.lit("  de ")))],
                F.concat(F.lit(f"New {tag}"), seq.cast("string")) if tag == "N" else n,
            )

        base = F.when(seq % 7 != 0, F.when(seq % 3 == 0, -(seq * 37 % 300 + 100)).otherwise(seq * 53 % 300 + 100)).cast("double")
        return (
            recent
            .select("seq", "played_at", "day", respell("player", "N").alias("player"), respell("opponent", "O").alias("opponent"), "result", "is_draw", base.alias("american"), (-base).alias("opp_american"))
        )
