"""Cleaning, scalar expressions and buckets over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import fitness as FIT
from ..functions import scalar as S
from ..functions.scalar import r6
from ..session import shared_dir
from ..sources import contests as C
from . import query
from . import sqltext as T

def _as_csv(raw):
    """Folder of the whole table as CSV text with blanks kept."""
    path = f"{shared_dir(raw.sparkSession).rstrip('/')}/boutline-csv-{uuid.uuid4().hex}"
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_RAW_RESULT = "CASE WHEN seq % 11 = 0 THEN 'n/a' WHEN seq % 13 = 0 THEN NULL ELSE ' ' || CAST(result AS VARCHAR(9)) END"


@query(
    "scan_contests",
    T.sql(
        T.EV,
        select="""SELECT seq, CAST(day AS VARCHAR) AS day, CASE WHEN seq % 11 = 0 OR seq % 13 = 0 THEN NULL ELSE result END AS result,
  (seq % 17 <> 0 AND is_draw)::INT AS is_draw, player, opponent, 1 AS absent FROM ev""",
    ),
)
def scan_contests(t):
    raw = t.events_contests().select(
        F.col("seq").cast("string").alias("seq"),
        F.concat(F.date_format("played_at", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("DATE"),
        "player",
        "opponent",
        F.when(F.col("seq") % 11 == 0, "n/a").when(F.col("seq") % 13 != 0, F.concat(F.lit(" "), F.col("result").cast("string"))).alias("result"),
        F.when(F.col("seq") % 17 != 0, F.col("win").cast("string")).alias("win"),
        F.col("loss").cast("string").alias("loss"),
    )
    clean = C.clean_contests(C.read_csv_text(t.spark, _as_csv(raw)))
    return clean.select(
        "seq", F.col("day").cast("string").alias("day"), "result", F.col("is_draw").cast("int").alias("is_draw"), "player", "opponent", F.col("round").isNull().cast("int").alias("absent")
    )


@query(
    "scan_odds",
    T.sql(
        T.EV,
        T.odds_sql("ev"),
        select="""SELECT odds_seq, CAST(day AS VARCHAR) AS day, player, opponent, book, price FROM (
  SELECT odds_seq, day, player, opponent, unnest(['american', 'book_a', 'book_b', 'book_c']) AS book, unnest([american, book_a, book_b, book_c]) AS price FROM odds)""",
    ),
)
def scan_odds(t):
    o = t.odds(t.events_contests())
    books = ["american", "book_a", "book_b", "book_c"]
    text = {b: F.when(F.col(b) > 0, F.concat(F.lit(" +"), F.col(b).cast("string"))).otherwise(F.coalesce(F.col(b).cast("string"), F.lit("-"))) for b in books}
    raw = o.withColumns(text).withColumn("DATE", F.col("day").cast("string")).drop("day")
    clean = C.clean_odds(C.read_csv_text(t.spark, _as_csv(raw.drop("played_at"))), books)
    return C.books_long(clean.select("odds_seq", F.col("day").cast("string").alias("day"), "player", "opponent", *books), books)


@query(
    "clean_holdout_odds",
    T.sql(
        T.EV,
        T.holdout_sql("ev", None),
        select="SELECT seq, CAST(day AS VARCHAR) AS day, trim(player) AS player, trim(opponent) AS opponent, result, american, opp_american FROM hold",
    ),
)
def clean_holdout_odds(t):
    h = t.holdout(t.events_contests(), None)
    signed = lambda c: F.when(F.col(c) > 150, F.concat(F.lit(" +"), F.col(c).cast("int").cast("string"))).otherwise(F.concat(F.lit(" "), F.col(c).cast("int").cast("string")))
    raw = h.select(
        F.date_format("played_at", "yyyy-MM-dd").alias("date"),
        F.concat(F.col("player"), F.lit("  ")).alias("fighter"),
        F.col("opponent").alias("opp_fighter"),
        F.col("result").cast("string").alias("result"),
        signed("american").alias("avg_odds"),
        signed("opp_american").alias(" opp_avg_odds"),
        "seq",
    )
    return C.clean_holdout(C.read_csv_text(t.spark, _as_csv(raw))).select("seq", F.col("day").cast("string").alias("day"), "player", "opponent", "result", "american", "opp_american")


@query("method_multiplier", T.sql(T.EV, select=f"SELECT seq, {T.multiplier_sql({'ko': 1.4, 'sub': 1.3, 'udec': 1.0, 'mdec': 0.9, 'sdec': 0.7})}::DOUBLE AS multiplier FROM ev"))
def method_multiplier(t):
    return t.events_contests().select("seq", S.method_multiplier().alias("multiplier"))


_LABELS = {"ko": "KO/TKO", "sub": "Submission", "udec": "Unanimous Decision", "sdec": "Split Decision", "mdec": "Majority Decision"}
_LABEL_SQL = "CASE " + " ".join(f"WHEN {T.hit(m)} THEN '{label}'" for m, label in _LABELS.items())


@query("method_label", T.sql(T.EV, select=f"SELECT seq, {_LABEL_SQL} ELSE 'Unknown' END AS label, {_LABEL_SQL} ELSE 'Other' END AS label_other FROM (SELECT * REPLACE (CASE WHEN seq % 9 = 0 THEN NULL ELSE ko END AS ko) FROM ev)"))
def method_label(t):
    c = t.events_contests().withColumn("ko", F.when(F.col("seq") % 9 != 0, F.col("ko")))
    return c.select("seq", S.method_label().alias("label"), S.method_label("Other").alias("label_other"))


@query(
    "expected_score",
    T.sql(T.EV, select=f"""SELECT seq, {T.r6("1.0/(1.0+pow(10.0,((1500+opp_stat)-(1500+stat))/400.0))")} AS e400, {T.r6("1.0/(1.0+pow(10.0,(opp_stat-stat)/217.0))")} AS e217 FROM ev"""),
)
def expected_score(t):
    a, b = F.col("stat") + 1500, F.col("opp_stat") + 1500
    return t.events_contests().select("seq", r6(S.expected_score(a, b)).alias("e400"), r6(S.expected_score("stat", "opp_stat", 217.0)).alias("e217"))


_DEC = "CASE WHEN american > 0 THEN american/100.0+1.0 WHEN american < 0 THEN 100.0/abs(american)+1.0 END"
_IMP = "CASE WHEN american > 0 THEN 100.0/(american+100.0) WHEN american < 0 THEN abs(american)/(abs(american)+100.0) END"
_ZERO_ODDS = "(SELECT * REPLACE (CASE WHEN seq % 19 = 0 THEN 0 ELSE american END AS american) FROM odds)"


def _zero_odds(t):
    return t.odds(t.events_contests()).withColumn("american", F.when(F.col("seq") % 19 == 0, 0.0).otherwise(F.col("american")))


@query("american_to_decimal", T.sql(T.EV, T.odds_sql("ev"), select=f"SELECT odds_seq, {T.r6(_DEC)} AS price FROM {_ZERO_ODDS}"))
def american_to_decimal(t):
    return _zero_odds(t).select("odds_seq", r6(S.decimal_odds("american")).alias("price"))


@query(
    "implied_probability",
    T.sql(T.EV, T.odds_sql("ev"), select=f"SELECT odds_seq, {T.r6(f'coalesce({_IMP}, 0.5)')} AS implied, {T.r6(f'1.0/({_DEC})')} AS inverse_price FROM {_ZERO_ODDS}"),
)
def implied_probability(t):
    return _zero_odds(t).select("odds_seq", r6(S.implied_probability("american")).alias("implied"), r6(1.0 / S.decimal_odds("american")).alias("inverse_price"))


@query(
    "kelly_fraction",
    T.sql(T.EV, T.odds_sql("ev"), select=f"""SELECT odds_seq, CASE WHEN d > 1 THEN {T.r6("((d-1.0)*p-(1.0-p))/(d-1.0)")} END AS kelly FROM (SELECT odds_seq, {_DEC} AS d, CASE WHEN seq % 5 <> 0 THEN (seq % 100)/100.0 END AS p FROM odds)"""),
)
def kelly_fraction(t):
    p = F.when(F.col("seq") % 5 != 0, (F.col("seq") % 100) / 100.0)
    return t.odds(t.events_contests()).select("odds_seq", r6(S.kelly_fraction(p, S.decimal_odds("american"))).alias("kelly"))


@query("normalize_name", T.sql(T.EV, T.holdout_sql("ev", None), select="SELECT seq, trim(regexp_replace(lower(strip_accents(player)), '\\s+', ' ', 'g')) AS folded FROM hold"))
def normalize_name(t):
    return t.holdout(t.events_contests(), None).select("seq", S.fold_name("player").alias("folded"))


_GAP = "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 700 END"
_RATING = "(1200 + o_custkey % 900)"


def _gaps(t):
    k = F.col("o_orderkey")
    return t.read("orders").select(
        "o_orderkey",
        F.when(k % 17 != 0, k % 700).alias("days"),
        (F.col("o_custkey") % 900 + 1200).cast("double").alias("rating"),
        F.element_at(F.array(F.lit("linear"), F.lit("exponential"), F.lit("none"), F.lit("other")), (k % 4 + 1).cast("int")).alias("mode"),
    )


def _decay_sql(kind, rate=0.0005, first=180):
    body = f"1.0 - {rate}*(d-{first})" if kind == "linear" else f"exp(-{rate}*(d-{first}))"
    return f"CASE WHEN d IS NULL OR d < {first} THEN r ELSE r*greatest(0.5, {body}) END"


_GAPS_SQL = f"(SELECT o_orderkey, {_GAP} AS d, {_RATING}::DOUBLE AS r, ['linear','exponential','none','other'][o_orderkey % 4 + 1] AS mode FROM orders)"


@query("decay_linear", f"SELECT o_orderkey, {T.r6(_decay_sql('linear'))} AS adjusted FROM {_GAPS_SQL}")
def decay_linear(t):
    return _gaps(t).select("o_orderkey", r6(F.col("rating") * S.linear_decay_factor("days", 0.0005, 180)).alias("adjusted"))


@query("decay_exponential", f"SELECT o_orderkey, {T.r6(_decay_sql('exponential', 0.002))} AS adjusted FROM {_GAPS_SQL}")
def decay_exponential(t):
    return _gaps(t).select("o_orderkey", r6(F.col("rating") * S.exponential_decay_factor("days", 0.002, 180)).alias("adjusted"))


@query(
    "decay_by_mode",
    f"SELECT o_orderkey, {T.r6('CASE mode WHEN ' + chr(39) + 'linear' + chr(39) + ' THEN ' + _decay_sql('linear', 0.001, 90) + ' WHEN ' + chr(39) + 'exponential' + chr(39) + ' THEN ' + _decay_sql('exponential', 0.001, 90) + ' ELSE r END')} AS adjusted FROM {_GAPS_SQL}",
)
def decay_by_mode(t):
    return _gaps(t).select("o_orderkey", r6(F.col("rating") * S.decay_factor(F.col("mode"), "days", 0.001, 90)).alias("adjusted"))


@query(
    "decay_multiphase",
    f"SELECT o_orderkey, {T.r6('CASE WHEN d IS NULL THEN r WHEN d < 45 THEN r*1.05 WHEN d > 200 THEN r*greatest(0.5, exp(-0.003*(d-200))) ELSE r END')} AS adjusted FROM {_GAPS_SQL}",
)
def decay_multiphase(t):
    return _gaps(t).select("o_orderkey", r6(F.col("rating") * S.multiphase_factor("days", 45, 1.05, 200, 0.003)).alias("adjusted"))


# metric rows for the fitness expressions, one per order
_METRICS = {
    "roi": (7, 600, 10.0, -30.0), "accuracy": (11, 1000, 1000.0, 0.0), "log_loss": (13, 200, 100.0, 0.0), "brier": (17, 100, 100.0, 0.0),
    "ece": (19, 300, 1000.0, 0.0), "slope": (23, 300, 100.0, -0.5), "auc": (29, 600, 1000.0, 0.4), "variance": (31, 200, 10000.0, 0.0),
    "drawdown": (37, 500, 10.0, 0.0), "trend": (41, 400, 100.0, -2.0), "sharpe": (43, 700, 100.0, -3.0),
}
_METRICS_SQL = "(SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN (o_orderkey + {i}) % 12 <> 0 THEN (o_orderkey * {m} % {mod})::DOUBLE / {div} + {off} END AS {n}" for i, (n, (m, mod, div, off)) in enumerate(_METRICS.items())
) + " FROM orders)"


def _metrics(t):
    k = F.col("o_orderkey")
    return t.read("orders").select(
        "o_orderkey", *[F.when((k + i) % 12 != 0, (k * m % mod).cast("double") / div + off).alias(n) for i, (n, (m, mod, div, off)) in enumerate(_METRICS.items())]
    )


_NORM_SQL = {
    "roi": "1.0/(1.0+exp(-coalesce(roi,0)/10.0))",
    "accuracy": "coalesce(accuracy,0.5)",
    "log_loss": "coalesce(1.0/(1.0+log_loss),0.5)",
    "brier_score": "coalesce(1.0-brier,0.5)",
    "ece": "CASE WHEN ece IS NULL THEN 0.5 ELSE greatest(0.0,least(1.0,1.0-ece*5.0)) END",
    "calibration": "CASE WHEN ece IS NULL THEN 0.5 ELSE greatest(0.0,least(1.0,1.0-ece*5.0)) END",
    "calibration_slope": "CASE WHEN slope IS NULL THEN 0.5 ELSE greatest(0.0,least(1.0,1.0-abs(slope-1.0))) END",
    "auc": "CASE WHEN auc IS NULL THEN 0.5 ELSE greatest(0.0,least(1.0,(auc-0.5)*2.0)) END",
    "consistency": "coalesce(1.0/(1.0+variance*100.0),0.5)",
    "max_drawdown": "coalesce(1.0/(1.0+drawdown/10.0),0.5)",
    "trend": "coalesce(1.0/(1.0+exp(-trend*5.0)),0.5)",
    "sharpe": "coalesce(1.0/(1.0+exp(-sharpe)),0.5)",
}


# Written out on purpose, so that the SQL does not share the operators' constants.
_MULTI = {"roi": 0.4, "accuracy": 0.15, "calibration": 0.15, "consistency": 0.15, "auc": 0.15}
_MARGINS = ("Huge favorite (>300)", "Large favorite (200-300)", "Small favorite (100-200)", "Close (0-100)", "Close underdog (0-100)", "Large underdog (100-200)", "Very large underdog (200+)")


def _scores():
    return FIT.normalized("roi", "accuracy", "log_loss", "brier", "ece", "slope", "auc", "variance", "drawdown", "trend", "sharpe")


@query("normalize_metrics", f"SELECT o_orderkey, {', '.join(f'{T.r6(e)} AS {n}' for n, e in _NORM_SQL.items())} FROM {_METRICS_SQL}")
def normalize_metrics(t):
    m = _metrics(t)
    return m.select("o_orderkey", *[r6(c).alias(n) for n, c in _scores().items()])


@query("weighted_fitness", f"SELECT o_orderkey, {T.r6(' + '.join(f'({_NORM_SQL[k]})*{w}' for k, w in _MULTI.items()), 10)} AS fitness FROM {_METRICS_SQL}")
def weighted_fitness(t):
    return _metrics(t).select("o_orderkey", r6(FIT.weighted(_scores(), {**FIT.check_weights(None), "unknown": 3.0}), 10).alias("fitness"))


_SEARCH = {"roi": 0.5, "calibration": 0.3, "auc": 0.2}


@query(
    "search_fitness",
    f"""SELECT o_orderkey, {T.r6("greatest(0.0,least(10.0,(coalesce(roi,0)+20.0)/5.0))*0.5 + greatest(0.0,least(10.0,(coalesce(trend,0)+1.0)*5.0))*0.1 + greatest(0.0,least(10.0,(coalesce(sharpe,0)+2.0)*2.0))*0.1 + coalesce(10.0/(1.0+ece*50.0),5.0)*0.3 + coalesce(10.0/(1.0+variance*500.0),5.0)*0.15 + greatest(0.0,least(10.0,(CASE WHEN auc IS NULL OR auc = 0 THEN 0.5 ELSE auc END-0.5)*20.0))*0.2")} AS fitness, {T.r6('coalesce(roi,0)')} AS plain
FROM {_METRICS_SQL}""",
)
def search_fitness(t):
    m = _metrics(t)
    args = ("roi", "trend", "sharpe", "ece", "variance", "auc")
    return m.select("o_orderkey", r6(FIT.search_fitness(*args, weights=_SEARCH)).alias("fitness"), r6(FIT.search_fitness(*args)).alias("plain"))


@query(
    "composite_fitness",
    f"""SELECT o_orderkey, {T.r6("coalesce(roi,0)*0.4 + coalesce(accuracy,0)*100.0*0.2 + greatest(0.0,(0.1-coalesce(nullif(ece,0),0.1))*1000.0)*0.15 + greatest(0.0,(0.01-coalesce(nullif(variance,0),0.01))*10000.0)*0.15 + (coalesce(nullif(auc,0),0.5)-0.5)*200.0*0.1")} AS fitness FROM {_METRICS_SQL}""",
)
def composite_fitness(t):
    return _metrics(t).select("o_orderkey", r6(FIT.composite_fitness("roi", "accuracy", "ece", "variance", "auc")).alias("fitness"))


@query(
    "fitness_weights",
    """SELECT o_orderkey, k AS metric, round(w, 6) + 0.0 AS weight FROM (
  SELECT o_orderkey, unnest(ks) AS k, unnest(ws) AS w FROM (SELECT o_orderkey,
    CASE WHEN o_orderkey % 5 = 0 THEN ['roi','accuracy','calibration','consistency','auc'] ELSE ['roi','ece'] END AS ks,
    CASE WHEN o_orderkey % 5 = 0 THEN [0.4,0.15,0.15,0.15,0.15]::DOUBLE[]
      ELSE [(o_orderkey % 10)::DOUBLE/((o_orderkey % 10)+(o_orderkey % 3 + 1)), (o_orderkey % 3 + 1)::DOUBLE/((o_orderkey % 10)+(o_orderkey % 3 + 1))] END AS ws
    FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0))""",
)
def fitness_weights(t):
    k = F.col("o_orderkey")
    good = F.format_string('{"roi": %d, "ece": %d}', k % 10, k % 3 + 1)
    bad = F.lit('{"roi": 1, "luck": 2}')
    text = F.when(k % 5 == 0, None).when(k % 7 == 0, bad).otherwise(good)
    w = t.read("orders").select("o_orderkey", FIT.weights_column(text).alias("w")).filter(F.col("w").isNotNull())
    return w.select("o_orderkey", F.explode("w").alias("metric", "x")).select("o_orderkey", "metric", r6("x").alias("weight"))


@query("overfit_fitness", f"SELECT o_orderkey, {T.r6('CASE WHEN coalesce(roi,0) - coalesce(trend,0) > 2.0 THEN 0.5*coalesce(trend,0) ELSE 0.7*coalesce(trend,0) + 0.3*coalesce(roi,0) END')} AS fitness FROM {_METRICS_SQL}")
def overfit_fitness(t):
    return _metrics(t).select("o_orderkey", r6(FIT.overfit_fitness("roi", "trend")).alias("fitness"))


def _case(expr, pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{default}' END"


@query(
    "bucket_experience",
    "SELECT o_orderkey, " + _case("n", [("n IS NULL OR n <= 5", "Unknown"), ("n <= 15", "Novice"), ("n <= 50", "Experienced")], "Veteran") + " AS level FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 80 END AS n FROM orders)",
)
def bucket_experience(t):
    n = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") % 80)
    return t.read("orders").select("o_orderkey", B.experience(n).alias("level"))


@query("bucket_layoff", "SELECT o_orderkey, " + _case("d", [("d IS NULL", "Unknown"), ("d <= 90", "Recent"), ("d <= 180", "Medium"), ("d <= 274", "Long")], "Very Long") + f" AS layoff FROM {_GAPS_SQL}")
def bucket_layoff(t):
    return _gaps(t).select("o_orderkey", B.layoff("days").alias("layoff"))


@query(
    "bucket_opponent_quality",
    "SELECT o_orderkey, " + _case("r", [("r >= 0 AND r < 1500", "Lower-tier"), ("r >= 1500 AND r < 1700", "Mid-tier"), ("r >= 1700", "Elite")], "Mid-tier") + " AS quality FROM (SELECT o_orderkey, (o_custkey % 2100 - 100)::DOUBLE AS r FROM orders)",
)
def bucket_opponent_quality(t):
    return t.read("orders").select("o_orderkey", B.opponent_quality((F.col("o_custkey") % 2100 - 100).cast("double")).alias("quality"))


@query(
    "bucket_margin",
    "SELECT o_orderkey, " + _case("m", [("m > 300", _MARGINS[0]), ("m > 200", _MARGINS[1]), ("m > 100", _MARGINS[2]), ("m > 0", _MARGINS[3]), ("m > -100", _MARGINS[4]), ("m > -200", _MARGINS[5])], _MARGINS[6]) + " AS margin FROM (SELECT o_orderkey, (o_orderkey * 7 % 801 - 400)::DOUBLE AS m FROM orders)",
)
def bucket_margin(t):
    return t.read("orders").select("o_orderkey", B.margin((F.col("o_orderkey") * 7 % 801 - 400).cast("double")).alias("margin"))
