"""Filters, dedup, price joins, bets and ROI."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.scalar import r6
from ..operators import bets as K
from ..operators import metrics as M
from ..operators import ratings as R
from ..operators.prefix import exact_quantiles
from ..session import materialize
from . import query
from . import sqltext as T

CAND = [{"k": 32.0}]
CARRY = ["result", "is_draw", "played_at"]
RATED_EV = (T.EV, T.scan_sql("ev", CAND))
RATED_OC = (T.OC, T.scan_sql("oc", CAND))


BEFORE = {"pre": None, "opp_pre": None}  # bets and predictions need no ratings after the contest
AFTER = {"post": None, "opp_post": None}


def rated_events(t, carry=CARRY, emit=BEFORE):
    c = materialize(t.events_contests())
    return c, R.rate(c, CAND, carry=carry, emit=emit)


def rated_orders(t, carry=CARRY, emit=BEFORE):
    c = materialize(t.orders_contests())
    return c, R.rate(c, CAND, carry=carry, emit=emit)


def bets_orders(t, **kw):
    c, rated = rated_orders(t)
    return K.bet_records(rated, c, t.odds(c), **kw)


def bets_events(t, **kw):
    c, rated = rated_events(t)
    return K.bet_records(rated, c, t.odds(c), **kw)


BETS_OC = (*RATED_OC, T.odds_sql("oc"), T.bets_sql("oc"))
BETS_EV = (*RATED_EV, T.odds_sql("ev"), T.bets_sql("ev"))


@query("valid_contests", T.sql(*RATED_EV, select=f"SELECT seq FROM rated WHERE {T.DECIDED} AND pre <> opp_pre"))
def valid_contests(t):
    return K.decided(rated_events(t)[1]).filter(F.col("pre") != F.col("opp_pre")).select("seq")


@query(
    "prior_history_filter",
    T.sql(T.OC, T.firsts_sql("oc"), select="SELECT seq FROM oc JOIN fd a ON a.who = player JOIN fd b ON b.who = opponent WHERE day > a.d AND day > b.d"),
)
def prior_history_filter(t):
    c = t.orders_contests().select("seq", "day", "player", "opponent")
    return K.with_prior_history(c, c).select("seq")


@query(
    "predictions_boutcount",
    T.sql(
        *RATED_OC,
        T.sides_sql("oc", "l"),
        "n AS (SELECT seq, side, row_number() OVER (PARTITION BY who ORDER BY day, seq, side) - 1 AS b FROM l)",
        "bc AS (SELECT seq, max(CASE WHEN side = 0 THEN b END) AS bouts, max(CASE WHEN side = 1 THEN b END) AS opp_bouts FROM n GROUP BY seq)",
        select=f"SELECT seq, (pre > opp_pre)::INT AS picked, ((pre > opp_pre)::INT = result)::INT AS correct FROM rated JOIN bc USING (seq) WHERE {T.DECIDED} AND bouts >= 1 AND opp_bouts >= 1 AND pre <> opp_pre",
    ),
)
def predictions_boutcount(t):
    c, rated = rated_orders(t)
    counted = rated.join(R.bout_counts(c.select("seq", "day", "player", "opponent")).select("seq", "bouts", "opp_bouts"), "seq")
    kept = K.with_counts_filter(counted)
    picked = (F.col("pre") > F.col("opp_pre")).cast("int")
    return kept.select("seq", picked.alias("picked"), (picked == F.col("result")).cast("int").alias("correct"))


@query("lookback_filter", T.sql(T.OC, select="SELECT seq, CAST(day AS VARCHAR) AS day FROM oc WHERE day > (SELECT max(day) FROM oc) - 365"))
def lookback_filter(t):
    return K.within_lookback(t.orders_contests().select("seq", "day"), 365).select("seq", F.col("day").cast("string").alias("day"))


@query("quantile_cutoff", T.sql(T.EV, T.OC, select="SELECT 'events' AS source, round(quantile_cont(epoch_us(played_at)::DOUBLE, 0.8) / 1e6, 3) + 0.0 AS cutoff FROM ev UNION ALL SELECT 'orders', round(quantile_cont(epoch_us(played_at)::DOUBLE, 0.8) / 1e6, 3) + 0.0 FROM oc"))
def quantile_cutoff(t):
    def cut(name, c):
        micros = c.select(S.epoch_micros("played_at").alias("x"))
        return exact_quantiles(micros, "x", [0.8]).select(F.lit(name).alias("source"), r6(F.col("q0") / 1e6, 3).alias("cutoff"))

    return cut("events", t.events_contests()).unionByName(cut("orders", t.orders_contests()))


@query("dedup_pairs", T.sql(T.EV, select=f"SELECT seq, player, opponent, CAST(day AS VARCHAR) AS day FROM ev WHERE {T.DECIDED} QUALIFY row_number() OVER (PARTITION BY {T.PAIR} ORDER BY seq) = 1"))
def dedup_pairs(t):
    return K.first_per_pair(K.decided(t.events_contests())).select("seq", "player", "opponent", F.col("day").cast("string").alias("day"))


@query("odds_coverage", T.sql(T.EV, T.odds_sql("ev"), select="SELECT count(DISTINCT (day, player, opponent)) // 2 AS contests, count(DISTINCT (day, player, opponent)) FILTER (WHERE american IS NOT NULL) // 2 AS priced FROM odds"))
def odds_coverage(t):
    o = t.odds(t.events_contests())
    per_key = o.groupBy("day", "player", "opponent").agg(F.count("american").alias("n"))
    return per_key.agg(F.floor(F.count(F.lit(1)) / 2).alias("contests"), F.floor(F.count_if(F.col("n") > 0) / 2).alias("priced"))


@query("predictions", T.sql(*RATED_OC, T.pred_sql("oc"), select="SELECT seq, picked, correct FROM pred"))
def predictions(t):
    c, rated = rated_orders(t)
    return K.predictions(rated, c).select("seq", "picked", "correct")


@query("scored_predictions", T.sql(*RATED_OC, T.pred_sql("oc"), select=f"SELECT seq, {T.r6('diff')} AS diff, {T.r6('prob')} AS prob, result FROM pred"))
def scored_predictions(t):
    c, rated = rated_orders(t)
    return K.scored(rated, c).select("seq", r6("diff").alias("diff"), r6("prob").alias("prob"), "result")


_BET_COLS = f"SELECT seq, CAST(day AS VARCHAR) AS day, bet_on, bet_against, bet_won, {T.r6('diff')} AS diff, {T.r6('prob')} AS prob, american, {T.r6('decimal')} AS decimal, {T.r6('payout')} AS payout, {T.r6('profit')} AS profit FROM bets"


def _show_bets(b):
    return b.select(
        "seq", F.col("day").cast("string").alias("day"), "bet_on", "bet_against", "bet_won", r6("diff").alias("diff"), r6("prob").alias("prob"), "american",
        r6("decimal").alias("decimal"), r6("payout").alias("payout"), r6("profit").alias("profit"),
    )


@query("bet_records", T.sql(*BETS_OC, select=_BET_COLS))
def bet_records(t):
    return _show_bets(bets_orders(t))


@query("odds_join", T.sql(*RATED_EV, T.odds_sql("ev"), T.bets_sql("ev"), select=_BET_COLS))
def odds_join(t):
    return _show_bets(bets_events(t))


@query("odds_join_fallback", T.sql(*RATED_EV, T.odds_sql("ev"), T.bets_sql("ev", fallback="mirror"), select=_BET_COLS))
def odds_join_fallback(t):
    return _show_bets(bets_events(t, fallback="mirror"))


@query("bet_records_main", T.sql(*RATED_EV, T.odds_sql("ev"), T.bets_sql("ev", dedup="late", fallback="both"), select=_BET_COLS))
def bet_records_main(t):
    return _show_bets(bets_events(t, dedup="late", fallback="both"))


_OWN_ODDS = f"""own AS (SELECT *, {T.PRICE} AS american FROM ev),
px AS (SELECT player, opponent, day, coalesce(max_by(a, seq) FILTER (WHERE direct), min_by(a, seq) FILTER (WHERE NOT direct)) AS american FROM (
  SELECT player, opponent, day, american AS a, seq, true AS direct FROM own WHERE american IS NOT NULL UNION ALL SELECT opponent, player, day, american, seq, false FROM own WHERE american IS NOT NULL) GROUP BY ALL)"""


@query("prices_from_contests", T.sql(T.EV, _OWN_ODDS, select="SELECT player, opponent, CAST(day AS VARCHAR) AS day, american FROM px"))
def prices_from_contests(t):
    """Prices stored on the contest rows themselves, mirrored where the other side has none."""
    c = t.events_contests()
    own = t.odds(c).filter(F.col("odds_seq") % 2 == 0).select("seq", "day", "player", "opponent", "american")
    return K.price_table_from_contests(own).select("player", "opponent", F.col("day").cast("string").alias("day"), "american")


@query(
    "accuracy_cutoff",
    T.sql(
        *RATED_EV,
        T.pred_sql("ev"),
        "cut AS (SELECT quantile_cont(epoch_us(played_at)::DOUBLE, 0.8) AS q FROM ev)",
        select=f"SELECT {T.r6('avg(correct)')} AS accuracy, {T.r6('avg(correct) FILTER (WHERE epoch_us(played_at) > q)')} AS later_accuracy, count(*) FILTER (WHERE epoch_us(played_at) > q) AS later_rows FROM pred, cut",
    ),
)
def accuracy_cutoff(t):
    c, rated = rated_events(t)
    cut = exact_quantiles(c.select(S.epoch_micros("played_at").alias("x")), "x", [0.8]).scalar()
    a = M.accuracy_after(K.predictions(rated, c).withColumn("played_at", S.epoch_micros("played_at")), cut)
    return a.select(r6("accuracy").alias("accuracy"), r6("later_accuracy").alias("later_accuracy"), "later_rows")


@query("accuracy_since_year", T.sql(*RATED_OC, T.pred_sql("oc"), select=f"SELECT {T.r6('avg(correct)')} AS accuracy, count(*) AS n FROM pred WHERE year(day) >= 1999"))
def accuracy_since_year(t):
    c, rated = rated_orders(t)
    return K.predictions(rated, c).filter(F.year("day") >= 1999).agg(r6(F.avg("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def log_loss_sql(p: str, y: str, eps: str) -> str:
    q = f"least(greatest({p}, {eps}), 1.0 - {eps})"
    return f"-({y} * ln({q}) + (1.0 - {y}) * ln(1.0 - {q}))"


PM = f"{T.r6('avg(((prob > 0.5)::INT = result)::INT)')} AS accuracy, {T.r6('avg(' + log_loss_sql('prob', 'result', '1e-15') + ')')} AS log_loss, {T.r6('avg((prob - result) * (prob - result))')} AS brier, count(*) AS n"


@query("prediction_metrics", T.sql(*RATED_EV, T.pred_sql("ev", dedup=True), select=f"SELECT {PM} FROM pred"))
def prediction_metrics(t):
    c, rated = rated_events(t)
    m = M.probability_metrics(K.scored(rated, c, dedup=True))
    return m.select(r6("accuracy").alias("accuracy"), r6("log_loss").alias("log_loss"), r6("brier").alias("brier"), "n")


def _rounded(df, *keep):
    return df.select(*[r6(c).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes])


@query(
    "roi_summary",
    T.sql(
        *RATED_EV, T.odds_sql("ev"), T.bets_sql("ev", dedup="late", fallback="both"),
        select=f"SELECT {T.r6('sum(profit) / sum(stake) * 100')} AS roi, {T.r6('avg(bet_won)')} AS accuracy, {T.r6('avg(' + log_loss_sql('prob', 'bet_won', '1e-10') + ')')} AS log_loss, {T.r6('avg((prob - bet_won) * (prob - bet_won))')} AS brier, {T.r6('sum(stake)::DOUBLE')} AS wagered, {T.r6('sum(payout)')} AS returned, {T.r6('sum(profit)')} AS profit, count(*) AS bets FROM bets",
    ),
)
def roi_summary(t):
    return _rounded(M.roi_summary(bets_events(t, dedup="late", fallback="both")))


DAILY = "dd AS (SELECT candidate_id, day, sum(stake)::DOUBLE AS stake, sum(profit) AS profit, sum(bet_won) AS wins, count(*) AS bets FROM bets GROUP BY ALL)"
EXTENDED = """dx AS (SELECT *, profit / stake * 100 AS roi, sum(profit) OVER w / sum(stake) OVER w * 100 AS cum_roi, row_number() OVER w - 1 AS x FROM dd WINDOW w AS (PARTITION BY candidate_id ORDER BY day))"""
EXT_COLS = f"""{T.r6('CASE WHEN count(*) >= 2 THEN regr_slope(cum_roi, x) END')} AS trend, {T.r6('CASE WHEN count(*) >= 2 AND stddev_samp(roi) > 0 THEN avg(roi) / stddev_samp(roi) * sqrt(52) END')} AS sharpe, {T.r6('min(roi)')} AS min_roi, {T.r6('max(roi)')} AS max_roi,
  {T.r6('sum(wins) / sum(bets)')} AS win_rate, sum(bets)::BIGINT AS bets, {T.r6('sum(stake)')} AS wagered, {T.r6('sum(profit)')} AS profit"""


@query("roi_extended", T.sql(*BETS_EV, DAILY, EXTENDED, select=f"SELECT {EXT_COLS} FROM dx"))
def roi_extended(t):
    return _rounded(M.roi_extended(bets_events(t)))


def _over_time_sql(fmt):
    return f"""ot0 AS (SELECT strftime(day, '{fmt}') AS period, sum(stake)::DOUBLE AS wagered, sum(payout) AS returned, sum(profit) AS profit, sum(bet_won)::BIGINT AS wins, count(*) AS bets, avg(prob) AS mean_prob FROM bets GROUP BY ALL),
ot AS (SELECT *, profit / wagered * 100 AS roi, wins / bets AS accuracy, sum(wagered) OVER w AS cum_wagered, sum(returned) OVER w AS cum_returned, sum(profit) OVER w AS cum_profit, (sum(wins) OVER w)::BIGINT AS cum_wins,
  (sum(bets) OVER w)::BIGINT AS cum_bets, sum(profit) OVER w / sum(wagered) OVER w * 100 AS cum_roi FROM ot0 WINDOW w AS (ORDER BY period))"""


_OT = "SELECT period, wins, bets, cum_wins, cum_bets, " + ", ".join(
    f"{T.r6(c)} AS {c}" for c in ("wagered", "returned", "profit", "mean_prob", "roi", "accuracy", "cum_wagered", "cum_returned", "cum_profit", "cum_roi")
) + " FROM ot"


@query("roi_over_time_day", T.sql(*BETS_EV, _over_time_sql("%Y-%m-%d"), select=_OT))
def roi_over_time_day(t):
    return _rounded(M.roi_over_time(bets_events(t), "day"))


@query("roi_over_time_month", T.sql(*BETS_OC, _over_time_sql("%Y-%m"), select=_OT))
def roi_over_time_month(t):
    return _rounded(M.roi_over_time(bets_orders(t), "month"))


@query("roi_over_time_year", T.sql(*BETS_OC, _over_time_sql("%Y"), select=_OT))
def roi_over_time_year(t):
    return _rounded(M.roi_over_time(bets_orders(t), "year"))


@query(
    "roi_period_counts",
    T.sql(*BETS_OC, _over_time_sql("%Y-%m"), select=f"SELECT count(*) AS periods, count(*) FILTER (WHERE profit > 0) AS profitable, count(*) FILTER (WHERE profit < 0) AS losing, {T.r6('avg((profit > 0)::INT) * 100')} AS profitable_share, {T.r6('avg((profit < 0)::INT) * 100')} AS losing_share FROM ot"),
)
def roi_period_counts(t):
    return _rounded(M.period_counts(M.roi_over_time(bets_orders(t), "month")))


@query(
    "roi_first_last",
    T.sql(*BETS_OC, _over_time_sql("%Y-%m"), select=f"SELECT period, bets, {T.r6('roi')} AS roi, from_start, from_end FROM (SELECT *, row_number() OVER (ORDER BY period)::INT AS from_start, row_number() OVER (ORDER BY period DESC)::INT AS from_end FROM ot) WHERE from_start <= 5 OR from_end <= 5"),
)
def roi_first_last(t):
    return M.first_and_last(M.roi_over_time(bets_orders(t), "month"), 5).select("period", "bets", r6("roi").alias("roi"), "from_start", "from_end")


BOOKS = ["american", "book_a", "book_b", "book_c"]
_BOOKS_SQL = f"""bl AS (SELECT odds_seq, day, player, opponent, result, unnest(['american', 'book_a', 'book_b', 'book_c']) AS book, unnest([american, book_a, book_b, book_c]) AS price FROM odds),
b1 AS (SELECT * FROM bl WHERE price IS NOT NULL AND result IN (0, 1) QUALIFY row_number() OVER (PARTITION BY book, {T.PAIR} ORDER BY odds_seq) = 1),
bk AS (SELECT book, {PM.replace('1e-15', '1e-10')} FROM (SELECT *, 1.0 / {T.DECIMAL.replace('american', 'price')} AS prob FROM b1 WHERE price <> 0) GROUP BY book)"""


@query("odds_source_comparison", T.sql(T.EV, T.odds_sql("ev"), _BOOKS_SQL, select="SELECT * FROM bk"))
def odds_source_comparison(t):
    return _rounded(M.compare_books(t.odds(t.events_contests()), BOOKS))


@query("best_books", T.sql(T.EV, T.odds_sql("ev"), _BOOKS_SQL, select="SELECT arg_max(book, (accuracy, book)) AS best_accuracy, arg_min(book, (log_loss, book)) AS best_log_loss, arg_min(book, (brier, book)) AS best_brier FROM bk"))
def best_books(t):
    return M.best_books(_rounded(M.compare_books(t.odds(t.events_contests()), BOOKS)))
