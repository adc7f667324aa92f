"""SQL texts shared by the equivalence queries: derived tables and the rating recurrence as a recursive query."""

from __future__ import annotations

# Written out, so that a wrong default in the operators does not pass.
CANDIDATE = {
    "k": 32.0, "w_ko": 1.4, "w_sub": 1.3, "w_udec": 1.0, "w_mdec": 0.9, "w_sdec": 0.7, "scale": 400.0, "use_method": 1.0,
    "decay_mode": "none", "decay_rate": 0.0, "min_days": 180.0,
    "multiphase": 0.0, "quick_days": 30.0, "quick_bump": 1.0, "decay_days": 180.0, "phase_rate": 0.0,
    "weight_moves": 0.0, "up_penalty": 1.0, "up_bonus": 1.0,
}


def name_sql(u: str) -> str:
    return f"(CASE {u} % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'José' WHEN 2 THEN 'Zoë' WHEN 3 THEN 'Björn' ELSE 'Rębecki' END || ' P' || CAST({u} AS VARCHAR))"


def _flag_sql(code: str, result: str) -> str:
    out = []
    for i, (own, other) in enumerate((("ko", "kod"), ("subw", "subwd"), ("udec", "udecd"), ("mdec", "mdecd"), ("sdec", "sdecd"))):
        out.append(f"CASE WHEN {code} = {i} AND {result} >= 0.5 THEN ' 1 ' END AS {own}")
        out.append(f"CASE WHEN {code} = {i} AND {result} < 0.5 THEN 'True' END AS {other}")
    return ", ".join(out)


_EVC = "CASE a.event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"
_EVR = "CASE WHEN floor(a.value) > floor(b.value) THEN 1.0 WHEN floor(a.value) = floor(b.value) THEN 0.5 ELSE 0.0 END::DOUBLE"
_ORC = "CASE a.o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"
_ORR = "CASE WHEN a.o_totalprice > b.o_totalprice THEN 1.0 WHEN a.o_totalprice = b.o_totalprice THEN 0.5 ELSE 0.0 END::DOUBLE"

_TAIL = f"""SELECT *, (result = 1.0)::INT AS win, (result = 0.0)::INT AS loss, (result = 0.5) AS is_draw, {_flag_sql('code', 'result')}"""

EV = f"""ev AS ({_TAIL} FROM (
  SELECT a.event_id // 2 AS seq, a.ts AS played_at, CAST(a.ts AS DATE) AS day, {name_sql('a.user_id')} AS player, {name_sql('b.user_id')} AS opponent,
    {_EVR} AS result, {_EVC} AS code,
    CASE WHEN (a.event_id // 2) % 3 <> 0 THEN floor(json_extract_string(a.props, '$.k')::INT / 10.0) * 10 END::DOUBLE AS weight,
    CASE WHEN (a.event_id // 2) % 4 <> 0 THEN floor(json_extract_string(b.props, '$.k')::INT / 10.0) * 10 END::DOUBLE AS opp_weight,
    (floor((json_extract_string(a.props, '$.k')::INT + json_extract_string(b.props, '$.k')::INT) / 20.0) * 10)::DOUBLE AS contest_weight,
    a.value AS stat, b.value AS opp_stat, ((a.event_id // 2) % 3 + 1)::INT AS round
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id))"""

OC = f"""oc AS ({_TAIL} FROM (
  SELECT a.o_orderkey // 2 AS seq, a.o_orderdate AS played_at, CAST(a.o_orderdate AS DATE) AS day, {name_sql('a.o_custkey')} AS player, {name_sql('b.o_custkey')} AS opponent,
    {_ORR} AS result, {_ORC} AS code
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 2 = 0 AND a.o_custkey <> b.o_custkey))"""

BASE = {"ev": EV, "oc": OC}
PRICE = "CASE WHEN seq % 7 <> 0 THEN CASE WHEN seq % 3 = 0 THEN -(seq * 37 % 300 + 100) ELSE seq * 53 % 300 + 100 END END::DOUBLE"


def odds_sql(src: str, name: str = "odds") -> str:
    return f"""{name}_0 AS (SELECT *, {PRICE} AS base FROM {src}),
{name} AS (SELECT odds_seq, seq, day, player, opponent, american, american + sign(american) * 5 AS book_a, american + sign(american) * (seq % 11) AS book_b,
    CASE WHEN seq % 5 <> 0 THEN american + sign(american) * (seq % 23) END AS book_c, result
  FROM (SELECT seq * 2 AS odds_seq, seq, day, player, opponent, base AS american, result FROM {name}_0
    UNION ALL SELECT seq * 2 + 1, seq, day, opponent, player, -base, 1.0 - result FROM {name}_0 WHERE seq % 10 <> 3))"""


def holdout_sql(src: str, days: int | None, name: str = "hold") -> str:
    def spell(c, tag):
        last = "'New N' || seq" if tag == "N" else c
        return f"CASE seq % 4 WHEN 0 THEN {c} WHEN 1 THEN upper({c}) WHEN 2 THEN replace({c}, ' ', '  de ') ELSE {last} END AS {c}"

    return f"""{name} AS (SELECT seq, played_at, day, {spell('player', 'N')}, {spell('opponent', 'O')}, result, is_draw, {PRICE} AS american, -({PRICE}) AS opp_american
  FROM {src}{"" if days is None else f" WHERE day > (SELECT max(day) FROM {src}) - {days}"})"""


def sides_sql(src: str, name: str, cols: str = "") -> str:
    extra = f", {cols}" if cols else ""
    return f"""{name} AS (SELECT seq, day, 0 AS side, player AS who, opponent AS versus{extra} FROM {src} UNION ALL SELECT seq, day, 1, opponent, player{extra} FROM {src})"""


def hit(m: str) -> str:
    own, other = {"ko": ("ko", "kod"), "sub": ("subw", "subwd"), "udec": ("udec", "udecd"), "mdec": ("mdec", "mdecd"), "sdec": ("sdec", "sdecd")}[m]

    def truth(c):
        return f"coalesce(lower(trim({c})) IN ('1', 'true'), false)"

    return f"({truth(own)} OR {truth(other)})"


def multiplier_sql(weights: dict | None = None, prefix: str = "") -> str:
    w = weights or {m: f"{prefix}w_{m}" for m in ("ko", "sub", "udec", "mdec", "sdec")}
    return "CASE " + " ".join(f"WHEN {hit(m)} THEN {w[m]}" for m in ("ko", "sub", "udec", "mdec", "sdec")) + " ELSE 1.0 END"


def idle_sql(src: str, name: str = "idle") -> str:
    return f"""{sides_sql(src, name + '_s')},
{name}_l AS (SELECT seq, side, date_diff('day', max(day) OVER (PARTITION BY who ORDER BY day, seq, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day) AS d FROM {name}_s),
{name} AS (SELECT seq, max(CASE WHEN side = 0 THEN d END) AS idle, max(CASE WHEN side = 1 THEN d END) AS opp_idle FROM {name}_l GROUP BY seq)"""


def moves_sql(src: str, name: str = "moves") -> str:
    return f"""{name}_s AS (SELECT seq, day, 0 AS side, player AS who, coalesce(weight, contest_weight) AS w FROM {src}
    UNION ALL SELECT seq, day, 1, opponent, coalesce(opp_weight, contest_weight) FROM {src}),
{name}_d AS (SELECT who, day, max_by(w, seq * 2 + side) AS w FROM {name}_s WHERE w IS NOT NULL GROUP BY who, day),
{name}_l AS (SELECT s.seq, s.side, s.w, d.w AS pw FROM {name}_s s ASOF LEFT JOIN {name}_d d ON s.who = d.who AND s.day > d.day),
{name} AS (SELECT seq, max(CASE WHEN side = 0 THEN coalesce(w > pw, false)::INT END) AS moved_up, max(CASE WHEN side = 1 THEN coalesce(w > pw, false)::INT END) AS opp_moved_up,
    max(CASE WHEN side = 0 THEN coalesce(w < pw, false)::INT END) AS moved_down, max(CASE WHEN side = 1 THEN coalesce(w < pw, false)::INT END) AS opp_moved_down,
    max(CASE WHEN side = 0 THEN pw END) AS prev_weight, max(CASE WHEN side = 1 THEN pw END) AS opp_prev_weight FROM {name}_l GROUP BY seq)"""


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE"


def cands_sql(candidates: list[dict], name: str = "cand") -> str:
    cols = list(CANDIDATE)
    rows = ", ".join(f"({i}, " + ", ".join(_lit({**CANDIDATE, **c}[k]) for k in cols) + ")" for i, c in enumerate(candidates))
    return f"{name}(candidate_id, {', '.join(cols)}) AS (VALUES {rows})"


def factor_sql(d: str) -> str:
    lin = f"CASE WHEN {d} IS NULL OR {d} < min_days THEN 1.0 ELSE greatest(0.5, 1.0 - decay_rate * ({d} - min_days)) END"
    exp = f"CASE WHEN {d} IS NULL OR {d} < min_days THEN 1.0 ELSE greatest(0.5, exp(-decay_rate * ({d} - min_days))) END"
    multi = f"CASE WHEN {d} IS NULL THEN 1.0 WHEN {d} < quick_days THEN quick_bump WHEN {d} > decay_days THEN greatest(0.5, exp(-phase_rate * ({d} - decay_days))) ELSE 1.0 END"
    return f"(CASE WHEN multiphase = 1 THEN {multi} WHEN decay_rate > 0 AND decay_mode = 'linear' THEN {lin} WHEN decay_rate > 0 AND decay_mode = 'exponential' THEN {exp} ELSE 1.0 END)"


def scan_sql(src: str, candidates: list[dict], decay: bool = False, moves: bool = False, name: str = "rated", key: str = "", last_day: str = "") -> str:
    """CTEs ending in ``name``: the rows of ``src`` times the parameter sets with ratings before and after.

    Each recursion step plays every contest whose two players have no earlier contest left. Must be used under WITH RECURSIVE.
    """
    k = f"{key}, " if key else ""
    parts = [cands_sql(candidates, f"{name}_c")]
    joins = ""
    if decay:
        parts.append(idle_sql(src, f"{name}_i"))
        joins += f" LEFT JOIN {name}_i USING (seq)"
    if moves:
        parts.append(moves_sql(src, f"{name}_m"))
        joins += f" LEFT JOIN {name}_m USING (seq)"
    fa = factor_sql("idle") if decay else "1.0"
    fb = factor_sql("opp_idle") if decay else "1.0"
    up = "weight_moves = 1 AND moved_up = 1" if moves else "false"
    oup = "weight_moves = 1 AND opp_moved_up = 1" if moves else "false"
    parts.append(
        f"""{name}_p AS MATERIALIZED (SELECT {k}candidate_id, seq, day, player, opponent,
    CASE WHEN is_draw THEN 0.5 ELSE result END::DOUBLE AS s, (k * (CASE WHEN use_method = 1 THEN {multiplier_sql()} ELSE 1.0 END) * CASE WHEN is_draw THEN 0.5 ELSE 1.0 END)::DOUBLE AS keff, scale,
    ({fa} * CASE WHEN {up} THEN up_penalty ELSE 1.0 END)::DOUBLE AS fa, ({fb} * CASE WHEN {oup} THEN up_penalty ELSE 1.0 END)::DOUBLE AS fb,
    (CASE WHEN {up} AND result = 1 AND NOT is_draw THEN up_bonus ELSE 1.0 END)::DOUBLE AS ba, (CASE WHEN {oup} AND result = 0 AND NOT is_draw THEN up_bonus ELSE 1.0 END)::DOUBLE AS bb
  FROM {src}{joins} CROSS JOIN {name}_c WHERE result IS NOT NULL OR is_draw)"""
    )
    same = lambda a, b: f"{a}.candidate_id = {b}.candidate_id" + (f" AND {a}.{key} = {b}.{key}" if key else "")
    parts.append(
        f"""{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {k}candidate_id, who ORDER BY day, seq, side) - 1 AS nth FROM (
    SELECT {k}candidate_id, seq, day, 0 AS side, player AS who, opponent AS versus, s, keff, scale, fa AS f, fb AS g, ba AS b, bb AS c FROM {name}_p
    UNION ALL SELECT {k}candidate_id, seq, day, 1, opponent, player, 1.0 - s, keff, scale, fb, fa, bb, ba FROM {name}_p)),
{name}_x AS MATERIALIZED (SELECT l.*, o.nth AS other_nth FROM {name}_l l JOIN {name}_l o ON {same('l', 'o')} AND l.seq = o.seq AND l.side <> o.side)"""
    )
    parts.append(
        f"""{name}_r AS (SELECT DISTINCT {k}candidate_id, who, 0::BIGINT AS done, 1500.0::DOUBLE AS rating, NULL::BIGINT AS seq, NULL::INT AS side, NULL::DOUBLE AS pre, NULL::DOUBLE AS opp_pre,
    NULL::DOUBLE AS post, NULL::DOUBLE AS opp_post, NULL::DOUBLE AS adj_pre, NULL::DOUBLE AS adj_opp_pre FROM {name}_x
  UNION ALL SELECT {k}candidate_id, who, CASE WHEN met THEN done + 1 ELSE done END, CASE WHEN met THEN na ELSE ra END, CASE WHEN met THEN seq END, side, ra, rb, na, nb, xa, xb FROM (
    SELECT *, (ra + keff * (s - 1.0 / (1.0 + pow(10.0, (xb - xa) / scale)))) * b AS na, (rb + keff * ((1.0 - s) - 1.0 / (1.0 + pow(10.0, (xa - xb) / scale)))) * c AS nb FROM (
      SELECT *, ra * f AS xa, rb * g AS xb FROM (
        SELECT x.*, r.done, r.rating AS ra, o.rating AS rb, o.who IS NOT NULL AS met
        FROM {name}_r r JOIN {name}_x x ON {same('x', 'r')} AND x.who = r.who AND x.nth = r.done
        LEFT JOIN {name}_r o ON {same('o', 'r')} AND o.who = x.versus AND o.done = x.other_nth))))"""
    )
    parts.append(
        f"""{name} AS MATERIALIZED (SELECT r.candidate_id, {'r.' + key + ', ' if key else ''}r.pre, r.opp_pre, r.post, r.opp_post, r.adj_pre, r.adj_opp_pre, e.* {'EXCLUDE (' + key + ')' if key else ''}
  FROM {name}_r r JOIN {src} e ON e.seq = r.seq{f' AND e.{key} = r.{key}' if key else ''} WHERE r.seq IS NOT NULL AND r.side = 0)"""
    )
    return ",\n".join(parts)


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def r6(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def firsts_sql(src: str, name: str = "fd") -> str:
    return f"""{sides_sql(src, name + '_s')},
{name} AS (SELECT who, min(day) AS d FROM {name}_s GROUP BY who)"""


DECIDED = "result IN (0.0, 1.0) AND NOT is_draw"
PAIR = "least(player, opponent), greatest(player, opponent), day"


def pred_sql(src: str, dedup: bool = False, rated: str = "rated", name: str = "pred") -> str:
    """Eligible predictions with probability; needs ``rated``."""
    first = f" QUALIFY row_number() OVER (PARTITION BY candidate_id, {PAIR} ORDER BY seq) = 1" if dedup else ""
    return f"""{firsts_sql(src, name + '_fd')},
{name}_0 AS (SELECT * FROM {rated} WHERE {DECIDED}{first}),
{name} AS (SELECT r.*, (pre > opp_pre)::INT AS picked, ((pre > opp_pre)::INT = result)::INT AS correct, pre - opp_pre AS diff, 1.0 / (1.0 + pow(10.0, -(pre - opp_pre) / 400.0)) AS prob
  FROM {name}_0 r JOIN {name}_fd a ON a.who = r.player JOIN {name}_fd b ON b.who = r.opponent WHERE pre <> opp_pre AND r.day > a.d AND r.day > b.d)"""


def prices_sql(odds: str = "odds", name: str = "prices") -> str:
    return f"{name} AS (SELECT player, opponent, day, max_by(american, odds_seq) AS american FROM {odds} WHERE american IS NOT NULL GROUP BY ALL)"


DECIMAL = "(CASE WHEN american > 0 THEN american / 100.0 + 1.0 WHEN american < 0 THEN 100.0 / abs(american) + 1.0 END)"


def bets_sql(src: str, dedup: str = "early", fallback: str = "strict", lookback: int = 0, rated: str = "rated", odds: str = "odds", name: str = "bets") -> str:
    first = f" QUALIFY row_number() OVER (PARTITION BY candidate_id, {PAIR} ORDER BY seq) = 1"
    look = f" AND day > (SELECT max(day) FROM {rated}) - {lookback}" if lookback else ""
    price = {
        "strict": f"JOIN {name}_px o ON o.player = k.bet_on AND o.opponent = k.bet_against AND o.day = k.day",
        "mirror": f"LEFT JOIN {name}_px o ON o.player = k.bet_on AND o.opponent = k.bet_against AND o.day = k.day LEFT JOIN {name}_px q ON q.opponent = k.bet_on AND q.player = k.bet_against AND q.day = k.day",
        "both": f"JOIN {name}_px o ON o.player = k.bet_on AND o.opponent = k.bet_against AND o.day = k.day JOIN {name}_px q ON q.player = k.player AND q.opponent = k.opponent AND q.day = k.day",
    }[fallback]
    american = "coalesce(o.american, q.american)" if fallback == "mirror" else "o.american"
    return f"""{firsts_sql(src, name + '_fd')},
{prices_sql(odds, name + '_px')},
{name}_0 AS (SELECT * FROM {rated} WHERE {DECIDED}{look}{first if dedup == 'early' else ''}),
{name}_1 AS (SELECT r.*, CASE WHEN pre > opp_pre THEN player ELSE opponent END AS bet_on, CASE WHEN pre > opp_pre THEN opponent ELSE player END AS bet_against,
    (CASE WHEN pre > opp_pre THEN result = 1 ELSE result = 0 END)::INT AS bet_won, abs(pre - opp_pre) AS diff, 1.0 / (1.0 + pow(10.0, -abs(pre - opp_pre) / 400.0)) AS prob
  FROM {name}_0 r JOIN {name}_fd a ON a.who = r.player JOIN {name}_fd b ON b.who = r.opponent WHERE pre <> opp_pre AND r.day > a.d AND r.day > b.d{first if dedup == 'late' else ''}),
{name} AS (SELECT *, 1.0 AS stake, CASE WHEN bet_won = 1 THEN decimal ELSE 0.0 END AS payout, CASE WHEN bet_won = 1 THEN decimal - 1.0 ELSE -1.0 END AS profit
  FROM (SELECT *, {DECIMAL} AS decimal FROM (SELECT k.*, {american} AS american FROM {name}_1 k {price})) WHERE decimal IS NOT NULL)"""
