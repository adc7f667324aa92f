"""Small fixtures and a plain-Python model of the recurrence to compare with."""

from __future__ import annotations

import datetime as dt
import random

from boutline.sources.contests import FLAGS

SCHEMA = (
    "seq long, day date, played_at timestamp_ntz, player string, opponent string, result double, win int, loss int, is_draw boolean, "
    "weight double, opp_weight double, contest_weight double, round int, " + ", ".join(f"{f} string" for f in FLAGS)
)
METHOD = {"ko": 1.4, "subw": 1.3, "udec": 1.0, "mdec": 0.9, "sdec": 0.7}


def contest_rows(n=120, players=9, seed=1, per_day=3, hot=None):
    """Random contests; with ``hot`` that player takes part in a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=(i // per_day) * 9)
        a, b = rng.sample([f"p{j}" for j in range(players)], 2)
        if hot and i % 3 == 0:
            a = hot
        if a == b:
            b = "other"
        res = rng.choice([1.0, 0.0, 1.0, 0.0, 0.5])
        flag = rng.choice(list(METHOD))
        w, v = float(rng.choice([60, 70, 80])), float(rng.choice([60, 70, 80]))
        flags = {f: ("1" if f == flag else None) for f in FLAGS}
        rows.append(
            (i, day, dt.datetime(day.year, day.month, day.day), a, b, res, int(res == 1), int(res == 0), res == 0.5, w, v, 70.0, 1, *[flags[f] for f in FLAGS])
        )
    return rows


def contests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_scan(rows, k=32.0, scale=400.0):
    """Reference recurrence with method weights and the draw rule, row by row."""
    ratings, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        seq, a, b, res, draw = r[0], r[3], r[4], r[5], r[8]
        flag = next(f for f, v in zip(FLAGS, r[13:]) if v == "1")
        keff = k * METHOD[flag] * (0.5 if draw else 1.0)
        s = 0.5 if draw else res
        ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        ea, eb = 1 / (1 + 10 ** ((rb - ra) / scale)), 1 / (1 + 10 ** ((ra - rb) / scale))
        ratings[a], ratings[b] = ra + keff * (s - ea), rb + keff * ((1 - s) - eb)
        out[seq] = (ra, rb, ratings[a], ratings[b])
    return out
