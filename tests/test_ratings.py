import pytest
from helpers import contest_rows, contests, plain_scan

from boutline.operators import history as H
from boutline.operators import ratings as R

ROWS = contest_rows()


def collected(df):
    return {r["seq"]: (r["pre"], r["opp_pre"], r["post"], r["opp_post"]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_grouped_scan_equals_row_by_row(spark):
    same(collected(R.rate(contests(spark, ROWS), [{"k": 32.0}], strategy="grouped")), plain_scan(ROWS))


def test_blocks_equal_row_by_row_even_with_a_hot_player(spark):
    rows = contest_rows(60, hot="p0")
    same(collected(R.rate(contests(spark, rows), [{"k": 32.0}], strategy="blocks", block_rows=25)), plain_scan(rows))


def test_block_bounds_split_a_heavy_day(spark):
    rows = contest_rows(40, per_day=40)
    prepared = R.scan_input(contests(spark, rows), [{"k": 32.0}])
    bounds = R.block_bounds(prepared, ["candidate_id"], 15)
    assert len(bounds) > 2
    sizes = prepared.withColumn("b", R._block_of(bounds)).groupBy("b").count().collect()
    assert sum(r["count"] for r in sizes) == 40 and max(r["count"] for r in sizes) <= 15
    same(collected(R.rate(contests(spark, rows), [{"k": 32.0}], strategy="blocks", block_rows=15)), plain_scan(rows))


def test_waves_equal_row_by_row(spark):
    rows = contest_rows(12, players=8)
    same(collected(R.scan_waves(R.scan_input(contests(spark, rows), [{"k": 32.0}]), ["candidate_id"], min_wave_rows=0)), plain_scan(rows))


def test_waves_hand_the_rest_to_blocks(spark):
    rows = contest_rows(60, players=30, hot="p0")
    out = R.scan_waves(R.scan_input(contests(spark, rows), [{"k": 32.0}]), ["candidate_id"], limit=20, min_wave_rows=9)
    same(collected(out), plain_scan(rows))


def test_strategies_agree_and_unknown_ones_are_refused(spark):
    for strategy in ("grouped", "blocks", "waves"):
        same(collected(R.rate(contests(spark, ROWS), [{"k": 32.0}], strategy=strategy, block_rows=70, min_wave_rows=5)), plain_scan(ROWS))
    with pytest.raises(ValueError):
        R.rate(contests(spark, ROWS), [{"k": 32.0}], strategy="auto")


def test_partitioning_of_the_input_does_not_matter(spark):
    c = contests(spark, ROWS)
    same(collected(R.rate(c.repartition(7, "player"), [{"k": 32.0}])), collected(R.rate(c.coalesce(1), [{"k": 32.0}])))


def test_rating_sum_is_conserved(spark):
    last = H.latest_ratings(H.history(R.rate(contests(spark, ROWS), [{"k": 32.0}]))).collect()
    assert sum(r["rating"] for r in last) == pytest.approx(1500.0 * len(last))


def test_candidates_and_keys_are_independent(spark):
    from pyspark.sql import functions as F

    c = contests(spark, ROWS).withColumn("league", F.lit(1)).unionByName(contests(spark, ROWS).withColumn("league", F.lit(2)))
    out = R.rate(c, [{"k": 32.0}, {"k": 64.0}], keys=["league"])
    for k, i in ((32.0, 0), (64.0, 1)):
        for league in (1, 2):
            same(collected(out.filter((F.col("candidate_id") == i) & (F.col("league") == league))), plain_scan(ROWS, k))


def test_missing_results_are_left_out_of_the_scan(spark):
    rows = [list(r) for r in ROWS[:20]]
    rows[3][5], rows[3][6], rows[3][7], rows[3][8] = None, None, None, False
    kept = [r for i, r in enumerate(rows) if i != 3]
    same(collected(R.rate(contests(spark, [tuple(r) for r in rows]), [{"k": 32.0}])), plain_scan(kept))


def test_decay_changes_expectation_but_starts_from_the_plain_rating(spark):
    c = contests(spark, ROWS)
    plain = collected(R.rate(c, [{"k": 32.0, "decay_mode": "linear", "decay_rate": 0.0}], decay=True))
    same(plain, plain_scan(ROWS))
    d = R.rate(c, [{"k": 32.0, "decay_mode": "linear", "decay_rate": 0.01, "min_days": 5.0}], decay=True).collect()
    assert any(abs(r["adj_pre"] - r["pre"]) > 1 for r in d)
    first = min(d, key=lambda r: (r["day"], r["seq"]))
    assert first["adj_pre"] == first["pre"] == 1500.0


def test_moving_up_in_weight(spark):
    import datetime as dt

    base = list(contest_rows(2, players=2, per_day=1))
    a = list(base[0]); b = list(base[1])  # noqa: E702
    a[3:6], b[3:6] = ["x", "y", 1.0], ["x", "y", 1.0]
    a[6:9], b[6:9] = [1, 0, False], [1, 0, False]
    a[9:11], b[9:11] = [60.0, 70.0], [70.0, 70.0]
    b[1] = a[1] + dt.timedelta(days=3)
    c = contests(spark, [tuple(a), tuple(b)])
    moved = {r["seq"]: r for r in R.weight_moves(c).collect()}
    assert (moved[0]["moved_up"], moved[1]["moved_up"], moved[1]["opp_moved_up"]) == (0, 1, 0)
    out = {r["seq"]: r for r in R.rate(c, [{"k": 32.0, "weight_moves": 1.0, "up_penalty": 0.9, "up_bonus": 1.1}], moves=True).collect()}
    plain = {r["seq"]: r for r in R.rate(c, [{"k": 32.0}]).collect()}
    assert out[1]["adj_pre"] == pytest.approx(out[1]["pre"] * 0.9)
    assert out[1]["post"] > plain[1]["post"] * 1.09


def test_bout_counts(spark):
    got = {r["seq"]: (r["bouts"], r["opp_bouts"]) for r in R.bout_counts(contests(spark, ROWS)).collect()}
    seen, want = {}, {}
    for r in ROWS:
        a, b = r[3], r[4]
        want[r[0]] = (seen.get(a, 0), seen.get(b, 0))
        seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
    assert got == want


def split_rows(n=90):
    """Two sets of players who never meet."""
    left = contest_rows(n, players=6, seed=3)
    right = [(r[0] + 10_000, r[1], r[2], "q" + r[3], "q" + r[4], *r[5:]) for r in contest_rows(n, players=6, seed=4)]
    return left + right


def test_one_history_is_played_in_several_tasks(spark):
    from pyspark.sql import functions as F

    from boutline.operators import scan

    rows = [(r[0] + 1000 * g, r[1], r[2], f"{g}{r[3]}", f"{g}{r[4]}", *r[5:]) for g in range(12) for r in contest_rows(20, seed=g)]
    c = contests(spark, rows)
    vectors = R.rate_vectors(c, [{"k": 32.0}, {"k": 64.0}])
    tasks = vectors.withColumn("task", F.spark_partition_id()).select("task", "seq").collect()
    assert len({r["task"] for r in tasks}) > 1 and len(tasks) == len(rows)
    bins = {r["who"]: r["_bin"] for r in scan.connected_bins(c, []).collect()}
    assert len(set(bins.values())) > 1
    assert all(bins[r[3]] == bins[r[4]] for r in rows)
    same(collected(scan.unfold(vectors).filter("candidate_id = 0")), plain_scan(rows))


@pytest.mark.parametrize("candidates", [1, 3, 30])
def test_vectors_across_blocks_equal_row_by_row(spark, candidates):
    from pyspark.sql import functions as F

    rows = split_rows()
    ks = [20.0 + 7 * i for i in range(candidates)]
    out = R.rate(contests(spark, rows), [{"k": k} for k in ks], block_rows=70).cache()
    for i in {0, candidates // 2, candidates - 1}:
        same(collected(out.filter(F.col("candidate_id") == i)), plain_scan(rows, ks[i]))


def test_candidates_are_not_unfolded_before_the_shuffle(spark):
    plan = R.rate_vectors(contests(spark, ROWS), [{"k": float(k)} for k in range(10, 500, 10)])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("few", [2, 40])
def test_vectors_with_decay_and_moves_equal_the_grouped_form(spark, few):
    from pyspark.sql import functions as F

    cands = [{"k": 32.0 + i, "decay_mode": ["linear", "exponential", "none"][i % 3], "decay_rate": 0.01, "min_days": 5.0, "weight_moves": float(i % 2), "up_penalty": 0.9, "up_bonus": 1.1, "scale": 300.0 + i} for i in range(few)]
    c = contests(spark, contest_rows(40, players=5))
    keys = ["candidate_id", "seq"]
    names = [*keys, "pre", "opp_pre", "post", "opp_post", "adj_pre", "adj_opp_pre"]
    a = R.rate(c, cands, decay=True, moves=True, block_rows=25).select(*names).orderBy(*keys).collect()
    b = R.rate(c, cands, decay=True, moves=True, strategy="grouped").select(*names).orderBy(*keys).collect()
    assert len(a) == len(b) == 40 * few
    for x, y in zip(a, b):
        assert tuple(x) == pytest.approx(tuple(y), abs=1e-9)


def test_vectors_of_an_empty_history(spark):
    c = contests(spark, ROWS).filter("seq < 0")
    assert R.rate(c, [{"k": 32.0}]).collect() == []
    assert R.rate(c, [{"k": 32.0}], decay=True).collect() == []
