import pytest
from pyspark.sql import functions as F

from boutline.functions import buckets as B
from boutline.functions import fitness as FIT
from boutline.functions import scalar as S


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("american,decimal", [(150.0, 2.5), (-200.0, 1.5), (10000.0, 101.0), (-10000.0, 1.01), (0.0, None), (100.0, 2.0)])
def test_decimal_odds(spark, american, decimal):
    got = one(spark, S.decimal_odds("o"), o=american)
    assert got == (None if decimal is None else pytest.approx(decimal))


@pytest.mark.parametrize("cell,truth", [("1", True), (" TRUE ", True), ("1.0", True), ("0", False), ("yes", False), ("", False)])
def test_text_flag(spark, cell, truth):
    assert one(spark, S.text_flag("c"), c=cell) is truth


def test_null_flag_is_false(spark):
    assert one(spark, S.text_flag(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize("p,d,want", [(0.6, 2.0, 0.2), (0.4, 2.0, -0.2), (0.5, 2.0, 0.0), (0.5, 1.0, None)])
def test_kelly(spark, p, d, want):
    got = one(spark, S.kelly_fraction("p", "d"), p=p, d=d)
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("name,want", [("Mateusz Rębecki", "mateusz rebecki"), ("  José  de  ALDO ", "jose de aldo"), ("Zoë", "zoe")])
def test_fold_name(spark, name, want):
    assert one(spark, S.fold_name("n"), n=name) == want


def test_decay(spark):
    assert one(spark, S.linear_decay_factor("d", 0.001, 180), d=280) == pytest.approx(0.9)
    assert one(spark, S.linear_decay_factor("d", 0.01, 180), d=5000) == 0.5
    assert one(spark, S.exponential_decay_factor("d", 0.001, 180), d=179) == 1.0
    assert one(spark, S.multiphase_factor("d", 30, 1.1, 180, 0.001), d=29) == 1.1
    assert one(spark, S.multiphase_factor("d", 30, 1.1, 180, 0.001), d=180) == 1.0


def test_buckets_edges(spark):
    assert [one(spark, B.experience("n"), n=n) for n in (5, 6, 15, 16, 50, 51)] == ["Unknown", "Novice", "Novice", "Experienced", "Experienced", "Veteran"]
    assert [one(spark, B.layoff("n"), n=n) for n in (90, 91, 180, 181, 274, 275)] == ["Recent", "Medium", "Medium", "Long", "Long", "Very Long"]
    assert [one(spark, B.rating_tier("d"), d=d) for d in (-200.1, -200.0, 0.0, 199.9, 200.0)] == ["<-200", "[-200, -100)", "[0, 100)", "[100, 200)", ">=200"]
    assert [one(spark, B.left_closed_bin("p"), p=p) for p in (0.0, 0.1, 0.3, 1.0)] == [0, 1, 3, 9]
    assert [one(spark, B.right_closed_decile("p"), p=p) for p in (0.0, 0.1, 0.10001, 0.3, 1.0)] == [0, 0, 1, 2, 9]


def test_weights():
    assert FIT.check_weights(None) == FIT.MULTI_WEIGHTS
    assert FIT.check_weights('{"roi": 2, "ece": 2}') == {"roi": 0.5, "ece": 0.5}
    for bad in ("[1]", "{", '{"luck": 1}', '{"roi": -1}', '{"roi": 0}', '{"roi": "x"}'):
        with pytest.raises(ValueError):
            FIT.check_weights(bad)


def test_split_objectives(spark):
    assert one(spark, FIT.split_fitness("m", "s", "cv"), m=10.0, s=2.0) == pytest.approx(80.0)
    assert one(spark, FIT.coefficient_of_variation("m", "s"), m=0.0, s=1.0) == 1e6
    with pytest.raises(ValueError):
        FIT.split_fitness("m", "s", "other")
