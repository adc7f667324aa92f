"""From files to answers: stored column names, file order, holdout cards, and the example of the README."""

from __future__ import annotations

from boutline.functions.scalar import fold_name
from boutline.operators import bets, metrics, oos, ratings
from boutline.sources import contests


def write_files(tmp_path, own_names=False):
    head = "day_,player,opponent,result,win,loss,udec\n".replace("day_", "DATE") if own_names else "DATE,FIGHTER,opp_FIGHTER,result,win,loss,udec\n"
    names = ["Ann", "Bob", "Cy", "Di"]
    lines, prices = [], []
    for i in range(24):
        a, b = names[i % 4], names[(i + 1 + i // 8) % 4]
        won = i % 3 != 0
        day = f"2023-{1 + i // 2:02d}-{1 + 14 * (i % 2):02d}"
        lines.append(f"{day},{a},{b},{int(won)},{int(won)},{int(not won)},1")
        prices += [f"{day},{a},{b}, {'+' if i % 2 else '-'}1{i:02d}", f"{day},{b},{a},-110"]
    (tmp_path / "contests.csv").write_text(head + "\n".join(lines) + "\n")
    price_head = "DATE,player,opponent,american\n" if own_names else "DATE,FIGHTER,opp_FIGHTER,avg_odds\n"
    (tmp_path / "odds.csv").write_text(price_head + "\n".join(prices) + "\n")


def roi(spark, tmp_path):
    c = contests.clean_contests(contests.read_csv_text(spark, str(tmp_path / "contests.csv")))
    odds = contests.clean_odds(contests.read_csv_text(spark, str(tmp_path / "odds.csv")))
    rated = ratings.rate(c, [{"k": 170.0}, {"k": 250.0, "use_method": 0.0}], carry=["result", "is_draw"])
    return c, odds, metrics.roi_extended(bets.bet_records(rated, c, odds, keys=["candidate_id"]), ["candidate_id"]).orderBy("candidate_id").collect()


def test_readme_example_with_stored_and_own_names(spark, tmp_path):
    results = []
    for own in (False, True):
        folder = tmp_path / str(own)
        folder.mkdir()
        write_files(folder, own)
        c, _, rows = roi(spark, folder)
        assert [r.seq for r in c.orderBy("day", "seq").collect()] == list(range(24))
        assert len(rows) == 2
        results.append([tuple(r) for r in rows])
    assert results[0] == results[1]


def test_order_of_rows_follows_files_and_not_their_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text("DATE,player,opponent,result,win,loss\n" + "".join(f"2023-01-01,p{i}_{j},q,1,1,0\n" for j in range(400 * (3 - i))))
    want = [f"p{i}_{j}" for i in range(3) for j in range(400 * (3 - i))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            c = contests.clean_contests(contests.read_csv_text(spark, str(tmp_path)))
            assert [r.player for r in c.orderBy("seq").collect()] == want
            assert sorted(r.seq for r in c.collect()) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_holdout_cards_to_out_of_sample_roi(spark, tmp_path):
    write_files(tmp_path)
    (tmp_path / "cards.csv").write_text("date,fighter,opp_fighter,result,avg_odds, opp_avg_odds\r\n2024-02-01,Ann ,Bob,1, -150, +120\r\n2024-02-01,Cy,Di,0, +200,-250\r\n")
    c, odds, _ = roi(spark, tmp_path)
    cards = contests.clean_holdout(contests.read_csv_text(spark, str(tmp_path / "cards.csv")))
    assert [(r.seq, r.player, r.american, r.opp_american, r.is_draw) for r in cards.orderBy("seq").collect()] == [(0, "Ann", -150.0, 120.0, False), (1, "Cy", 200.0, -250.0, False)]
    cand = [{"k": 170.0}]
    own = cards.select("player", "opponent", "day", "american", cards.seq.alias("odds_seq"))
    prices = odds.select(own.columns).unionByName(own)
    got = oos.oos_bets(ratings.rate(c, cand), c, cards, prices, cand).collect()
    assert len(got) == 2


def test_names_of_all_latin_letters(spark):
    names = ["Nguyễn Đức", "Ǎlǐ", "ﬁn Ĳ", "José  Ñ", "Łukasz Øre", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(fold_name("n").alias("f")).collect()
    assert [r.f for r in rows] == ["nguyen đuc", "ali", "fin ij", "jose n", "łukasz øre", ""]


def test_idle_days_count_contests_without_result(spark):
    from helpers import contest_rows
    from helpers import contests as table

    base = contest_rows(3, players=2, seed=2)
    days = ["2020-01-01", "2020-06-01", "2020-06-20"]
    import datetime as dt

    rows = []
    for r, day, result in zip(base, days, (1.0, None, 1.0)):
        d = dt.date.fromisoformat(day)
        rows.append((r[0], d, dt.datetime(d.year, d.month, d.day), "p0", "p1", result, int(result == 1.0), int(result is None), False, *r[9:]))
    got = ratings.scan_input(table(spark, rows), [{"multiphase": 1.0, "quick_bump": 1.1}], decay=True).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2] and got[1]["_fa"] == 1.1
