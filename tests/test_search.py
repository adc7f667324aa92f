"""Searches that go on after a lost driver, their statistics, and the documents of a run."""

from __future__ import annotations

import json

import pytest
from helpers import contest_rows
from helpers import contests as table
from pyspark.sql import functions as F

from boutline.operators import documents as D
from boutline.operators import sweep as Z
from boutline.sources import sinks


def scorer(spark, calls):
    def score(cands):
        calls.append(len(cands))
        if calls.count(0):
            raise RuntimeError("driver lost")
        return spark.createDataFrame([(i, -abs(c["k"] - 222.0), c["w_ko"]) for i, c in enumerate(cands)], "candidate_id int, fitness double, oos_accuracy double")

    return score


def rows(df):
    return sorted((r.generation, r.candidate_id, r.fitness, r.oos_accuracy, tuple(sorted(r.params.items()))) for r in df.collect())


def test_resumed_search_ends_like_an_undisturbed_one(spark, tmp_path):
    bounds, calls = Z.search_bounds(), []
    whole = rows(Z.resumable_search(spark, scorer(spark, calls), bounds, 5, 3, str(tmp_path / "a")))
    assert calls == [5, 5, 5] and len(whole) == 15

    def dies(cands):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("driver lost")
        return scorer(spark, [])(cands)

    seen = []
    with pytest.raises(RuntimeError):
        Z.resumable_search(spark, dies, bounds, 5, 3, str(tmp_path / "b"))
    # rows without their marker do not count
    spark.read.parquet(str(tmp_path / "b/generation=0/rows")).limit(2).write.parquet(str(tmp_path / "b/generation=1/rows"))
    again = []
    assert rows(Z.resumable_search(spark, scorer(spark, again), bounds, 5, 3, str(tmp_path / "b"))) == whole
    assert again == [5, 5]
    more = []
    longer = rows(Z.resumable_search(spark, scorer(spark, more), bounds, 5, 4, str(tmp_path / "b")))
    assert more == [5] and longer[:15] == whole
    best = [max(r[2] for r in longer if r[0] == g) for g in range(4)]
    assert best == sorted(best)
    with pytest.raises(ValueError):
        Z.resumable_search(spark, scorer(spark, []), bounds, 5, 3, str(tmp_path / "b"), seed=1)


def test_search_stats_follow_the_best_so_far(spark):
    log = spark.createDataFrame([(0, 0, 0.5, 0.4), (0, 1, 0.7, None), (1, 0, 0.6, 0.9), (1, 1, 0.6, 0.1)], "generation int, candidate_id int, fitness double, oos_accuracy double")
    got = {r.generation: r for r in Z.search_stats(log).collect()}
    assert (got[0].best_candidate, got[0].best_candidate_oos, got[0].best_oos) == (1, None, 0.4)
    assert (got[1].best_candidate, got[1].best_candidate_oos, got[1].best, got[1].best_so_far) == (0, 0.9, 0.6, 0.7)


def test_documents_of_a_run_without_bets(spark, tmp_path):
    c = table(spark, contest_rows(60))
    none = spark.createDataFrame([], "odds_seq long, day date, player string, opponent string, american double")
    configs = [{"name": "plain", "params": {"k": 32.0}}, {"name": "wide", "params": {"k": 90.0, "scale": 300.0}}]
    evolution = spark.createDataFrame([(0, 1, 2.0), (0, 0, 1.0)], "candidate_id int, generation int, best double")
    docs = D.run_documents(c, none, configs, evolution=evolution, run={"seed": 7})
    folder = str(tmp_path / "run")
    sinks.write_documents(docs, f"{folder}/documents", "config")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_run(spark, folder)
    folder = str(tmp_path / "done")
    sinks.write_run(folder, docs, D.master_document(docs, {"seed": 7}))
    back, master = sinks.read_run(spark, folder)
    found = {r.config: json.loads(r.document) for r in back.filter(F.col("document").isNotNull()).collect()}
    plain = found["plain"]
    assert set(found) == {"plain", "wide"} and plain["run_info"]["seed"] == 7 and plain["best_params"] == {"k": 32.0}
    assert plain["summary"]["num_bets"] == 0 and plain["summary"]["roi_percent"] is None and "no bets" in plain["warnings"]
    assert plain["best_metrics"] == {"train": None, "val": None, "oos": None} and plain["roi_by_decile"] == []
    assert [e["generation"] for e in plain["evolution"]] == [0, 1] and found["wide"]["evolution"] == []
    assert sum(b["count"] for b in plain["calibration_curve"]) == plain["comprehensive_metrics"]["prob"]["n"] > 0
    top = json.loads(master.first().document)
    assert [x["config_name"] for x in top["configurations"]] == ["plain", "wide"] and not top["configurations"][0]["success"]
