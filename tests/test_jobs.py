"""The command surface and the strategy registry."""

import pytest
from pyspark.sql import functions as F

from contestlab import jobs, registry
from contestlab.operators import strategy

SF = "/root/testdata/sf0.001"


def test_jobs_list_run_and_refuse(spark, tmp_path, capsys):
    assert jobs.main(["list", "--like", "a14"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == [n for n in sorted(registry.QUERIES) if "a14" in n]
    out = str(tmp_path / "out")
    assert jobs.main(["run", "a14_leaderboard", "--data", SF, "--out", out]) == 0
    assert spark.read.parquet(out).count() == registry.QUERIES["a14_leaderboard"](spark, SF).count()
    assert jobs.main(["explain", "f20_season", "--data", SF]) == 0 and "Scan parquet" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        jobs.main(["run", "no such job", "--data", SF, "--out", out])


def test_strategies_by_hand(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 0.5, 1.2), (1, 2, 0.3, 4.0), (1, 3, 0.1, 9.0), (1, 4, 0.1, None)], "c int, t int, p double, odds double")
    got = {}
    for r in strategy.apply_strategies(df, "c", "t", "p", "odds").collect():
        got.setdefault(r.strategy, set()).add(r.t)
    assert got == {"top": {1, 2, 3}, "ev": {2, 3}, "ev_band": {2, 3}, "ev_top": {2}, "mix": {1, 2}}
    monkeypatch.setattr(strategy, "REGISTRY", dict(strategy.REGISTRY))
    strategy.register("long", strategy.Strategy(lambda c: c["odds"] >= 9, "p", 1))
    assert [r.t for r in strategy.apply_strategies(df, "c", "t", "p", "odds", ["long"]).collect()] == [3]
    assert strategy.apply_strategies(df.where(F.lit(False)), "c", "t", "p", "odds").isEmpty()
