"""Boosted trees over contests against plain loops on a small table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contestlab import registry
from contestlab.operators import boost
from contestlab.operators.boost import TEST, TRAIN, VALID, Fit

SF = "/root/testdata/sf0.001"
GRAIN = boost.GRAIN


@pytest.fixture(scope="module")
def data():
    draw = random.Random(2)
    rows = []
    for contest in range(90):
        n = draw.choice([2, 3, 4])
        xs = [(draw.choice([None, 1.0, 2.0, 3.0, 5.0]), float(draw.randint(0, 9)), float(draw.choice([1, 2, 7]))) for _ in range(n)]
        power = [math.exp((x[0] or 2) * 0.4 + 0.2 * x[1] - (x[2] == 2) * 1.5) for x in xs]
        winner = draw.choices(range(n), power)[0] if contest % 15 else None
        role = TRAIN if contest < 60 else VALID if contest < 75 else TEST
        rows += [(contest, k, *x, k == winner, k != winner and x[1] > 4, role, 4 - role) for k, x in enumerate(xs)]
    return rows


COLUMNS = "contest long, slot int, a double, b double, c double, win boolean, place boolean, role int, other int"


def binned(spark, data):
    df = spark.createDataFrame(data, COLUMNS).repartition(4)
    return df, boost.bin_contests(df, "contest", "slot", ["a", "b", "c"], ["win", "place"], ["role", "other"], bins=8, categorical=("c",), train=F.col("role") == TRAIN)


def brute(data, cuts, fit):
    """Margins by (contest, slot) of plain boosting over the same bins, and the losses by role after each tree."""
    names, cats = ["a", "b", "c"], {"c"}
    label, role = {"win": 5, "place": 6}[fit.label], {"role": 7, "other": 8}[fit.role]
    rows = []
    for r in data:
        bins = [0 if v is None else (cuts[f].index(v) + 1 if v in cuts[f] else 0) if f in cats else 1 + sum(c < v for c in cuts[f]) for f, v in zip(names, r[2:5])]
        rows.append({"key": (r[0], r[1]), "bins": bins, "y": int(r[label]), "role": r[role], "m": 0.0})
    own = [r["y"] for r in rows if r["role"] == TRAIN]
    for r in rows:
        r["m"] = math.log((sum(own) + 1) / (len(own) - sum(own) + 1)) if fit.objective == "binary" else 0.0
    contests = {}
    for r in rows:
        contests.setdefault(r["key"][0], []).append(r)
    allowed = [names.index(f) for f in (fit.features or names)]

    def measure():
        losses = {}
        for group in contests.values():
            e = [math.exp(r["m"]) for r in group]
            wins = sum(r["y"] for r in group)
            for r, x in zip(group, e):
                if fit.objective == "binary":
                    p = 1 / (1 + math.exp(-r["m"]))
                    r["g"], r["h"], loss = p - r["y"], max(p * (1 - p), 1e-6), -math.log(p if r["y"] else 1 - p)
                    losses.setdefault(r["role"], []).append(loss)
                else:
                    p = x / sum(e)
                    r["g"], r["h"] = (p - r["y"] / wins, max(p * (1 - p), 1e-6)) if wins else (0.0, 0.0)
                    if r["y"]:
                        losses.setdefault(r["role"], []).append(-math.log(p) / wins)
                r["g"], r["h"] = round(r["g"] * GRAIN) / GRAIN, round(r["h"] * GRAIN) / GRAIN
        n = {k: len(v) if fit.objective == "binary" else sum(g[0]["role"] == k for g in contests.values()) for k, v in losses.items()}
        return {k: sum(v) / n[k] for k, v in losses.items()}

    def grow(own, every, depth):
        value = -fit.rate * sum(r["g"] for r in own) / (sum(r["h"] for r in own) + fit.l2)
        best = None
        if depth:
            score = lambda part: sum(r["g"] for r in part) ** 2 / (sum(r["h"] for r in part) + fit.l2)
            for f in allowed:
                order = list(range(1, 9))
                if names[f] in cats:
                    at = lambda b: [r for r in own if r["bins"][f] == b]  # noqa: E731, B023
                    order = sorted((b for b in order if at(b)), key=lambda b: sum(r["g"] for r in at(b)) / (sum(r["h"] for r in at(b)) + fit.l2))
                for missing in (0, 1) if any(r["bins"][f] == 0 for r in own) else (0,):
                    for k in range(1, len(order) + 1):
                        left = {*order[:k], *([0] if missing else [])}
                        a, b = [r for r in own if r["bins"][f] in left], [r for r in own if r["bins"][f] not in left]
                        gain = round(score(a) + score(b) - score(own), 9)
                        if len(a) >= fit.least and len(b) >= fit.least and gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, left)
        if best is None:
            for r in every:
                r["m"] += value
            return
        _, f, left = best
        for side in (True, False):
            grow([r for r in own if (r["bins"][f] in left) == side], [r for r in every if (r["bins"][f] in left) == side], depth - 1)

    history = [measure()]
    for _ in range(fit.trees):
        grow([r for r in rows if r["role"] == TRAIN], rows, fit.depth)
        history.append(measure())
    return rows, history


FITS = [Fit("binary", trees=4, depth=3, least=5, rate=0.3), Fit("softmax", objective="softmax", trees=4, depth=2, least=5, rate=0.3),
        Fit("place", label="place", trees=2, depth=2, features=("b", "c"), least=5, rate=0.3), Fit("other", role="other", trees=2, depth=1, least=5)]


def test_side_by_side_fits_equal_plain_loops(spark, data, monkeypatch):
    monkeypatch.setattr(boost, "STORE_EVERY", 2)  # stored margins and fresh trees
    df, table = binned(spark, data)
    models = boost.boost(table, FITS)
    for fit in FITS:
        rows, history = brute(data, table.cuts, fit)
        model = models[fit.name]
        assert len(model.history) == fit.trees + 1
        for got, want in zip(model.history, history):
            assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == got
        best = min(range(len(history)), key=lambda k: (round(history[k][VALID], 9), k))
        assert len(model.trees) == best
        if best == fit.trees:
            q = {(r.contest, r.slot): r.q for r in boost.predict(df, model, "contest").collect()}
            for r in rows:
                if fit.objective == "binary":
                    assert q[r["key"]] == pytest.approx(1 / (1 + math.exp(-r["m"])), abs=1e-6)
    assert abs(sum(g for _, g in models["binary"].importance()) - 1) < 1e-9
    p = boost.predict(df, models["softmax"], "contest").groupBy("contest").agg(F.sum("q").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in p)


def test_order_and_partitions_change_nothing(spark, data):
    df = spark.createDataFrame(data, COLUMNS)
    found = []
    for parts in (1, 7):
        table = boost.bin_contests(df.repartition(parts), "contest", "slot", ["a", "b", "c"], ["win"], ["role"], cuts={"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [1.0, 2.0, 7.0]}, categorical=("c",))
        found.append(boost.boost(table, [Fit("m", trees=5, depth=3, least=4)])["m"])
    assert found[0].history == found[1].history and found[0].gains == found[1].gains


def test_patience_empty_tables_and_ablation(spark, data):
    df, table = binned(spark, data)
    noise = boost.boost(table, [Fit("m", trees=60, depth=4, rate=0.9, least=1, patience=3)])["m"]
    assert len(noise.history) < 61 and len(noise.trees) == noise.best_trees()
    empty = boost.bin_contests(df.limit(0), "contest", "slot", ["a", "b"], ["win"], ["role"])
    none = boost.boost(empty, [Fit("m", trees=2)])["m"]
    assert none.trees == [] and [round(r.q, 3) for r in boost.predict(df.limit(1), none, "contest").collect()] == [0.5]
    fits = boost.ablation_fits(Fit("x", trees=3, depth=2, least=5, objective="softmax"), {"one": ["b"], "two": ["a", "c"]}, ["a", "b", "c"], ["role", "other"])
    assert [f.name for f in fits] == ["role/", "role/one", "role/two", "other/", "other/one", "other/two"]
    diffs, models = boost.ablate(table, fits)
    rows = diffs.collect()
    wins = {r[0] for r in data if r[5]}
    assert len(rows) == 2 * (len({r[0] for r in data if r[7] == TEST} & wins) + len({r[0] for r in data if r[8] == TEST} & wins))
    assert all("b" not in models[f"{fold}/one"].gains for fold in ("role", "other"))


def test_model_queries_give_rows(spark):
    for name in ("e22_win_models", "e22_importance", "e21_objectives", "e20_ablation"):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_history_roles_and_refits(spark):
    ages = spark.range(0, 12).withColumn("age", F.col("id").cast("int"))
    role = lambda days, valid=2: [r[0] for r in ages.orderBy("id").select(boost.history_role(F.col("age"), 1, 3, valid, days)).collect()]
    assert role(None) == [0, 3, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1] and role(2) == [0, 3, 3, 3, 2, 2, 1, 1, 0, 0, 0, 0] and role(None, 0) == [0, 3, 3, 3, 1, 1, 1, 1, 1, 1, 1, 1]
    data = [(c, k, float((c * 7 + k * 5) % 11), k == max(range(3), key=lambda j: ((c * 7 + j * 5) % 11, j)), c % 12) for c in range(240) for k in range(3)]
    df = spark.createDataFrame(data, "c int, k int, x double, win boolean, age int").withColumns({"a": boost.history_role(F.col("age"), 0, 3, 3, None), "b": boost.history_role(F.col("age"), 0, 3, 0, None)})
    binned, models = boost.refit(boost.bin_contests(df, "c", "k", ["x"], ["win"], ["a", "b"]), boost.Fit("x", objective="softmax", trees=4, depth=2, rate=0.5, least=5), {"f": ("a", "b")}, 1.5)
    assert len(models["a"].trees) == 4 and len(models["b"].trees) == 6
    got = {r.fit: r for r in boost.compare_histories(binned, models, {"a": ("f", "a"), "b": ("f", "a")}).collect()}
    losses = {(r.fit, r.part): r.loss for r in boost.contest_losses(binned, models).collect()}
    mean = lambda n: sum(v for (f, _), v in losses.items() if f == n) / 60
    assert got["a"].contests == got["b"].contests == 60 and got["a"].change == 0 and got["a"].z == 0
    assert abs(got["b"].loss - mean("b")) < 1e-9 and abs(got["b"].change - (mean("a") - mean("b"))) < 1e-9 and got["b"].change > 0
