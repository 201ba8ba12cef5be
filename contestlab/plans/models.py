"""Win models on the stand-in tables: training, importance, objectives, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.operators import asof, boost, evaluate, study
from contestlab.operators.boost import TEST, TRAIN, Fit
from contestlab.plans.queries import R, query
from contestlab.plans.standins import entrants
from contestlab.storage import written

#: What is known before the day, and what the contest's own showing adds.
PRIOR = ["slot", "site", "class_code", "actor_rate", "actor_n", "actor_rate_90", "actor_n_90", "equipment_rate", "equipment_n"]
POST = [*PRIOR, "score", "score_rank", "discount"]
CATEGORICAL = ("site",)


def featured(spark: SparkSession, d: str) -> DataFrame:
    """Entrants with point-in-time features, labels and the time split, written once."""
    e = written(entrants(spark, d).withColumn("win", F.col("finish") == 1))
    sums = {"n": F.lit(1), "wins": F.col("win").cast("int")}
    actors = asof.daily_sums(e, ["actor"], "day", sums)
    actors = asof.prior_cumulative(asof.asof_stats(actors, ["actor"], "day", ["n", "wins"], 90), ["actor"], "day", ["n", "wins"])
    things = asof.prior_cumulative(asof.daily_sums(e, ["equipment"], "day", sums), ["equipment"], "day", ["n", "wins"])
    base = F.lit(1 / 6)
    out = e.join(actors.select("actor", "day", F.col("prior_n").alias("actor_n"), F.col("w_n").alias("actor_n_90"), asof.shrink(F.col("prior_wins"), F.col("prior_n"), base, 10).alias("actor_rate"),
                               asof.shrink(F.col("w_wins"), F.col("w_n"), base, 10).alias("actor_rate_90")), ["actor", "day"])
    out = out.join(things.select("equipment", "day", F.col("prior_n").alias("equipment_n"), asof.shrink(F.col("prior_wins"), F.col("prior_n"), base, 10).alias("equipment_rate")), ["equipment", "day"])
    out = out.withColumns({"class_code": F.ascii("class"), "top2": F.col("finish") <= 2, "top3": F.col("finish") <= 3})
    return written(evaluate.time_split(out, "day"))


def contests(rows: DataFrame, roles: list[str]) -> boost.Binned:
    return boost.bin_contests(rows, "contest", "slot", POST, ["win", "top2", "top3"], roles, categorical=CATEGORICAL, train=F.col(roles[0]) == TRAIN)


def losses(spark: SparkSession, models: dict[str, boost.Model]) -> DataFrame:
    """One row a model: its trees, and its mean loss by role with these trees."""
    rows = [(name, len(m.trees), *[m.history[len(m.trees)].get(role) if m.history else None for role in (1, 2, 3)]) for name, m in models.items()]
    return spark.createDataFrame(rows, "model string, trees int, train_loss double, valid_loss double, test_loss double")


@query("""select role, count(*) as n, cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day
from ent join (select day, case when k < floor(0.6 * n) then 1 when k < floor(0.75 * n) then 2 else 3 end as role from (select day, row_number() over (order by day) - 1 as k, count(*) over () as n from (select distinct day from ent)))
using (day) group by role""", ent=True)
def e19_time_split(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.time_split(entrants(spark, d).select("day"), "day")
    return e.groupBy("role").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query(""", g as (select date_diff('day', day, (select max(day) from ent)) as age from ent) select case when age <= 90 then 3 when age <= 135 then 2 else 1 end as role, count(*) as n from g group by 1""", ent=True)
def e19_days_split(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).select("day")
    return evaluate.days_split(e, "day", str(e.agg(F.max("day")).first()[0]), 90, 45).groupBy("role").agg(F.count("*").alias("n"))


@query(""", b as (select day, ntile(3) over (order by day) as block from (select distinct day from ent)), x as (select contest, day, max(case when finish = 1 then -ln(p) end) as old, max(case when finish = 1 then -ln(1 / odds) end) as new from ent group by contest, day)
select block, count(*) as n, case when count(*) >= 60 then round(avg(new - old), 6) end as change, coalesce(count(*) >= 60 and avg(new - old) < 0, false) as better from x join b using (day) group by block""", ent=True)
def e18_block_improvement(spark: SparkSession, d: str) -> DataFrame:
    won = F.col("finish") == 1
    x = entrants(spark, d).groupBy("contest", "day").agg(F.max(F.when(won, -F.log("p"))).alias("old"), F.max(F.when(won, -F.log(1 / F.col("odds")))).alias("new"))
    return evaluate.block_improvement(x, "day", "old", "new").withColumn("change", R("change"))


def _trained(spark: SparkSession, d: str) -> dict[str, boost.Model]:
    shape = {"trees": 12, "depth": 3, "rate": 0.3, "patience": 4}
    fits = [Fit("prior", features=tuple(PRIOR), **shape), Fit("post", features=tuple(POST), **shape), *[Fit(k, label=k, features=tuple(POST), **shape) for k in ("top2", "top3")]]
    return boost.boost(contests(featured(spark, d), ["role"]), fits)


@query()
def e22_win_models(spark: SparkSession, d: str) -> DataFrame:
    """The win model before and after the showing, and the place models, grown side by side."""
    return losses(spark, _trained(spark, d)).select("model", "trees", *[R(c).alias(c) for c in ("train_loss", "valid_loss", "test_loss")])


@query()
def e22_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, f, g) for name, m in _trained(spark, d).items() for f, g in m.importance()]
    return spark.createDataFrame(rows, "model string, feature string, share double").withColumn("share", R("share"))


@query()
def e21_objectives(spark: SparkSession, d: str) -> DataFrame:
    """Softmax over a contest against normalised binary on the same split, with two depths and two shrinkages of each: mean loss of the winner, and chosen by validation."""
    binned = contests(featured(spark, d), ["role"])
    fits = [Fit(f"{o}-{depth}-{rate}", objective=o, depth=depth, rate=rate, trees=10, patience=4) for o in ("binary", "softmax") for depth in (2, 3) for rate in (0.2, 0.5)]
    models = boost.boost(binned, fits)
    found = boost.contest_losses(binned, models, boost.VALID).groupBy("fit").agg(F.avg("loss").alias("valid_loss")).join(
        boost.contest_losses(binned, models, TEST).groupBy("fit").agg(F.count("*").alias("contests"), F.avg("loss").alias("test_loss")), "fit")
    made = spark.createDataFrame([(m.fit.name, m.fit.objective, m.fit.depth, m.fit.rate, len(m.trees)) for m in models.values()], "fit string, objective string, depth int, rate double, trees int")
    return made.join(found, "fit").select("objective", "depth", "rate", "trees", "contests", R("valid_loss").alias("valid_loss"), R("test_loss").alias("test_loss"))


@query()
def e20_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Leave out each group of features over three rolling folds of 200 days; the verdict on each group from all folds' contests."""
    rows = featured(spark, d)
    last = str(rows.agg(F.max("day")).first()[0])
    age = F.datediff(F.lit(last).cast("date"), "day")
    folds = {f"fold{k}": F.when(age >= 200 * (k + 2), TRAIN).when(age >= 200 * (k + 1), boost.VALID).when(age >= 200 * k, TEST).otherwise(0) for k in range(3)}
    binned = contests(rows.withColumns(folds), list(folds))
    groups = {"actor": ["actor_rate", "actor_n", "actor_rate_90", "actor_n_90"], "equipment": ["equipment_rate", "equipment_n"], "showing": ["score", "score_rank", "discount"]}
    diffs, _ = boost.ablate(binned, boost.ablation_fits(Fit("x", objective="softmax", trees=8, depth=3, rate=0.3, patience=4), groups, POST, list(folds)))
    diffs, out = written(diffs), None
    for name in groups:
        one = study.paired_verdict(diffs.where(F.col("group") == name), "fold", "diff").withColumn("group", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("group", "n", "folds", "helped", R("mean").alias("mean"), R("z", 4).alias("z"), "verdict")


@query()
def e21_history_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The same model taught on the last 200, 400, 800 and all days before its validation, side by side: entrants taught, trees, and loss by fold of 200 test days; `change` against all days."""
    rows = featured(spark, d)
    last = str(rows.agg(F.max("day")).first()[0])
    age = F.datediff(F.lit(last).cast("date"), "day")
    roles = {f"f{k}_{days or 'all'}": boost.history_role(age, 200 * k, 200, 200, days) for k in range(2) for days in (200, 400, 800, None)}
    binned = contests(rows.withColumns(roles), list(roles))
    models = boost.boost(binned, [Fit(name, objective="softmax", role=name, trees=8, depth=3, rate=0.3, patience=4) for name in roles])
    found = boost.compare_histories(binned, models, {name: (name.split("_")[0], name.split("_")[0] + "_all") for name in roles})
    return found.select("fold", "fit", "trees", "contests", R("loss").alias("loss"), R("change").alias("change"), R("z", 4).alias("z"))


@query()
def e21_refit(spark: SparkSession, d: str) -> DataFrame:
    """Whether to teach the days of validation too: the model as tuned, and one of 1.1 times its trees taught on all days before the test, over two folds of 200 days."""
    rows = featured(spark, d)
    last = str(rows.agg(F.max("day")).first()[0])
    age = F.datediff(F.lit(last).cast("date"), "day")
    roles = {f"f{k}_{kind}": boost.history_role(age, 200 * k, 200, 200 if kind == "tuned" else 0, None) for k in range(2) for kind in ("tuned", "refit")}
    models = boost.refit(contests(rows.withColumns(roles), list(roles)), Fit("x", objective="softmax", trees=8, depth=3, rate=0.3, patience=4), {f"f{k}": (f"f{k}_tuned", f"f{k}_refit") for k in range(2)}, 1.1)
    found = boost.compare_histories(models[0], models[1], {name: (name.split("_")[0], name.split("_")[0] + "_tuned") for name in roles})
    return found.select("fold", "fit", "trees", "contests", R("loss").alias("loss"), R("change").alias("change"), R("z", 4).alias("z"))
