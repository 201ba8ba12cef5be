"""The 58 tables of the rule study (E30) on the stand-in contests.

Stand-ins: ex, lap, turn, sg (straight) and es (start in practice) are measured columns of the entrants; sr, rate, t3, wall, loc and top are
means over the actor's earlier 365 days; wind, speed, dir, wave, rain, number and women come from the contest's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestlab.operators.rules import POSITIONS, Rule, known, margin_of, prior_means, rank_of, rule_tables, wide
from contestlab.plans.queries import R, query
from contestlab.plans.standins import entrants, parts_of

MEASURES = ["f", "cls", "srk", "sr", "rate", "t3", "wall", "loc", "top", "ex", "lap", "turn", "sg", "es", "q"]
CONTEST = ["title", "first_day", "last_day", "wind", "speed", "dir", "wave", "rain", "number", "changed", "women"]
RANKED = ["ex", "lap", "turn", "sg", "es", "sr"]

WIN = {f"win{k}": f"f{k} = 1" for k in POSITIONS}
win, two, three = (lambda *ks: {f"win{k}": f"f{k} = 1" for k in ks}), (lambda *ks: {f"two{k}": f"f{k} <= 2" for k in ks}), (lambda *ks: {f"three{k}": f"f{k} <= 3" for k in ks})
EACH = {"win": "f{k} = 1", "three": "f{k} <= 3"}
FOUR = f"{known('sr', range(1, 5))} = 4"
BEST = "least(sr2, sr3, sr4)"


def bands(x: str, edges: list[float], extra: str = "") -> dict[str, str]:
    """Half-open bands (a, b] of x, the last one open above."""
    out = {}
    for a, b in zip([None, *edges], [*edges, None]):
        parts = [p for p in (f"{x} > {a}" if a is not None else "", f"{x} <= {b}" if b is not None else "", extra) if p]
        out[f"{'' if a is None else a}..{'' if b is None else b}"] = " and ".join(parts)
    return out


def attacker(*ks: int) -> str:
    """The fastest of positions 2 to 4 (the inner of equals), where it is faster than position 1, is one of `ks`."""
    first = {2: f"sr2 = {BEST}", 3: f"sr3 = {BEST} and sr2 > {BEST}", 4: f"sr4 = {BEST} and sr3 > {BEST} and sr2 > {BEST}"}
    return f"{FOUR} and {BEST} < sr1 and (" + " or ".join(f"({first[k]})" for k in ks) + ")"


def count(terms: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(({t})::int, 0)" for t in terms) + ")"


WINDS = {"calm": "wind = 'calm'"} | {f"{c} {n}": f"wind = '{c}' and speed {s}" for c in ("tail", "head", "left", "right") for n, s in (("1-4", "between 1 and 4"), ("5+", ">= 5"))}
NAMED = {"calm": "speed = 0", "light": "speed between 1 and 3", "tail 5+": "wind = 'tail' and speed >= 5", "head 5+": "wind = 'head' and speed >= 5", "cross 5+": "wind in ('left', 'right') and speed >= 5",
         "wave 0-2": "wave <= 2", "wave 5+": "wave >= 5", "wave 8+": "wave >= 8", "rain": "rain", "rain and wind": "rain and speed >= 4"}
STRONG = count([f"rate{k} >= 0.2" for k in range(2, 7)])
STEADY = " and ".join(f"sr{k} - sr{k + 1} < 0.5" for k in range(1, 6))
PAIRS = count([f"0.75 / (q1 * q{k} / (1 - q1) + q{k} * q1 / (1 - q{k})) < 5.0" for k in (2, 3)])
PENALTY = "(" + " + ".join(f"case when wall{k} <= 0.15 then 2 when wall{k} <= 0.2 then 1 else 0 end" for k in range(2, 7)) + ")"

RULES = [
    Rule(1, "wind", WINDS, WIN),
    Rule(2, "day of session", {"first": "first_day", "last": "last_day and not first_day", "between": "not first_day and not last_day"}, WIN),
    Rule(3, "lead of position 1", bands(f"{BEST} - sr1", [-0.5, 0, 0.5], FOUR), win(1)),
    Rule(4, "start rank of position 1", bands("sr1", [2.0, 2.5, 3.0, 3.5], FOUR), win(1) | {"stays": "case when f1 <> 1 then f1 between 2 and 3 end"}),
    Rule(5, "often in three", {"0.7+": "t3{k} >= 0.7", "0.6+": "t3{k} >= 0.6"}, {"three": "f{k} <= 3"}, each=tuple(POSITIONS)),
    *[Rule(6, f"attacker {a}", {"attacks": attacker(a), "does not": f"{FOUR} and not ({attacker(a)})"}, two(a + 1) | three(a + 1)) for a in (2, 3, 4)],
    *[Rule(7, f"{m} rank", {str(r): f"{m}_r{{k}} = {r}" for r in POSITIONS} | {"1-2": f"{m}_r{{k}} <= 2", "3+": f"{m}_r{{k}} >= 3"}, EACH, each=tuple(POSITIONS)) for m in ("ex", "lap", "turn", "sg")],
    Rule(8, "class by wind", {f"{c} {n}": f"cls1 = '{c}' and {s}" for c in "ANR" for n, s in (("calm", "(wind = 'calm' or speed between 1 and 2)"), ("head 5+", "wind = 'head' and speed >= 5"), ("tail 5+", "wind = 'tail' and speed >= 5"))}, win(1)),
    Rule(9, "first in practice", {f"{m}{c}": f"{m}_r1 = 1" + (f" and cls1 = '{c}'" if c else "") for m in ("ex", "es") for c in ("", "A", "N", "R")}, win(1)),
    Rule(10, "direction", {str(d): f"speed >= 4 and dir = {d}" for d in range(16)}, WIN, least=30),
    *[Rule(11, f"rank of {k}", {"1": f"ex_r{k} = 1", "2": f"ex_r{k} = 2", "3+": f"ex_r{k} >= 3"}, win(k)) for k in POSITIONS],
    Rule(12, "second behind 1", {n: f"f1 = 1 and {c}" for n, c in WINDS.items()}, {f"second{k}": f"f{k} = 2" for k in range(2, 7)}),
    *[Rule(13, f"thirds of {k}", bands(f"sr{k}", [3.3, 3.6]), win(k) | two(k)) for k in (2, 3, 4)],
    Rule(14, "wave", {"0-1": "wave <= 1", "2-4": "wave between 2 and 4", "5-7": "wave between 5 and 7", "8+": "wave >= 8"}, WIN),
    Rule(15, "4 ahead of 3", {f"{g}+": f"sr3 - sr4 >= {g}" for g in (0.3, 0.4, 0.5, 0.6)}, win(4, 5) | two(4, 5)),
    Rule(16, "named conditions", NAMED, WIN | two(*POSITIONS) | three(*POSITIONS)),
    *[Rule(17, f"class and rank of {k}", {f"{c} {r}": f"cls{k} = '{c}' and ex_r{k} = {r}" for c in "ANR" for r in (1, 2)}, win(k)) for k in POSITIONS],
    *[Rule(18, f"firsts of {k}", {"+".join(ms): " and ".join(f"{m}_r{k} = 1" for m in ms) for ms in (("ex",), ("lap",), ("turn",), ("ex", "lap"), ("ex", "turn"), ("lap", "turn"), ("ex", "lap", "turn"))}, win(k) | three(k)) for k in POSITIONS],
    Rule(19, "start in practice", {str(r): f"es_r{{k}} = {r}" for r in POSITIONS}, {"start in three": "srk{k} <= 3", "three": "f{k} <= 3"}, each=tuple(POSITIONS)),
    Rule(20, "4 ahead in both", {"yes": "ex4 < ex3 and sr4 < sr3", "no": "not (ex4 < ex3 and sr4 < sr3)"}, win(4, 5) | two(4, 5) | three(4, 5)),
    Rule(21, "wall of 2", bands("wall2", [0.1, 0.15, 0.2]), win(1)),
    Rule(22, "start and rate of 1", {f"{a} {b}": f"{s} and {r}" for a, s in (("early", "sr1 <= 3.4"), ("late", "sr1 > 3.4")) for b, r in (("strong", "rate1 >= 0.18"), ("weak", "rate1 < 0.18"))}, win(1)),
    Rule(23, "rate of 2", bands("rate2", [0.1, 0.15, 0.2]), win(1)),
    Rule(24, "start rank of 2", bands("sr2", [3.2, 3.5, 3.8]), win(3) | three(4)),
    Rule(25, "ex rank of 2", {str(r): f"ex_r2 = {r}" for r in POSITIONS}, {"second or third": "f2 between 2 and 3"} | three(2)),
    Rule(26, "strong others", {str(n): f"{STRONG} = {n}" for n in range(6)}, win(1)),
    Rule(27, "attacker 3 or 4", {"attacks": attacker(3, 4), "does not": f"{FOUR} and not ({attacker(3, 4)})"}, two(5, 6) | three(5, 6)),
    Rule(28, "weak ex but", {m: f"ex_r1 >= 3 and {m}_r1 <= 2" for m in ("lap", "turn", "sg")}, win(1)),
    Rule(29, "first day and first", {"first day": "first_day and ex_r{k} = 1", "other": "not first_day and ex_r{k} = 1"}, EACH, each=tuple(POSITIONS)),
    Rule(30, "steady", {"steady": STEADY, "not": f"not ({STEADY})"}, win(1) | {"two of the ex three in three": count([f"ex_r{k} <= 3 and f{k} <= 3" for k in POSITIONS]) + " >= 2"}),
    Rule(31, "lap and turn", {f"{m} {r}": f"{m}_r{{k}} <= {r}" for m in ("lap", "turn") for r in (2, 3)}, {"third": "f{k} = 3", "three": "f{k} <= 3"}, each=tuple(POSITIONS)),
    Rule(32, "first in straight and turn", {"yes": "sg_r1 = 1 and turn_r1 = 1", "no": "not (sg_r1 = 1 and turn_r1 = 1)"}, win(1)),
    Rule(33, "5 early and quick", {f"{b} {q}": f"{c} and {d}" for b, c in (("early", "sr5 <= 3.4"), ("late", "sr5 > 3.4")) for q, d in (("quick", "(ex_r5 <= 2 or lap_r5 <= 2 or turn_r5 <= 2 or sg_r5 <= 2)"), ("not", "not (ex_r5 <= 2 or lap_r5 <= 2 or turn_r5 <= 2 or sg_r5 <= 2)"))}, win(5) | two(5)),
    Rule(34, "rate of 3", bands("rate3", [0.1, 0.15, 0.2]), win(3) | {"second5": "f5 = 2"} | two(5)),
    Rule(35, "start of 1 by strong others", {f"{a} {n}": f"{s} and {STRONG} {t}" for a, s in (("early", "sr1 <= 3.4"), ("late", "sr1 > 3.4")) for n, t in (("0-1", "<= 1"), ("2+", ">= 2"))}, win(1, 2)),
    Rule(36, "gap to the outer", {"0.5+": "sr{k} - sr{o} >= 0.5", "less": "sr{k} - sr{o} < 0.5"}, {"outer": "f{o} = 1", "inner": "f{k} = 1"}, each=(1, 2, 3, 4, 5)),
    Rule(37, "walls", {f"{n} {b}": f"{known('wall', (2, 3, 4))} = 3 and {count([f'wall{k} {t}' for k in (2, 3, 4)])} = {n}" for n in range(4) for b, t in (("low", "<= 0.15"), ("high", ">= 0.2"))}, win(1)),
    Rule(38, "local rate", bands("loc1", [0.1, 0.2, 0.3]) | {f"rate {a} {w}": f"{r} and {c}" for a, r in (("0.18+", "rate1 >= 0.18"), ("less", "rate1 < 0.18")) for w, c in (("calm", "speed <= 2"), ("5+", "speed >= 5"))}, win(1)),
    Rule(39, "start place of 3", {str(r): f"sr_r3 = {r}" for r in POSITIONS}, win(3, 4, 5, 6) | two(3, 4, 5, 6)),
    *[Rule(40, f"clear leader {k}", {"clear": f"ex_r{k} = 1 and ex_margin >= 6"}, win(k)) for k in POSITIONS],
    Rule(41, "penalty of the others", {"0": f"{PENALTY} = 0", "1-2": f"{PENALTY} between 1 and 2", "3+": f"{PENALTY} >= 3"}, win(1)),
    Rule(42, "number of the day", {"1-4": "number <= 4", "5-8": "number between 5 and 8", "9-12": "number >= 9"}, WIN | {"outer early": count([f"srk{k} <= 3" for k in (4, 5, 6)]) + " >= 2"}),
    Rule(42, "leader by number", {"1-4": "number <= 4 and ex_r{k} = 1", "9-12": "number >= 9 and ex_r{k} = 1"}, {"leader": "f{k} = 1"}, each=tuple(POSITIONS)),
    Rule(43, "positions", {"as drawn": "not changed", "changed": "changed"}, WIN),
    Rule(44, "outer quick", {"yes": "lap_r{k} <= 2 and sg_r{k} = 1"}, {"three": "f{k} <= 3", "third": "f{k} = 3"}, each=(4, 5, 6)),
    Rule(45, "short pairs", {str(n): f"{PAIRS} = {n}" for n in range(3)}, win(1)),
    Rule(46, "category", {t: f"title = '{t}'" for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}, WIN, least=20),
    Rule(47, "leader by wind", {f"{m} {w}": f"{c} and {m}_r{{k}} = 1" for m in ("ex", "lap") for w, c in (("under 3", "speed < 3"), ("3+", "speed >= 3"))}, EACH, each=tuple(POSITIONS)),
    Rule(48, "last day, 5 ahead", {"yes": "last_day and sr4 - sr5 >= 0.5", "other day": "not last_day and sr4 - sr5 >= 0.5"}, win(5) | two(5)),
    *[Rule(49, f"strong {k}", {"0.2+": f"rate{k} >= 0.2", "0.35+": f"rate{k} >= 0.35"}, win(k)) for k in range(2, 7)],
    Rule(50, "wide gaps", {"0.7+": "sr{k} - sr{o} >= 0.7", "-0.7": "sr{k} - sr{o} <= -0.7", "between": "sr{k} - sr{o} > -0.7 and sr{k} - sr{o} < 0.7"}, {"outer": "f{o} = 1", "inner": "f{k} = 1"}, each=(1, 2, 3, 4, 5)),
    Rule(51, "behind the attacker", {"quick 5": f"{attacker(3, 4)} and sg_r5 <= 2 and turn_r5 <= 2", "leader 5": f"{attacker(4)} and ex_r5 = 1"}, {"third5": "f5 = 3"} | three(5) | win(5)),
    Rule(52, "margins", {f"{m} {g}+": f"{m}_r{{k}} = 1 and {m}_margin >= {g}" for m, gs in (("ex", (2, 4, 6)), ("lap", (0.01, 0.03))) for g in gs}, {"leader": "f{k} = 1"}, each=tuple(POSITIONS)),
    Rule(53, "six items", {"1 leads ex and lap": "ex_r1 = 1 and lap_r1 = 1", "1 leads lap and turn": "lap_r1 = 1 and turn_r1 = 1", "1 weak straight": "sg_r1 >= 5", "1 low and 2 faster": "cls1 = 'R' and sr2 < sr1",
                           "2 leads ex and lap": "ex_r2 = 1 and lap_r2 = 1", "1 last in ex": "ex_r1 = 6"}, win(1, 2)),
    *[Rule(54, f"often first away {k}", {"0.2+": f"top{k} >= 0.2", "0.3+": f"top{k} >= 0.3"}, win(k)) for k in (2, 3, 4)],
    *[Rule(55, f"gaps {k}-{k + 1}", bands(f"sr{k} - sr{k + 1}", [-0.6, -0.3, 0, 0.3, 0.6]), win(k - 1, k, k + 1)) for k in (2, 3)],
    Rule(56, "1 falls", {n: c for n, c in WINDS.items()}, {"fourth or worse": "f1 >= 4", "stays": "case when f1 <> 1 then f1 between 2 and 3 end"}),
    Rule(56, "ex of 2", {str(r): f"ex_r2 = {r}" for r in POSITIONS}, win(1)),
    Rule(57, "ex by wind", {f"{k} {r} {w}": f"ex_x{k} <= {r} and {c}" for k in (1, 2) for r in (1, 2) for w, c in (("under 3", "speed < 3"), ("3+", "speed >= 3"))}, win(1, 2) | {"2-1": "f2 = 1 and f1 = 2", "1-2": "f1 = 1 and f2 = 2"}),
    Rule(58, "first day, late and slow", {f"{n} {d}": f"{c} and {e} and ex_r1 >= 4" for n, c in (("0.3-0.6", f"sr1 - {BEST} >= 0.3 and sr1 - {BEST} < 0.6"), ("0.6+", f"sr1 - {BEST} >= 0.6")) for d, e in (("first day", "first_day"), ("other", "not first_day"))}, win(1)),
]

ROW = {"f": "finish", "cls": "class", "srk": "score_rank", "ex": "score", "lap": "discount", "turn": "(contest * 7 + slot * 31 + actor) % 53", "sg": "(equipment * 13 + slot) % 41", "es": "(contest + slot * 17) % 29"}
OF_CONTEST = {"first_day": "day(day) % 6 = 1", "last_day": "day(day) % 6 = 0", "speed": "contest % 9", "dir": "contest % 16", "wave": "contest % 11", "rain": "contest % 7 = 0", "number": "contest % 12 + 1", "changed": "contest % 10 < 3",
              "women": "contest % 4 = 0", "wind": "case when contest % 9 = 0 then 'calm' when contest % 4 = 0 then 'tail' when contest % 4 = 1 then 'head' when contest % 4 = 2 then 'left' else 'right' end"}
#: Mean over the actor's rows of the 365 days before, if there are enough: (value, rows, other keys).
PRIOR = {"sr": ("score_rank", 1, []), "rate": ("(finish = 1)::int", 10, []), "t3": ("(finish <= 3)::int", 10, []), "wall": ("won1", 10, []), "loc": ("(finish = 1)::int", 4, ["title"]), "top": ("(score_rank = 1)::int", 20, [])}
DERIVED = {f"{m}_r{k}": rank_of(m, k) for m in RANKED for k in POSITIONS} | {f"ex_x{k}": rank_of("ex", k, ties="max") for k in (1, 2)} | {f"{m}_margin": margin_of(m) for m in ("ex", "lap")}


def contests(spark: SparkSession, d: str) -> DataFrame:
    e = entrants(spark, d).withColumn("q", (1 / F.col("odds")) / F.sum(1 / F.col("odds")).over(Window.partitionBy("contest")))
    e = e.withColumn("won1", F.max(F.expr("case when slot = 1 then (finish = 1)::int end")).over(Window.partitionBy("contest"))).withColumn("__d", F.datediff("day", F.lit("1970-01-01")).cast("long"))
    e = prior_means(e, "__d", "actor", PRIOR, 365)
    e = e.select("contest", "slot", "title", "q", *PRIOR, *[F.expr(x).alias(n) for n, x in (ROW | OF_CONTEST).items()])
    # a contest's rows meet while they are narrow
    e = e.repartition(parts_of(spark, d, "lineitem"), "contest")
    return wide(e, "contest", "slot", MEASURES, CONTEST).select("*", *[F.expr(x).alias(n) for n, x in DERIVED.items()])


def _sql() -> str:
    prior = ", ".join(f"case when count({v}) over p_{n} >= {least} then round(avg({v}) over p_{n}, 9) end as {n}" for n, (v, least, _) in PRIOR.items())
    windows = ", ".join(f"p_{n} as (partition by {', '.join(['actor', *keys])} order by day range between interval 365 days preceding and interval 1 day preceding)" for n, (_, _, keys) in PRIOR.items())
    row = ", ".join(f"{x} as {n}" for n, x in (ROW | OF_CONTEST).items())
    cells = ", ".join(f"{{'rule': {r.number}, 'name': '{r.name}', 'band': '{band}', 'outcome': '{outcome}', 'least': {r.least}, 'n': count_if(({c}) and ({y}) is not null), 'hits': count_if(({c}) and ({y})), 'base_n': count(({y})), 'base_hits': count_if(({y}))}}"
                      for r in RULES for band, outcome, c, y in r.cells())
    return f""", x as (select *, (1 / odds) / sum(1 / odds) over (partition by contest) as q, max(case when slot = 1 then (finish = 1)::int end) over (partition by contest) as won1 from ent),
y as (select contest, slot, title, q, {prior}, {row} from x window {windows}),
v as materialized (select contest, {', '.join(f'any_value({c}) as {c}' for c in CONTEST)}, {', '.join(f'max(case when slot = {k} then {m} end) as {m}{k}' for m in MEASURES for k in POSITIONS)} from y group by contest),
w as materialized (select *, {', '.join(f'{x} as {n}' for n, x in DERIVED.items())} from v),
l as (select women, [{cells}] as l from w group by women), c as (select women, unnest(l, recursive := true) from l)
select women, rule, name, band, outcome, sum(n)::bigint as n, round(sum(hits) / sum(n), 6) as rate, sum(base_n)::bigint as base_n, round(sum(base_hits) / sum(base_n), 6) as base
from c group by women, rule, name, band, outcome, least having sum(n) >= least"""


@query(_sql(), ent=True)
def e30_rule_study(spark: SparkSession, d: str) -> DataFrame:
    """All 58 tables, for women's contests and the others apart."""
    return rule_tables(contests(spark, d), RULES, ["women"]).withColumns({"rate": R("rate"), "base": R("base")})
