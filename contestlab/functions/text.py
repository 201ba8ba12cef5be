"""Scalar functions on text and values (F1 to F23) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_signed_time(text: Column) -> Column:
    """F1: `F.02` is -0.02, `.15` is 0.15, `L` and the like are null; full-width digits are read."""
    plain = F.upper(F.trim(F.translate(text, "０１２３４５６７８９．", "0123456789.")))
    number = F.regexp_extract(plain, r"^[FL]?(\d*\.?\d+)$", 1).try_cast("double")
    return F.when(plain.startswith("L"), None).when(plain.startswith("F"), -number).otherwise(number)


def parse_clock(text: Column, lo: int = 90_000, hi: int = 150_000) -> Column:
    """F2: `1'49"8` or `1.49.8` in milliseconds; null outside [lo, hi]."""
    part = [F.regexp_extract(text, r"^(\d+)['.](\d{2})[\".](\d)$", k).try_cast("int") for k in (1, 2, 3)]
    ms = part[0] * 60_000 + part[1] * 1000 + part[2] * 100
    return F.when(ms.between(lo, hi), ms)


def contest_id(day: Column, site: Column, no: Column) -> Column:
    """`yyyymmdd-site-no`, padded."""
    return F.concat_ws("-", F.date_format(day, "yyyyMMdd"), F.lpad(site.cast("string"), 2, "0"), F.lpad(no.cast("string"), 2, "0"))


def parse_odds(text: Column) -> Column:
    """`1-2-3:12.5 1-2-4:8` as a map of positive odds; the last of repeated keys holds, bad numbers are left out."""
    pairs = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda e: F.struct(F.element_at(F.split(e, ":"), 1).alias("k"), F.try_element_at(F.split(e, ":"), F.lit(2)).try_cast("double").alias("v"))), lambda e: e["v"] > 0)
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def parse_tickets(text: Column, length: int = 3) -> Column:
    """ordered distinct tuples, digits joined by dashes."""
    digits = F.transform(F.split(text, r"[,\s]+"), lambda t: F.regexp_replace(t, r"\D", ""))
    return F.array_distinct(F.transform(F.filter(digits, lambda t: F.length(t) == length), lambda t: F.array_join(F.split(t, ""), "-")))


def classify_by_rules(title: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """the category of the first rule whose pattern the title matches."""
    out = None
    for pattern, category in rules:
        out = F.when(title.rlike(pattern), category) if out is None else out.when(title.rlike(pattern), category)
    return F.lit(default) if out is None else out.otherwise(default)


def normalise_label(label: Column, synonyms: list[tuple[str, str]]) -> Column:
    """F8: the first synonym that the cleaned label contains, else the cleaned label."""
    plain = F.lower(F.trim(label))
    return F.coalesce(*[F.when(plain.contains(word), F.lit(name)) for word, name in synonyms], plain)


def wind_components(direction: Column, speed: Column, heading: Column) -> tuple[Column, Column]:
    """(tail, cross) parts of a wind from one of 16 compass points, relative to a heading in degrees."""
    angle = F.radians(direction * 22.5 - heading)
    return -speed * F.cos(angle), speed * F.sin(angle)


def wind_category(direction: Column, speed: Column, heading: Column, calm: float = 1.0) -> Column:
    """calm, head, tail, left or right."""
    turn = F.pmod(direction * 22.5 - heading + 45, F.lit(360.0))
    return F.when(speed < calm, "calm").when(turn < 90, "head").when(turn < 180, "right").when(turn < 270, "tail").otherwise("left")


def parts_count(text: Column, part: str) -> Column:
    """how many of a part a list like `ring x2, piston` names."""
    n = F.regexp_extract(text, rf"{part}\s*x?(\d*)", 1)
    return F.when(F.coalesce(text.contains(part), F.lit(False)), F.coalesce(n.try_cast("int"), F.lit(1))).otherwise(0)


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """label of the half-open band [edge, next edge); values under the first edge take the first label."""
    out = F.when(value < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        out = out.when(value < edge, label)
    return out.when(value.isNotNull(), labels[-1])


def tiered_index(p: Column, scale: float, tiers: list[tuple[int, str]]) -> tuple[Column, Column]:
    """an index from 0 to 100 and the tier of the highest floor it reaches."""
    index = F.greatest(F.least(F.bround(100 * p / scale), F.lit(100.0)), F.lit(0.0)).cast("int")
    tier = None
    for floor, name in sorted(tiers, reverse=True):
        tier = F.when(index >= floor, name) if tier is None else tier.when(index >= floor, name)
    return index, tier


def season(day: Column) -> Column:
    """season of a date's month."""
    month = F.month(day)
    return F.when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn").otherwise("winter")


def fingerprint(*cols: Column) -> Column:
    """a stable SHA-256 of trimmed values."""
    return F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cols]).cast("binary"), 256)


def search_score(name: Column, key: Column, query: str) -> Column:
    """100 for the exact key, 90 for the exact name, 75 for its beginning, 60 for a part of it, else 0."""
    q, plain = query.strip().lower(), F.lower(F.regexp_replace(name, r"\s+", ""))
    return F.when(key.cast("string") == q, 100).when(plain == q, 90).when(plain.startswith(q), 75).when(plain.contains(q), 60).otherwise(0)


def polarity(text: Column, good: list[str], bad: list[str]) -> Column:
    """good words that the text contains minus bad ones."""
    found = [F.when(text.contains(w), 1).otherwise(0) for w in good] + [F.when(text.contains(w), -1).otherwise(0) for w in bad]
    out = F.lit(0)
    for f in found:
        out = out + f
    return out


def key_phrases(text: Column, lexicon: list[str], most: int = 3, longest: int = 40) -> Column:
    """F16: words of the lexicon that the text contains, else its first short clauses."""
    hits = F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: text.contains(w))
    clauses = F.slice(F.filter(F.transform(F.split(text, r"[.,\n]"), lambda c: F.trim(c)), lambda c: (F.length(c) > 0) & (F.length(c) <= longest)), 1, most)
    return F.when(F.size(hits) > 0, hits).otherwise(clauses)


def add_rules(base: Column, rules: list[tuple[Column, float, str]], lo: float, hi: float) -> tuple[Column, Column]:
    """the base score plus the points of the rules that hold, bounded, and the notes of those rules."""
    total = base
    for condition, points, _ in rules:
        total = total + F.when(condition, F.lit(points)).otherwise(0.0)
    return F.greatest(F.least(total, F.lit(hi)), F.lit(lo)), F.array_compact(F.array(*[F.when(c, F.lit(note)) for c, _, note in rules]))


def refine_category(category: Column, share: Column, title: Column, double_words: list[str], plain: list[str], special: str) -> tuple[Column, Column]:
    """`special` for plain categories of which a share of 0.8 or more is flagged; and whether it is a double event (a word of the title, or 0.25 or more)."""
    double = F.coalesce(share, F.lit(0.0)) >= 0.25
    for word in double_words:
        double = double | F.coalesce(title.contains(word), F.lit(False))
    return F.when(category.isin(plain) & (F.coalesce(share, F.lit(0.0)) >= 0.8), F.lit(special)).otherwise(category), double


def day_flags(label: Column, first: list[str], last: list[str]) -> tuple[Column, Column]:
    """whether a day's label names the first and the last day; null for blank labels."""
    known = F.trim(label) != ""
    names = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: label.contains(w))
    return F.when(known, names(first)), F.when(known, names(last))


def match_conditions(conditions: dict[str, Column]) -> Column:
    """the names of the conditions that hold, in the order given; a condition on a missing value does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def comment_score(text: Column, topics: dict[str, tuple[list[str], list[str]]], weight: float = 0.1) -> tuple[Column, Column, Column, Column]:
    """direction of each topic (1, 0 or -1 by which of its word lists the text meets more often), the bounded sum of `weight` a direction, whether a
    topic meets both lists, and a label by the sum."""
    def hits(words: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))

    ways = [F.signum(hits(good) - hits(bad)).cast("int").alias(n) for n, (good, bad) in topics.items()]
    mixed = F.exists(F.array(*[(hits(good) > 0) & (hits(bad) > 0) for good, bad in topics.values()]), lambda x: x)
    total = F.aggregate(F.array(*ways), F.lit(0), lambda a, x: a + x)
    delta = F.greatest(F.least(total * weight, F.lit(0.3)), F.lit(-0.3))
    return F.struct(*ways), delta, mixed, F.when(total > 0, "good").when(total < 0, "bad").otherwise("plain")


def json_collect(json: Column, path: list[str], leaf: str) -> Column:
    """The values of `leaf` anywhere under `path` of a JSON text, in order, joined by commas; empty if there are none.

    The part under the path is cut out as text, so that its depth and shape do not matter.
    """
    under = F.get_json_object(json, "$." + ".".join(path))
    return F.array_join(F.coalesce(F.regexp_extract_all(under, F.lit(rf'"{leaf}"\s*:\s*"([^"]*)"'), 1), F.array().cast("array<string>")), ",")
