"""Ingestion: latest-wins, lenient typing, JSON payloads, unions of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project_json(df: DataFrame, col: str, fields: dict[str, str], fallback: dict[str, str] | None = None) -> DataFrame:
    """A string column for each JSON path, or the fallback column where the payload has none."""
    fallback = fallback or {}
    return df.select("*", *[F.coalesce(F.get_json_object(col, path), F.col(fallback[name]).cast("string") if name in fallback else F.lit(None)).alias(name) for name, path in fields.items()])


def safe_json(col: str, schema: str) -> Column:
    """Parse only what looks like an object; anything else is null."""
    return F.when(F.col(col).startswith("{"), F.from_json(col, schema))


def explode_json_array(df: DataFrame, col: str, schema: str, pos: str = "pos", into: str = "item") -> DataFrame:
    """S3: a row for each element of a JSON array with its place from 1; no array gives no rows."""
    parsed = F.when(F.col(col).startswith("["), F.from_json(col, f"array<{schema}>"))
    return df.select("*", F.posexplode(parsed).alias("__at", into)).withColumn(pos, F.col("__at") + 1).drop("__at")


def pack_map(df: DataFrame, keys: list[str], k: str, v: str, into: str = "packed") -> DataFrame:
    """`k:v k:v ...` for each group, in order of k; rows without a value are left out."""
    rows = df.where(F.col(v).isNotNull()).select(*keys, F.struct(F.col(k).cast("string").alias("k"), F.col(v).cast("string").alias("v")).alias("e"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.concat(e["k"], F.lit(":"), e["v"])), " ").alias(into))


def extract_first(col: str, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern, null if there is none; for large texts that need no whole parse."""
    found = F.regexp_extract(col, pattern, group)
    return F.when(found != "", found)


def profile_source(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Rows, first and last day of each source."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def json_key_counts(df: DataFrame, col: str) -> DataFrame:
    """How often each top-level key occurs."""
    return df.select(F.explode(F.json_object_keys(col)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def union_sources(sources: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """One table of several; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(origin, F.lit(name)) for name, df in sources.items()])


def clean_number(col: str) -> Column:
    """A number or null."""
    return F.col(col).try_cast("double")


def clean_site(col: str, width: int = 2) -> Column:
    """A site number padded with zeros."""
    return F.lpad(F.trim(F.col(col).cast("string")), width, "0")


def clean_day(col: str) -> Column:
    """Eight digits without dashes."""
    return F.substring(F.regexp_replace(F.col(col).cast("string"), "-", ""), 1, 8)


def clean_flag(col: str, yes: tuple[str, ...] = ("1", "true", "t", "yes")) -> Column:
    """Whether a word means yes; null stays null."""
    return F.lower(F.trim(F.col(col).cast("string"))).isin(*yes)


def null_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Null where a value lies outside its closed range."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items()})


def harmonise_units(df: DataFrame, by: list[str], col: str, lo: float, hi: float, least_share: float, factor: float) -> DataFrame:
    """Multiply a source's values by `factor` if more than `least_share` of them lie in [lo, hi]; one small aggregate a source."""
    share = df.where(F.col(col).isNotNull()).groupBy(*by).agg(F.avg(F.col(col).between(lo, hi).cast("double")).alias("__share"))
    return df.join(share, by, "left").withColumn(col, F.when(F.col("__share") > least_share, F.col(col) * factor).otherwise(F.col(col))).drop("__share")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def latest_nonnull(df: DataFrame, keys: list[str], cols: list[str], order: list[str]) -> DataFrame:
    """For each column the newest value that is not null, even if the newest row lacks it."""
    stamp = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in cols])


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not done yet."""
    return df.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")


def harvest_state(df: DataFrame, day: str, state: str, today, done: DataFrame) -> DataFrame:
    """A row for each entry of a map column, of completed days that are not in `done`."""
    return df.where(F.col(day) < F.lit(today)).join(done.select(day), day, "left_anti").select("*", F.explode(state).alias("key", "value")).drop(state)


def normalise_submissions(df: DataFrame, aliases: dict[str, list[str]], key: list[str]) -> DataFrame:
    """Columns under their own names from whichever alias the submission used, and `rejected`: why a row is not taken (null: it is).

    Values are trimmed and empty ones are missing. A row without a key value is rejected, and so is every row of a key given more than once.
    """
    have = {c.strip().lower(): c for c in df.columns}
    out = df.select(*[F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[a.lower()]}`").cast("string")), F.lit("")) for a in names if a.lower() in have], F.lit(None).cast("string")).alias(c)
                      for c, names in aliases.items()])
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    return out.withColumn("rejected", F.when(missing, "missing key").when(twice, "given twice"))


def filter_history(df: DataFrame, equal: dict[str, str] | None = None, contains: dict[str, str] | None = None, day: str | None = None, first: str | None = None, last: str | None = None,
                   every: str = "all") -> DataFrame:
    """rows within the days (both ends in), whose columns equal or contain what is asked; `every` and empty texts ask for nothing."""
    cond = F.lit(True)
    for c, v in (equal or {}).items():
        cond = cond if v in ("", every) else cond & (F.col(c).cast("string") == v)
    for c, v in (contains or {}).items():
        cond = cond if v == "" else cond & F.lower(F.col(c).cast("string")).contains(v.lower())
    if day and first:
        cond = cond & (F.col(day) >= F.to_date(F.lit(first)))
    if day and last:
        cond = cond & (F.col(day) <= F.to_date(F.lit(last)))
    return df.where(cond)


def verified_rows(predictions: DataFrame, results: DataFrame, notes: DataFrame, key: str, note: str, default: str) -> DataFrame:
    """Predictions that have a result, with the note kept for them, or `default`."""
    return predictions.join(results, key).join(notes.select(key, note), key, "left").withColumn(note, F.coalesce(note, F.lit(default)))
