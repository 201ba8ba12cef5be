"""Text sources: sectioned logs, fixed-width records, JSON lines, daily sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_sections(spark: SparkSession, path: str, headers: dict[str, str], row: str, fields: list[str]) -> DataFrame:
    """Rows of a log under headings that hold until the next one: each header pattern's first group is carried forward.

    A file is the unit of order. Line numbers come from the file read as one text, so files should be of log size (a day or a site).
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda pattern, k: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k))
    held = text.withColumns({name: F.last(first(p, 1), ignorenulls=True).over(w) for name, p in headers.items()})
    return held.where(F.col("line").rlike(row)).select("file", "line_no", *headers, *[F.nullif(F.regexp_extract("line", row, k), F.lit("")).alias(name) for k, name in enumerate(fields, 1)])


def read_split_sections(spark: SparkSession, path: str, headers: dict[str, str], row: str, fields: list[str]) -> DataFrame:
    """S14 for files of any size: as `read_sections`, with a file read in as many splits as Spark makes of it.

    Headings are carried within a split by a window over that split; what holds at its start is the last heading of the splits before it, found from one
    small row a split. Lines end in a line feed (a carriage return before it is dropped). `line_no` counts from 0 within the file.
    """
    first = lambda pattern, k: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k))
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    marked = text.withColumns({name: first(p, 1) for name, p in headers.items()})
    ends = marked.groupBy("file", "block").agg(F.count("*").alias("__n"), *[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("at"))).alias(f"__{n}") for n in headers])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), *[F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__held_{n}") for n in headers])
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    held = marked.select("*", F.count("*").over(here).alias("__k"), *[F.last(n, ignorenulls=True).over(here).alias(f"__own_{n}") for n in headers]).where(F.col("line").rlike(row))
    out = held.join(starts, ["file", "block"])
    return out.select("file", (F.col("__before") + F.col("__k") - 1).alias("line_no"), *[F.coalesce(f"__own_{n}", f"__held_{n}").alias(n) for n in headers],
                      *[F.nullif(F.regexp_extract("line", row, k), F.lit("")).alias(name) for k, name in enumerate(fields, 1)])


def cut_fixed_width(lines: DataFrame, col: str, layout: dict[str, tuple[int, int, float | None]]) -> DataFrame:
    """Columns of (start from 1, width, divisor): text trimmed (divisor None) or a number over the divisor; blank or bad is null."""
    def field(start: int, width: int, divisor: float | None):
        cut = F.nullif(F.trim(F.substring(F.col(col), start, width)), F.lit(""))
        return cut if divisor is None else cut.try_cast("double") / divisor

    return lines.select("*", *[field(*at).alias(name) for name, at in layout.items()])


def read_jsonl(spark: SparkSession, path: str, schema: StructType, bad: str = "_bad") -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of JSON lines."""
    rows = spark.read.schema(StructType([*schema.fields]).add(bad, StringType())).option("columnNameOfCorruptRecord", bad).json(path)
    lines = spark.read.text(path).where(F.try_parse_json("value").isNull()).select(F.col("value").alias(bad))
    return rows.where(F.col(bad).isNull()).drop(bad), lines


def write_days(df: DataFrame, path: str, day: str) -> None:
    """JSON files by day; days in `df` replace their old files, other days stay."""
    df.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
