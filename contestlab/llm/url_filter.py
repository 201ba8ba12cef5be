"""URL rules by a sort-merge range join (operator 4), in DataFrame functions only.

Hosts are turned round into keys that end in a dot (`com.example.www.`), so a rule's host and all its subdomains are one interval
of keys, from `com.example.` to `com.example/`, and any two intervals are nested or apart. Rule events and URLs are sorted
together and swept once: where an interval opens, the rule's host is put on its ancestors' stack; where it closes, the parent's
stack is back. A URL takes the stack in force at its key and keeps the longest rule whose path is a prefix of its own.

A sweep covers one top-level label, which no interval crosses, and one salt: the URLs of a label that has many are dealt to
several sweeps, each with the label's rule events. The number of salts follows the number of URLs under the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: URLs in one sweep, on average.
SWEEP_ROWS = 50_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
STACK = "array<struct<host:string,path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule_events(rules: DataFrame) -> DataFrame:
    """(label, key, kind, stack): kind 1 opens a rule host's interval with its own stack, kind 0 closes it with its parent's.

    A host's stack holds the rules of all its ancestors, of which it has at most as many as labels.
    """
    hosts = rules.where("host is not null and path is not null").groupBy("host").agg(F.sort_array(F.collect_set(F.struct("host", "path", "verdict"))).alias("own"))
    labels = F.split("host", r"\.")
    ancestors = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("up"))
    known = hosts.select(F.col("host").alias("up"), "own")
    stacks = ancestors.join(known, "up").groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("host"), F.col("own")))).alias("parent"))
    key = host_key(F.col("host"))
    return stacks.select(F.substring_index(key, ".", 1).alias("label"), F.explode(F.array(
        F.struct(key.alias("key"), F.lit(1).alias("kind"), F.col("stack").alias("stack")),
        F.struct(F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("concat(array_join(reverse(split(host, '[.]')), '.'), '.')")), F.lit("/")).alias("key"),
                 F.lit(0).alias("kind"), F.col("parent").alias("stack")),
    )).alias("e")).select("label", "e.key", "e.kind", F.col("e.stack").cast(STACK).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """`pages` with host, path, rule and verdict (columns of these names are replaced).

    rules: (host, path, verdict). A rule fits its host and its subdomains if the URL's path starts with the rule's. The longest
    rule wins (host and path together; then the longer host); a rule given twice with different verdicts blocks. rule is null
    and verdict `default` where none fits: null and malformed URLs, empty hosts, an empty table of rules. Rows are kept as they are,
    repeated ones too; an empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    carried = [f"in_{k}" for k in range(len(kept))]
    urls = pages.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(carried, kept)], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")).withColumn("key", host_key(F.col("host")))
    urls = urls.withColumn("label", F.substring_index("key", ".", 1))
    events = _rule_events(rules)
    # one row for each label that has rules: as many as there are top-level labels
    salts = urls.groupBy("label").agg(F.count("*").alias("n")).join(events.select("label").distinct(), "label").select(
        "label", F.ceil(F.col("n") / sweep_rows).cast("int").alias("salts"))
    dealt = urls.join(salts, "label", "left").withColumn("salt", F.pmod(F.xxhash64("host", "path", *[c for c in carried if urls.schema[c].dataType.typeName() in ("long", "integer", "string")]), F.coalesce("salts", F.lit(1))).cast("int"))
    sent = events.join(salts, "label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    ruled = dealt.where("salts is not null").select("label", "salt", "key", F.lit(2).alias("kind"), F.lit(None).cast(STACK).alias("stack"), *carried, "host", "path")
    void = [F.lit(None).cast(t).alias(c) for c, t in (*((c, urls.schema[c].dataType) for c in carried), ("host", "string"), ("path", "string"))]
    swept = ruled.unionByName(sent.select("label", "salt", "key", "kind", "stack", *void)).withColumn(
        "active", F.last("stack", ignorenulls=True).over(Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 2")
    free = dealt.where("salts is null").select(*carried, "host", "path", F.lit(None).cast(STACK).alias("active"))
    best = F.array_max(F.transform(
        F.filter("active", lambda r: F.col("path").startswith(r["path"])),
        lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("hosts"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    judged = swept.select(*carried, "host", "path", "active").unionByName(free).withColumn("best", best)
    return judged.select(*[F.col(k).alias(c) for k, c in zip(carried, kept)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
