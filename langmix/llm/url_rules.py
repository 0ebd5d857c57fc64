"""Operator 4: judge urls by host and path rules. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from langmix.llm.common import ascii_lower, stored, without

RULE_SCHEMA = "verdict string, host string, path string"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rules, such as ``("block", "example.com", "/de/")``: a short list as literal rows. A long
    list is a table that the caller reads."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast(f"array<struct<{RULE_SCHEMA.replace(' string', ':string')}>>")))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot: ``blog.a.net`` is ``net.a.blog.``, so a host's key is a prefix of the
    keys of all its subdomains, and a prefix is the interval up to the key with its last dot raised to ``/``."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_segments(rules: DataFrame) -> DataFrame:
    """Cut the key line at every rule host's interval ends. ``start`` opens a segment in which ``stack`` holds the
    rules active there, outermost first. Hosts nest or are disjoint, so the stack at a host is the rules of its own
    key prefixes, and after its end those of its strict prefixes."""
    r = rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(
        "verdict", ascii_lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    r = r.withColumn("key", host_key(F.col("host")))
    depth = F.size(F.split("key", "\\.")) - 1
    above = r.select("key").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), depth)))
    above = above.select("key", F.expr("concat(substring_index(key, '.', n), '.')").alias("up"))
    entry = F.struct(F.length("host").alias("host_len"), (F.length("host") + F.length("path")).alias("len"), "path",
                     F.concat("host", "path").alias("rule"), "verdict")
    by_key = r.select(F.col("key").alias("up"), entry.alias("e"))
    active = above.join(by_key, "up", "left").groupBy("key").agg(
        F.sort_array(F.collect_list("e")).alias("open"),
        F.sort_array(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("e")))).alias("closed"))
    ends = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    events = active.select(F.explode(F.array(
        F.struct(F.col("key").alias("start"), F.col("open").alias("stack")),
        F.struct(ends.alias("start"), F.col("closed").alias("stack")))).alias("s")).select("s.*")
    return events


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Give each row ``host``, ``path``, ``rule`` and ``verdict`` (they replace input columns of that name).

    A sort-merge range join: canonical keys of urls and segment starts are dealt by range over the cluster and
    swept in sorted order, each url taking the last start at or below its key. A range that begins inside a segment
    carries the last start of the ranges before it, one row for each range. Urls of one host are dealt by a running
    number as well, so a hot host spreads over ranges. The rules met are then tested on the path; the longest
    (host and path together, then host) wins.

    Null urls, urls without ``://`` and urls that no rule fits get a null rule and ``default``. Repeated rules count
    once; of equal rules with both verdicts ``block`` wins. Empty tables give empty results.
    """
    url = F.col(url_col)
    urls = pages.select(*without(pages, "host", "path", "rule", "verdict"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = urls.select(F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("row"), host_key(F.col("host")).alias("key"),
                       F.lit(None).cast("string").alias("start"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("seq"))
    segments = rule_segments(rules)
    starts = segments.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("start").alias("key"), "start",
                             F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"))
    dealt = rows.unionByName(starts).repartitionByRange("key", "kind", "seq").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "url-ranges")
    carry = dealt.groupBy("part").agg(F.max("start").alias("last")).select(
        "part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("swept", F.max("start").over(sweep)).where("kind = 1")
    # one row for each range: bounded by the number of shuffle partitions
    met = swept.join(F.broadcast(carry), "part", "left").select("row.*", F.coalesce("swept", "carried").alias("__at"))
    met = met.join(segments.select(F.col("start").alias("__at"), F.col("stack").alias("__stack")), "__at", "left")
    fits = F.filter("__stack", lambda e: F.startswith(F.col("path"), e["path"]))
    ranked = F.transform(fits, lambda e: F.struct(e["len"], e["host_len"], e["verdict"], e["rule"]))
    best = F.array_max(ranked)
    return met.select(*(F.col(f"`{c}`") for c in urls.columns), best["rule"].alias("rule"),
                      F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
