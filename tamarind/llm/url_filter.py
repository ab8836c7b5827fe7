"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every distinct URL is expanded into (host suffix, path prefix) expressions.  An
expression's SHA-256 digest is cut to a four-byte key, on which it is
equi-joined with the rules; the full digest then confirms a hit, and the
longest rule wins.

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default verdict.  An empty host has no suffixes.  Repeated rows each
get their row back.  A rule with a null host, path or action is ignored; equal
rules with different actions block.  With no rules all rows get the default.
Columns of the input other than the URL are passed through unless they carry
an output's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DEFAULT_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
KEY_HEX = 8  # hex digits of a digest's four-byte key


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host up to the first of ``/?#``, the path up to the first of ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return shared.lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("action", "host", "path"), rule, strict=True))) for rule in rules))
    return spark.range(1).select(F.inline(made))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``."""
    named = rules.where("host is not null and path is not null and action is not null").select(shared.lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action")
    named = named.groupBy("rule_host", "rule_path").agg(F.min(F.when(F.col("action") == "block", 0).otherwise(1)).alias("allowed"))
    named = named.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).select("*", F.substring("digest", 1, KEY_HEX).alias("key")).drop("rule_host", "rule_path")
    # one row: only path lengths and numbers of host labels that some rule has can match
    counted = rules.where("host is not null and path is not null")
    lengths, depths = map(sorted, counted.agg(F.collect_set(F.length("path")), F.collect_set(F.size(F.split("host", r"\.", -1)))).first())

    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(url).alias("u")).distinct().select("u", *(c.alias(n) for c, n in zip(split_url(F.col("u")), ("host", "path"), strict=True)))
    labels = F.split("host", r"\.", -1)
    fitting = F.filter(F.array(*(F.lit(n) for n in depths)).cast("array<int>"), lambda n: n <= F.size("labels"))
    parts = urls.where("host <> ''").select("u", "path", labels.alias("labels")).select("u", "path", "labels", F.explode(fitting).alias("k"))
    parts = parts.select("u", "path", F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), ".").alias("suffix"))
    ends = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    parts = parts.select("u", "suffix", F.explode(F.filter(F.transform(ends, lambda n: F.when(F.length("path") >= n, F.substring("path", F.lit(1), n))), lambda p: p.isNotNull())).alias("prefix"))
    tried = parts.withColumn("full", _digest(F.col("suffix"), F.col("prefix"))).withColumn("key", F.substring("full", 1, KEY_HEX))
    found = tried.join(named, "key").where(F.col("full") == F.col("digest"))
    rank = F.struct(F.length("suffix") + F.length("prefix"), F.length("suffix"))
    best = found.groupBy("u").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "allowed"), rank).alias("best"))
    out = pages.join(best, F.col(url) == best["u"], "left").drop("u")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.allowed") == 0, "block").otherwise("allow")
    return out.withColumns({"host": host, "path": path, "rule": F.col("best.rule"), "verdict": verdict}).drop("best")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
with p as (
  select page_id, url, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(action, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
select page_id, host, path,
  (select rhost || rpath from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1) as rule,
  coalesce((select action from r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) order by length(rhost || rpath) desc limit 1), 'allow') as verdict
from q
"""
