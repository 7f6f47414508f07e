"""URL filter: rules on hosts and paths, met by hashed expressions.

A url is expanded into host suffixes x path prefixes, an expression for each pair. Expressions and rules meet in an
equi-join on the first bytes of their digest; then the full digests are compared, and of the rules that fit the longest wins.

Scale: only suffixes and prefixes of lengths that occur among the rules are expanded (those lengths are the only thing that
goes to the driver: a row for each pair of lengths). Each distinct (host, path) is expanded once. The rules' join is left to
Spark, which broadcasts them only if they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_COLUMNS = "host string, path string, verdict string"
#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages: page_id, url. rules: host, path, verdict (allow or block). Returns page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains, where the path starts with the rule's path, character by character. The longest
    rule (host and path together) wins; of equally long ones that with the longer host, then block. Rules with a null in host
    or path fit nothing. Without a rule: rule null and the default verdict. Null, empty and odd urls have an empty host or
    path. Repeated rows each get a row; no pages, no rows; no rules, all by default.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna(subset=["r_host", "r_path"])
    shapes = rules.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    labels, chars = sorted({r.labels for r in shapes}), sorted({r.chars for r in shapes})
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(ints(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(ints(chars), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    asked = split.select("host", "path").distinct().withColumn("expression", F.explode(pairs)).withColumn("digest", F.sha2("expression", 256))
    digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)
    given = rules.withColumn("r_digest", digest).select("r_digest", F.substring("r_digest", 1, 8).alias("short"), "r_host", "r_path", "r_verdict")
    best = (
        asked.withColumn("short", F.substring("digest", 1, 8)).join(given, "short").filter(F.col("digest") == F.col("r_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    )
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT host, path, max({'n': length(r_host) + length(r_path), 'h': length(r_host), 'b': r_verdict = 'block', 'rule': r_host || r_path, 'verdict': r_verdict}) AS best
  FROM (SELECT DISTINCT host, path FROM parts) u, rules
  WHERE ('.' || host) LIKE ('%.' || r_host) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""
