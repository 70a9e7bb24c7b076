"""URL filters: host-suffix and path-prefix expressions, met with rules by short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict on a url that no rule fits, and the length of a hash prefix in hexadecimal digits.
DEFAULT, PREFIX = "allow", 8
#: Up to so many rules the rule side may be broadcast; beyond it the join shuffles both sides.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or without ://: empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(after), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; null or without ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*+(/[^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains of at most `most` labels."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """The prefixes of the path that end in a slash, of at most `most` slashes; an empty path has none."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    rules: host, path, verdict; a path starts and ends with a slash. A rule fits its host and all subdomains if the
    path starts with the rule's. The longest rule (host and path together) wins, then the longer host; of equal rules
    with different verdicts, block. No rule: null and the default. A null url, or one without ://, has an empty host and
    path and fits no rule; so does an empty path, as every rule's path has a slash. Repeated rows stay; an empty table
    gives no rows; other columns are ignored.

    Each distinct (host, path) is expanded once, so a hot host costs one expansion; expressions deeper than any rule's
    are not made, which loses nothing. The prefix join is an equi-join; the full digest is compared after it.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block sorts after allow
    size = rules.agg(F.max(F.size(F.split("r_host", "\\."))).alias("labels"), F.max(F.size(F.split("r_path", "/")) - 1).alias("slashes"), F.count_if(~F.col("r_path").rlike("^/(.*/)?$")).alias("bad"), F.count("*").alias("n")).first()
    if size["bad"]:
        raise ValueError("a rule's path must start and end with a slash")
    digest = _digest(F.col("r_host"), F.col("r_path"))
    rules = rules.select("*", digest.alias("r_digest"), F.substring(digest, 1, PREFIX).alias("key"))
    rules = F.broadcast(rules) if size["n"] <= BROADCAST_RULES else rules
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = pages.where("host <> '' and path <> ''").select("host", "path").distinct()
    asked = places.select("*", F.explode(host_suffixes(F.col("host"), size["labels"] or 0)).alias("suffix")).where("suffix <> ''")
    asked = asked.select("*", F.explode(path_prefixes(F.col("path"), size["slashes"] or 0)).alias("prefix"))
    asked = asked.select("host", "path", "suffix", "prefix", _digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn("key", F.substring("digest", 1, PREFIX))
    hits = asked.join(rules, "key").where("digest = r_digest")
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length(F.concat("r_host", "r_path")), F.length("r_host")))
    won = hits.groupBy("host", "path").agg(best.alias("won"))
    return pages.join(won, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP4_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM cut),
fits AS (SELECT n, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS place
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (n)
"""
