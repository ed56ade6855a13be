"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import saved

#: The rule list of the registered query: (host, path, action).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict on urls that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rule lists of up to so many rows (about 40 MB) are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    """The first 32 bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of pages: id, host, path, rule (host and path of the winning rule, else null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule wins (host and
    path together; of equally long ones the longer host, then block). Each url is expanded into those host
    suffixes and path prefixes whose numbers of labels and characters occur among the rules, so that long urls
    cost no more than the rules ask for. The expressions meet the rules on 32-bit hash prefixes; the full digest
    then confirms. Null urls and urls without :// have an empty host and path, and no rule but one with an
    empty host fits them. Rules with a null host, path or action are ignored, repeated rules count once; rows that
    repeat id and url are each returned; other columns are ignored; empty tables give empty results.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action").dropna().distinct()
    rules = rules.withColumn("digest", _digest(F.col("host"), F.col("path"))).select(
        _prefix(F.col("digest")).alias("r_prefix"),
        F.col("digest").alias("r_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            F.when(F.col("action") == "block", 1).otherwise(0).alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "action",
        ).alias("found"),
        F.size(F.split("host", "\\.")).alias("labels"),
        F.length("path").alias("path_length"),
    )
    rules = saved(rules, "url-rules")
    # The shapes of rules, not the rules: a label count and a path length are each at most a url's length.
    shape = rules.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    ints = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<int>")
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.filter(ints(shape.labels), lambda n: n <= F.size("labels")),
        lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."),
    )
    prefixes = F.transform(F.filter(ints(shape.lengths), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform("suffixes", lambda h: F.transform("prefixes", lambda p: _digest(h, p))))
    urls = (
        pages.select(F.col(id_column), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
        .withColumn("labels", F.explode(F.array(labels)))  # a generator, so that the split is made once
        .withColumns({"suffixes": suffixes, "prefixes": prefixes})
        .select(id_column, "host", "path", F.posexplode_outer(keys).alias("k", "digest"))
        .withColumn("prefix", _prefix(F.col("digest")))
    )
    # Rules that share a prefix form one row, so that an expression meets at most one row.
    side = rules.groupBy("r_prefix").agg(F.collect_list(F.struct("r_digest", "found")).alias("rules"))
    if shape.n <= BROADCAST_RULES:
        side = F.broadcast(side)
    else:
        side = saved(side, "url-prefixes")
    met = urls.join(side, F.col("prefix") == F.col("r_prefix"), "left")
    confirmed = F.get(F.filter("rules", lambda r: r.r_digest == F.col("digest")), 0)
    # The rows of one url are combined in their own task first: about one row per url is shuffled.
    best = (
        met.select(id_column, "host", "path", confirmed.found.alias("found"), (F.coalesce("k", F.lit(0)) == 0).cast("long").alias("copy"))
        .groupBy(id_column, "host", "path")
        .agg(F.max("found").alias("found"), F.sum("copy").alias("copies"))
    )
    return best.select(
        id_column,
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP3_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rh, rp, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, coalesce(max_by(act, length(rh || rp)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""
