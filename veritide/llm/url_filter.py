"""URL filters: expressions of a URL, joined with rules on short hash prefixes.

A URL is expanded into every (host suffix, path prefix) expression that some rule could
have. Expressions and rules meet in an equi-join on the first 32 bits of SHA-256; the full
digest confirms, and the longest fitting rule decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The rules that the query's contract fixes: (host, path, verdict).
CONTRACT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Up to so many rules (about 200 bytes each) the rule side is broadcast; more are shuffled.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The
    longest rule text wins; of two equally long ones the longer host, then ``block``. No
    fitting rule: null rule and ``default``. A null url, or one without ``://``, has an empty
    host and path and fits no rule. Repeated rows stay repeated; an empty table gives an empty
    one; other columns of ``pages`` are not read. Rules with a null or empty host are ignored.

    Only distinct (host, path) pairs are expanded, so that a hot URL is judged once.
    """
    given = pages.select(
        F.col(id_col).alias(id_col),
        F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"),
    )
    rules = (
        rules.where("host is not null and host <> '' and path is not null and verdict is not null")
        .select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("digest", F.sha2(F.concat("r_host", "r_path"), 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    # What bounds the expansion: the rules' label counts and path lengths, a few numbers.
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    if shape["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels, lengths = shape["labels"] or 0, shape["lengths"] or [0]

    parts = F.split("host", r"\.")
    suffixes = F.expr(
        "transform(sequence(1, greatest(1, least(size(parts), %d))), n -> array_join(slice(parts, -n, n), '.'))" % max(labels, 1)
    )
    prefixes = F.filter(
        F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(n <= F.length("path"), F.expr("path").substr(F.lit(1), n))),
        lambda p: p.isNotNull(),
    )
    expressions = (
        given.select("host", "path")
        .where("host <> ''")
        .distinct()
        .withColumn("parts", parts)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("expression_digest", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", F.substring("expression_digest", 1, 8))
        .select("host", "path", "suffix", "prefix", "expression_digest", "short")
    )
    fits = expressions.join(rules, "short").where(
        "expression_digest = digest and suffix = r_host and prefix = r_path"
    )
    won = fits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length(F.concat("r_host", "r_path")).alias("total"),
                F.length("r_host").alias("host_length"),
                F.col("r_verdict").alias("verdict"),
                F.concat("r_host", "r_path").alias("rule"),
            )
        ).alias("won")
    )
    return given.join(won, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rules_frame(spark, CONTRACT_RULES))


ORACLE = """
WITH rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), k AS (SELECT row_number() OVER () AS k, page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM u
), fit AS (
  SELECT k, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY k ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS n
  FROM k JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM k LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (k)
"""
