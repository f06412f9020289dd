"""URL rules by host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.hot import split_join
from quarrystone.llm.store import stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Hex digits of the short prefix that is joined on.
SHORT = 8
#: Rules up to this many are broadcast; more are joined by a shuffle on the short prefix.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def host_and_path(url: Column) -> dict[str, Column]:
    """host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. A null url, or one without "://", has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return {"host": F.translate(host, UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """urls (url, host, path) times every host suffix at a label boundary and every path prefix of a length that some rule has."""
    labels = F.split(F.col("host"), r"\.", -1)
    out = urls.where("host <> ''").withColumn("_labels", labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    out = out.withColumn("_suffix", F.explode(suffixes)).drop("_labels")
    cuts = F.filter(F.array(*(F.lit(int(n)) for n in lengths)), lambda n: n <= F.length("path"))
    return out.withColumn("_cut", F.explode(cuts)).select("url", F.col("_suffix").alias("h"), F.expr("substring(path, 1, _cut)").alias("p"))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict for each url of urls (url, host, path; distinct) that some rule fits: the longest rule's, host and path counted together, then the one with the longer host, then a block before an allow."""
    listed = rules.select("verdict", "host", "path", digest(F.col("host"), F.col("path")).alias("full")).distinct()
    listed = listed.withColumns({"short": F.substring("full", 1, SHORT), "rule": F.concat("host", "path"), "_len": F.length("host") + F.length("path"), "_host": F.length("host"), "_v": F.when(F.col("verdict") == "block", 1).otherwise(0)}).drop("host", "path")
    size = listed.count()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # as many as there are lengths of a path: rules add none beyond the longest
    found = expressions(urls, sorted(lengths)).withColumn("digest", digest(F.col("h"), F.col("p"))).withColumn("short", F.substring("digest", 1, SHORT))
    if size <= BROADCAST_RULES:
        hits = found.join(F.broadcast(listed), "short").where("digest = full")
    else:  # expressions that most urls share, such as ("com", "/"), are dealt to several tasks
        hits = split_join(found, listed, "short", ["url"]).where("digest = full")
    best = F.max(F.struct("_len", "_host", "_v", "rule", "verdict")).alias("b")
    return hits.groupBy("url").agg(best).select("url", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule (null where none fits), verdict.

    Each distinct url is judged once, and the rows of a hot url are dealt to several tasks. Null and empty urls,
    and those without a host, fit no rule and get the default verdict. Repeated rows come back repeated.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    counts = stored(rows.groupBy("url").agg(F.count("*").alias("n")), "url-filter-urls")
    verdicts = judged(counts.where("url is not null").select("url").withColumns(host_and_path(F.col("url"))), rules)
    out = split_join(rows, verdicts, "url", ["page_id"], "left", counts=counts).withColumns(host_and_path(F.col("url")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path AND m.k = 1
"""
