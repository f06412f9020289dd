"""Keyed-hash sampling, allocation by largest remainders, digests of id sets, counts and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import keyed_hash, set_digest
from quarrystone.operators.study import numbered_within
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


def top_by_hash(rows: DataFrame, by: str, ident: str, seed: str, k: int) -> DataFrame:
    """The k rows of each stratum with the least keyed hashes, numbered from 1. A hot stratum is ranked in 4,096 parts."""
    ranked = numbered_within(rows.withColumn("h", keyed_hash(seed, F.col(ident))), by, "h").where(F.col("pos") < k)
    return ranked.withColumn("k", (F.col("pos") + 1).cast("int")).drop("h", "pos")


@query("keyed_topk_per_stratum", "SELECT doc_id, lang, CAST(k AS INTEGER) AS k FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 10")
def keyed_topk_per_stratum(spark, d):
    return top_by_hash(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "7", 10)


@query("stratified_holdout", "SELECT doc_id, lang, k <= (n // 10) AS holdout FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('13:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def stratified_holdout(spark, d):
    """A tenth of each stratum."""
    docs = table(spark, d, "documents").select("doc_id", "lang").withColumn("h", keyed_hash("13", F.col("doc_id")))
    n = docs.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    ranked = numbered_within(docs, "lang", "h")
    k = ranked.join(n, ranked["lang"].eqNullSafe(n["l"]))
    return k.select("doc_id", "lang", (F.col("pos") < F.floor(F.col("n") / 10)).alias("holdout"))


def allocated(sizes: DataFrame, total: int) -> DataFrame:
    """bucket, n, alloc: total dealt by size, what the floors leave to the largest remainders, ties by bucket. A row for each bucket."""
    every = Window.partitionBy()
    rows = sizes.withColumn("all", F.sum("n").over(every))
    rows = rows.withColumns({"base": F.expr(f"({total} * n) div all"), "rest": F.expr(f"({total} * n) % all")})
    rows = rows.withColumn("left", F.lit(total) - F.sum("base").over(every)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("rest"), "bucket")))
    return rows.select("bucket", "n", (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).cast("long").alias("alloc"))


@query(
    "largest_remainder_allocation",
    "WITH s AS (SELECT lang AS bucket, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT *, (100 * n) // (sum(n) OVER ()) AS base, (100 * n) % (sum(n) OVER ()) AS rest FROM s), "
    "r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, bucket) AS r, 100 - sum(base) OVER () AS remaining FROM b) SELECT bucket, n, CAST(base + CASE WHEN r <= remaining THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM r",
)
def largest_remainder_allocation(spark, d):
    return allocated(table(spark, d, "documents").groupBy(F.col("lang").alias("bucket")).agg(F.count("*").alias("n")), 100)


@query("id_set_digest", "SELECT o_orderstatus, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR)) || chr(10)) AS digest, count(*) AS n FROM orders GROUP BY o_orderstatus")
def id_set_digest(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(set_digest(F.collect_list(F.col("o_orderkey").cast("string"))).alias("digest"), F.count("*").alias("n"))


@query(
    "stratum_counts",
    "SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())",
)
def stratum_counts(spark, d):
    docs = table(spark, d, "documents").select("source", "lang")
    return docs.rollup("source", "lang").agg(F.count("*").alias("n"))


@query("count_share", "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source")
def count_share(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


_REASONS = "CASE WHEN source = 'src3' THEN 'blocked_source' WHEN trim(text) = '' THEN 'blank' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8000 THEN 'long' ELSE 'kept' END"


@query("cascade_reasons", f"SELECT {_REASONS} AS reason, count(*) AS n FROM documents GROUP BY 1")
def cascade_reasons(spark, d):
    """The first rule that trips is a row's only reason."""
    return table(spark, d, "documents").groupBy(F.expr(_REASONS).alias("reason")).agg(F.count("*").alias("n"))


@query("multi_reason_tags", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN source = 'src3' THEN 'blocked_source' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS reason FROM documents) GROUP BY reason")
def multi_reason_tags(spark, d):
    """A row may have many reasons."""
    c = F.col
    tags = F.array_compact(F.array(F.when(c("source") == "src3", "blocked_source"), F.when(c("n_chars") < 200, "short"), F.when(c("lang") != "en", "foreign")))
    return table(spark, d, "documents").select(F.explode(tags).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("accuracy_table", "SELECT l.quality AS stratum, count(*) AS n, CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality")
def accuracy_table(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    return rows.groupBy(F.col("quality").alias("stratum")).agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 0).cast("int")).alias("ok"))


@query("id_reconciliation", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'extra' END AS side FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def id_reconciliation(spark, d):
    a, b = table(spark, d, "labels").select(F.col("doc_id").alias("l")), table(spark, d, "documents").select(F.col("doc_id").alias("r"))
    both = a.join(b, F.col("l") == F.col("r"), "full")
    return both.where("l is null or r is null").select(F.coalesce("l", "r").alias("doc_id"), F.when(F.col("l").isNull(), "unlabelled").otherwise("extra").alias("side"))


@query("resume_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
