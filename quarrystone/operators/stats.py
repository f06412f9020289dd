"""Paired statistics over per-item outcomes: contrasts, exact McNemar, Holm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

_OUTCOMES = "SELECT doc_id, quality = 1 AS ref, toxic = 0 AS cand_a, doc_id % 7 <> 0 AS cand_b FROM labels"


def contrasts(spark: SparkSession, d: str) -> DataFrame:
    """candidate, n, b (reference right, candidate wrong), c (the reverse)."""
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("ref"), F.explode(F.create_map(F.lit("cand_a"), F.col("toxic") == 0, F.lit("cand_b"), F.col("doc_id") % 7 != 0)).alias("candidate", "ok"))
    return rows.groupBy("candidate").agg(F.count("*").alias("n"), F.count_if(F.col("ref") & ~F.col("ok")).alias("b"), F.count_if(~F.col("ref") & F.col("ok")).alias("c"))


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p: min(1, 2 * sum of C(n, k) / 2^n up to the smaller count), each term from the one before by its logarithm."""
    n, m = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((-n * F.ln(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, k: F.struct((a["t"] + F.ln((n - k) / (k + 1.0))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), m), start, lambda a, k: step(a, k.cast("double")), lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


_CONTRASTS = f"SELECT candidate, count(*) AS n, count(*) FILTER (ref AND NOT ok) AS b, count(*) FILTER (ok AND NOT ref) AS c FROM (SELECT ref, 'cand_a' AS candidate, cand_a AS ok FROM ({_OUTCOMES}) UNION ALL SELECT ref, 'cand_b', cand_b FROM ({_OUTCOMES})) GROUP BY candidate"
_P = f"SELECT candidate, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END AS p FROM ({_CONTRASTS})"


@query("paired_contrasts", _CONTRASTS)
def paired_contrasts(spark, d):
    return contrasts(spark, d)


@query("mcnemar_exact", f"SELECT candidate, b, c, round(p, 6) AS p FROM ({_P})")
def mcnemar_exact(spark, d):
    return contrasts(spark, d).select("candidate", "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query("holm_adjusted", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY p, candidate) - 1 AS k, count(*) OVER () AS m FROM ({_P})) SELECT candidate, round(max(least(1.0, (m - k) * p)) OVER (ORDER BY p, candidate ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r")
def holm_adjusted(spark, d):
    """Step-down adjustment over a row for each candidate."""
    w = Window.orderBy("p", "candidate")
    rows = contrasts(spark, d).select("candidate", mcnemar(F.col("b"), F.col("c")).alias("p"))
    rows = rows.withColumns({"k": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy())})
    return rows.select("candidate", F.round(F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k")) * F.col("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("p_holm"))


@query("accuracy_delta_vs_base", f"WITH a AS (SELECT avg(CAST(ref AS INTEGER)) AS base, avg(CAST(cand_a AS INTEGER)) AS cand_a, avg(CAST(cand_b AS INTEGER)) AS cand_b FROM ({_OUTCOMES})) SELECT round(base, 6) AS base, round(cand_a - base, 6) AS delta_a, round(cand_b - base, 6) AS delta_b FROM a")
def accuracy_delta_vs_base(spark, d):
    mean = lambda c: F.avg(c.cast("int"))
    rows = table(spark, d, "labels").agg(mean(F.col("quality") == 1).alias("base"), mean(F.col("toxic") == 0).alias("a"), mean(F.col("doc_id") % 7 != 0).alias("b"))
    return rows.select(F.round("base", 6).alias("base"), F.round(F.col("a") - F.col("base"), 6).alias("delta_a"), F.round(F.col("b") - F.col("base"), 6).alias("delta_b"))
