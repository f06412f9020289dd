"""Joins that deal the rows of hot keys to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in CELLS of all rows, and more than LEAST. So fewer than CELLS keys are hot, however many rows there are.
CELLS, LEAST = 256, 512


def split_join(rows: DataFrame, other: DataFrame, key: str, spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows.join(other, key, how) for how inner or left. The rows of a hot key are dealt by a hash of the columns of spread, and
    other's rows of that key are repeated for each part, so no task gets much more than a CELLS-th of all rows.

    counts: key and n, how many of rows each key has, where the caller knows; keys left out of it aren't hot. Null keys match nothing, and are dealt as others are.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(LEAST, (total or 0) // CELLS)
    if (most or 0) <= limit:  # no hot key, so counts are read once
        return rows.join(other, key, how)
    hot = counts.where(F.col("n") > limit).select(key, F.expr(f"cast(n div {limit} + 1 as int)")).collect()  # fewer than CELLS rows
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    parts = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], f"_hot {kind}, _parts int"))
    dealt = rows.join(parts, rows[key].eqNullSafe(parts["_hot"]), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts"))).cast("int")).drop("_hot", "_parts")
    copies = other.join(parts, other[key].eqNullSafe(parts["_hot"]), "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
