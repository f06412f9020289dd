"""Global running sums without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.store import parts, stored


def with_prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """df with one long column for each of sums: its total over all rows that stand earlier in the given order.

    Rows are range-partitioned by the order columns and stored with their part's number; each part's
    totals (a row for each part, however many rows there are) give the part's offsets, and a window
    inside the part gives the rest. Hot values of the first column are split by the later ones. Rows
    that agree in all order columns may come in any order among themselves.
    """
    spark = df.sparkSession
    n = parts(spark)
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt.withColumns({f"_add_{k}": F.coalesce(c, F.lit(0)).cast("long") for k, c in sums.items()}), f"{name}-ranged")
    totals = dealt.groupBy("_part").agg(*(F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumns({f"_run_{k}": F.coalesce(F.sum(f"_add_{k}").over(inside), F.lit(0)) for k in sums})
    # At most n rows, n being the number of parts: small enough to broadcast at any input size.
    out = run.join(F.broadcast(offsets), "_part")
    out = out.withColumns({k: F.col(f"_run_{k}") + F.col(f"_off_{k}") for k in sums})
    return out.drop("_part", *(f"_{p}_{k}" for k in sums for p in ("add", "run", "off")))
