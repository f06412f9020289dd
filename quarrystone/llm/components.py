"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.hot import split_join
from quarrystone.llm.store import scratch, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """v, label for each end of links (a, b: longs): label is the smallest v that can be reached.

    Each round takes the smallest label among neighbours and then the label's own label, so paths
    shorten as rounds go on; each round's labels are stored. Only whether anything changed comes to the driver.
    A hub, and a label that most of a component has, are dealt to several tasks. No links give no rows.
    """
    with scratch(links.sparkSession) as keep:
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).where("v <> w").distinct()
        both = stored(both, f"{name}-links")
        labels = stored(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")), f"{name}-labels")
        ends = stored(both.groupBy("w").agg(F.count("*").alias("n")), f"{name}-ends")
        while True:
            near = split_join(both, labels.withColumnRenamed("v", "w"), "w", ["v"], counts=ends).groupBy("v").agg(F.min("label").alias("near"))
            lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            lower = stored(lower, f"{name}-near")
            jump = lower.select(F.col("v").alias("label"), F.col("label").alias("far"))
            jumped = stored(split_join(lower, jump, "label", ["v"], "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{name}-labels")
            labels = jumped.select("v", "label")
            if jumped.where("label <> old").isEmpty():
                return keep(labels)
