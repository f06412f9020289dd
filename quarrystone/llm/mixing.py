"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.prefix import with_prefix_sums
from quarrystone.llm.store import stored

#: How often a document may be taken.
EPOCHS = 3
#: Weights of the sources in code point order, over and over.
WEIGHTS = (1, 2, 3)
#: Leading hex digits of the shuffle key that deal a source's rows out: 4096 parts for each source.
DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size (words of the text; a null text has none) and the key that shuffles documents: of their id, or their text where they have none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5("text"), F.lit("")))).alias("_key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """A row for each source: source, _rank, source_size, target.

    The budget is all sizes. A source gets its weight's share of it; where that is above `epochs` times
    its size, the target stops there and the rest is shared again by weight. In the order of capacity
    over weight, the sources that stop are a leading run: one is stopped if what the earlier ones leave,
    shared by weight, is above its capacity. One window over a row for each source finds that run.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"_w": weight.cast("long"), "_cap": F.col("source_size") * epochs})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    open_ = ranked.withColumns({
        "_left": (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double"),
        "_wleft": F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    level = F.col("_left") / F.col("_wleft")
    judged = open_.withColumn("_stops", F.col("_cap") < level * F.col("_w"))
    free = judged.withColumn("_level", F.max(F.when(~F.col("_stops"), F.struct(-F.col("_cap") / F.col("_w"), -F.col("_rank"), level.alias("level")))).over(all_rows)["level"])
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")))
    return free.select("source", "_rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and times: how often the mix takes the document.

    A source's documents queue in shuffled order, up to `epochs` times over. The virtual finish time of
    an entry is the source's words up to its end over the source's target. All entries are
    range-sorted by it (ties by source), and the mix is cut before the entry that goes over the budget.
    A source's running word count comes from totals of (source, leading digits of the shuffle key), so
    that no source's rows meet in one task. Ties and repeated rows are queued
    one after the other; a null source is a source of its own, the last. An empty table gives no rows; a text counts by its words however long it is.
    """
    narrow = stored(sized(docs, seed), "mix-sizes").withColumn("_cell", F.substring("_key", 1, DIGITS))
    spark = docs.sparkSession
    by_source = stored(targets(narrow, weights, epochs), "mix-targets")
    budget = narrow.agg(F.sum("size")).first()[0] or 0
    cells = narrow.groupBy("source", "_cell").agg(F.sum("size").alias("_cell_size"))
    earlier = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell_size").over(earlier), F.lit(0)))
    # The window's rows come sorted by source and cell, so the cells' offsets join without another exchange of the rows.
    inside = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = narrow.withColumn("_upto", F.sum("size").over(inside))
    same = [run["source"].eqNullSafe(cells["source"]), run["_cell"] == cells["_cell"]]
    run = run.join(cells, same, "left").select(run["doc_id"], run["source"], run["size"], (F.col("_upto") + F.col("_before")).alias("_upto"))
    run = run.join(by_source, run["source"].eqNullSafe(by_source["source"]), "left").drop(by_source["source"])
    run = stored(run, "mix-queue")

    entries = run.where("size > 0 and target > 0").select("size", "_rank", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (F.col("_upto") + e * F.col("source_size")) / F.col("target"))).alias("_finish"))
    # An entry that ends within the budget has a finish time of little over 1: of all sources together,
    # as many words as the budget holds have one of 1 or less. The sort needs all entries only if that is not so.
    cut = with_prefix_sums(entries, ["_finish", "_rank"], {"_taken": F.col("size")}, "mix-entries")
    last = cut.where(F.col("_taken") + F.col("size") <= budget).agg(F.max(F.struct("_finish", "_rank")).alias("m")).first()["m"]
    if last is None:
        return run.withColumn("times", F.lit(0)).drop("_upto", "_rank")
    at, rank = F.lit(float(last["_finish"])), F.lit(int(last["_rank"]))
    taken = lambda e: ((F.col("_upto") + F.lit(e) * F.col("source_size")) / F.col("target"))
    times = sum((F.when((taken(e) < at) | ((taken(e) == at) & (F.col("_rank") <= rank)), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return run.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)).drop("_upto", "_rank")


def mix(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's), taken (its words in the mix, repeats counted)."""
    return queued(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with their columns.

    Rows are joined back by id, source and size; rows that agree in all three are taken as often as
    their counts add up to, dealt to them in turn in the order of their texts, so that reruns agree.
    """
    # Numbered names keep extra columns clear of the operator's own.
    short = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*(docs[c].alias(s) for c, s in zip(docs.columns, short, strict=True)), docs["doc_id"], docs["source"], docs["text"])
    on = ["_id", "_source", "_size"]
    key = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))]
    times = queued(docs).select(key[0].alias(on[0]), key[1].alias(on[1]), F.col("size").alias(on[2]), "times")
    times = stored(times.groupBy(*on).agg(F.sum("times").alias("_times"), F.count("*").alias("_same")), "mix-times")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = own.select(*short, key[0].alias(on[0]), key[1].alias(on[1]), size.alias(on[2]), F.xxhash64("text").alias("_fp"))
    number = F.lit(0)
    if not times.where("_same > 1").isEmpty():
        keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy("_fp")) - 1)
        number = F.col("_k")
    out = keyed.join(times.where("_times > 0"), on)
    n = F.floor(F.col("_times") / F.col("_same")) + F.when(number < F.col("_times") % F.col("_same"), 1).otherwise(0)
    out = out.withColumn("_n", n.cast("int")).where("_n > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return out.select(*(F.col(s).alias(c) for c, s in zip(docs.columns, short, strict=True)))


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS k FROM documents
), b AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, rnk % 3 + 1 AS w FROM b
), o AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS DOUBLE) AS lvl
  FROM c WINDOW q AS (ORDER BY CAST(cap AS DOUBLE) / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, cap < lvl * w AS stops FROM o
), f AS (
  SELECT source, rnk, source_size, coalesce(CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), w *
         (SELECT arg_min(lvl, CAST(cap AS DOUBLE) / w) FROM t WHERE NOT stops)) END, 0.0) AS target FROM t
), r AS (
  SELECT s.doc_id, s.size, f.source_size, f.target, f.rnk,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source
), e AS (
  SELECT r.*, (CAST(upto + i * source_size AS DOUBLE)) / target AS finish FROM r, range(3) g(i) WHERE size > 0 AND target > 0
), u AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rnk ROWS UNBOUNDED PRECEDING) AS total FROM e
), n AS (
  SELECT doc_id, count(*) AS times FROM u WHERE total <= (SELECT sum(size) FROM s) GROUP BY doc_id
)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * coalesce(n.times, 0) AS BIGINT) AS taken FROM r LEFT JOIN n USING (doc_id)
"""
