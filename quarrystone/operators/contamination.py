"""Contamination of documents by benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import ngrams, normalized, once, plain_tokens
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

N = 13
#: Grams of an index that goes to every task.
BROADCAST_GRAMS = 1_000_000


def gram_index(items: DataFrame, n: int = N) -> DataFrame:
    """gram, category: of each gram the category of the first item that has it."""
    grams = items.select("item_id", "category", F.explode(ngrams(plain_tokens(F.col("text")), n)).alias("gram"))
    return grams.groupBy("gram").agg(F.min_by("category", "item_id").alias("category"))


def hashed_grams(tokens: Column, n: int = N) -> Column:
    """The hash of each run of n tokens, each token hashed once."""
    hashes = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, n)))
    return once(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(h) >= n, hashes(h)).otherwise(F.array().cast("array<bigint>")))


def gram_hits(docs: DataFrame, index: DataFrame, n: int = N) -> DataFrame:
    """doc_id, pos, gram, category of every indexed gram in a document.

    Runs are matched by hashes first, so only places that hold a gram are spelled out; the texts then decide. An index of up to
    BROADCAST_GRAMS grams goes to every task, a larger one is joined by a shuffle.
    """
    hashed = index.select("gram", "category", F.xxhash64(F.transform(F.split("gram", " "), lambda t: F.xxhash64(t))).alias("_h"))
    keys = hashed.select("_h").distinct()
    small = index.count() <= BROADCAST_GRAMS
    rows = docs.select("doc_id", plain_tokens(F.col("text")).alias("_t"))
    places = rows.select("doc_id", F.posexplode(hashed_grams(F.col("_t"), n)).alias("pos", "_h"))
    places = places.join(F.broadcast(keys) if small else keys, "_h", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("_at"))
    spelled = docs.join(places, "doc_id").select("doc_id", plain_tokens(F.col("text")).alias("_t"), "_at")
    grams = F.transform("_at", lambda p: F.struct(p.alias("pos"), F.array_join(F.slice("_t", p + 1, n), " ").alias("gram")))
    found = spelled.select("doc_id", F.inline(grams)).distinct()
    return found.join(F.broadcast(index) if small else index, "gram").select("doc_id", "pos", "gram", "category")


def first_hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, category: of each document with an indexed gram, the category of the first."""
    return gram_hits(docs, index).groupBy("doc_id").agg(F.min_by("category", "pos").alias("category"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_matches(t, '[\p{L}\p{N}]'))"


def _grams(source: str, columns: str) -> str:
    return f"SELECT {columns}, p, array_to_string(w[p + 1:p + {N}], ' ') AS gram FROM (SELECT *, {_TOKENS} AS w FROM {source}), LATERAL (SELECT unnest(range(len(w) - {N - 1})) AS p) WHERE len(w) >= {N}"


@query("contamination_13gram", f"WITH b AS ({_grams('benchmark', 'item_id')}), g AS ({_grams('documents', 'doc_id')}) SELECT g.doc_id, count(DISTINCT g.gram) AS n_grams FROM g WHERE gram IN (SELECT gram FROM b) GROUP BY g.doc_id")
def contamination_13gram(spark: SparkSession, d: str) -> DataFrame:
    hits = gram_hits(table(spark, d, "documents"), gram_index(items(spark, d)))
    return hits.groupBy("doc_id").agg(F.countDistinct("gram").alias("n_grams"))


_INDEX = f"SELECT gram, arg_min(category, item_id) AS category FROM ({_grams('(SELECT *, concat($$c$$, item_id % 4) AS category FROM benchmark)', 'item_id, category')}) GROUP BY gram".replace("$$", "'")


#: The SQL of first_hits over documents and the benchmark.
FIRST_HITS = f"SELECT g.doc_id, arg_min(i.category, g.p) AS category FROM ({_grams('documents', 'doc_id')}) g JOIN ({_INDEX}) i USING (gram) GROUP BY g.doc_id"


@query(
    "contamination_cascade",
    f"WITH i AS ({_INDEX}), g AS ({_grams('documents', 'doc_id')}), h AS (SELECT g.doc_id, arg_min(i.category, g.p) AS category FROM g JOIN i USING (gram) GROUP BY g.doc_id) "
    "SELECT d.doc_id, coalesce('ngram_overlap:' || h.category, CASE WHEN d.source IN ('src1', 'src3') THEN 'fn_name:' || d.source || ':c0' END) AS reason "
    "FROM documents d LEFT JOIN h USING (doc_id) WHERE h.category IS NOT NULL OR d.source IN ('src1', 'src3')",
)
def contamination_cascade(spark: SparkSession, d: str) -> DataFrame:
    """n-grams first, then listed names: the first hit is the reason."""
    docs = table(spark, d, "documents")
    hits = first_hits(docs, gram_index(items(spark, d)))
    named = F.when(F.col("source").isin("src1", "src3"), F.concat(F.lit("fn_name:"), "source", F.lit(":c0")))
    out = docs.select("doc_id", "source").join(hits, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.concat(F.lit("ngram_overlap:"), "category"), named).alias("reason")).where("reason is not null")


_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(
    "exact_normalized_match",
    f"WITH t AS (SELECT doc_id, {_NORMAL} AS t FROM documents), c AS (SELECT t, min(doc_id) AS class_id, count(*) AS n FROM t GROUP BY t), i AS (SELECT {_NORMAL} AS t, count(*) AS n_items FROM benchmark GROUP BY 1) "
    "SELECT t.doc_id, c.class_id, c.n, coalesce(i.n_items, 0) AS n_items FROM t JOIN c USING (t) LEFT JOIN i USING (t) WHERE c.n > 1 OR i.n_items > 0",
)
def exact_normalized_match(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose normalized text another document or an item has: class_id (the smallest doc_id of the text), n (its documents), n_items. Copies are members of a class, not pairs."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(normalized(F.col("text"))).alias("t"))
    classes = docs.groupBy("t").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    known = table(spark, d, "benchmark").groupBy(F.md5(normalized(F.col("text"))).alias("t")).agg(F.count("*").alias("i"))
    classes = classes.join(known, "t", "left").withColumn("n_items", F.coalesce("i", F.lit(0))).where("n > 1 or n_items > 0")
    return docs.join(classes, "t").select("doc_id", "class_id", "n", "n_items")
