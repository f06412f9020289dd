"""Conversations: first messages by role, joined roles, the split at the first answer, assembly, turn filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def first_of(turns: DataFrame, role: str) -> DataFrame:
    """conv_id, content: the first message of a role."""
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("content"))


def _first_sql(role: str) -> str:
    return f"SELECT conv_id, arg_min(text, turn) AS content FROM conversations WHERE role = '{role}' GROUP BY conv_id"


@query("first_user_message", _first_sql("user"))
def first_user_message(spark, d):
    return first_of(conversations(spark, d), "user")


@query("first_system_message", _first_sql("system"))
def first_system_message(spark, d):
    return first_of(conversations(spark, d), "system")


@query("first_assistant_message", _first_sql("assistant"))
def first_assistant_message(spark, d):
    return first_of(conversations(spark, d), "assistant")


def in_order(column: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", column))), lambda x: x[column])


@query("role_text_joined", "SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS content FROM conversations GROUP BY conv_id, role")
def role_text_joined(spark, d):
    return conversations(spark, d).groupBy("conv_id", "role").agg(F.array_join(in_order("text"), " ").alias("content"))


@query(
    "split_first_assistant",
    "WITH a AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS t FROM conversations GROUP BY conv_id) "
    "SELECT c.conv_id, coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (t IS NULL OR turn < t), '') AS prefix, coalesce(max(text) FILTER (turn = t), '') AS target "
    "FROM conversations c JOIN a USING (conv_id) GROUP BY c.conv_id",
)
def split_first_assistant(spark, d):
    """Messages before the first answer, and that answer; without one, all messages and an empty target."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = conversations(spark, d).groupBy("conv_id").agg(turns.alias("m"))
    at = F.array_position(F.col("m.role"), "assistant")
    prefix = F.when(at == 0, F.col("m")).otherwise(F.slice("m", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    return rows.select("conv_id", F.array_join(F.transform(prefix, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|").alias("prefix"), F.coalesce(F.get(F.col("m.text"), (at - 1).cast("int")), F.lit("")).alias("target"))


@query("conversation_assembly", "SELECT conv_id, '[' || string_agg(CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END || '=' || md5(text), ',' ORDER BY turn) || ']' AS messages, count(*) AS n FROM conversations WHERE text <> '' GROUP BY conv_id")
def conversation_assembly(spark, d):
    """Roles renamed by a map, empty turns dropped, turns in order."""
    rows = conversations(spark, d).where("text <> ''").withColumn("role", F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").otherwise(F.col("role")))
    rows = rows.withColumn("x", F.concat("role", F.lit("="), F.md5("text"))).groupBy("conv_id").agg(in_order("x").alias("m"), F.count("*").alias("n"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join("m", ","), F.lit("]")).alias("messages"), "n")


@query("min_turn_filter", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 3")
def min_turn_filter(spark, d):
    return conversations(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("bucketize_counts", "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT CASE WHEN n <= 4 THEN CAST(n AS VARCHAR) WHEN n <= 6 THEN '5-6' ELSE '7+' END AS bucket, count(*) AS n_convs FROM n GROUP BY 1")
def bucketize_counts(spark, d):
    n = conversations(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") <= 4, F.col("n").cast("string")).when(F.col("n") <= 6, "5-6").otherwise("7+").alias("bucket")).agg(F.count("*").alias("n_convs"))


@query("most_common", "SELECT role, count(*) AS n, min(conv_id) AS first_seen FROM conversations GROUP BY role ORDER BY n DESC, first_seen LIMIT 3")
def most_common(spark, d):
    """A top-k report."""
    return conversations(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(3)


@query("explode_rounds", "SELECT conv_id, 'round' || CAST((turn // 2) AS INTEGER) || '.msg' || CAST((turn % 2) AS INTEGER) AS tag, text FROM conversations WHERE role = 'user'")
def explode_rounds(spark: SparkSession, d: str) -> DataFrame:
    """User texts of nested rounds with their place."""
    rounds = conversations(spark, d).groupBy("conv_id", F.floor(F.col("turn") / 2).alias("r")).agg(F.array_sort(F.collect_list(F.struct((F.col("turn") % 2).alias("j"), "role", "text"))).alias("m"))
    flat = rounds.select("conv_id", "r", F.explode("m").alias("x")).where("x.role = 'user'")
    return flat.select("conv_id", F.concat(F.lit("round"), F.col("r").cast("string"), F.lit(".msg"), F.col("x.j").cast("string")).alias("tag"), "x.text")
