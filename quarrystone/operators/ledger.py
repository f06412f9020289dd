"""An append-only ledger derived from events: tombstones, active records, summaries, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.study import numbered
from quarrystone.plans.registry import query
from quarrystone.sources.tables import is_object, segment_chain, table, torn_tail

_LEDGER = """SELECT event_id + 1 AS seq, user_id AS prompt_id, event_type AS kind, value,
  CASE WHEN event_type = 'error' THEN max(CASE WHEN event_type <> 'error' THEN event_id + 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS supersedes FROM events"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """seq, prompt_id, kind, value, supersedes: an error takes back the user's latest record that isn't one."""
    e = table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("prompt_id"), F.col("event_type").alias("kind"), "value")
    before = Window.partitionBy("prompt_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("supersedes", F.when(F.col("kind") == "error", F.max(F.when(F.col("kind") != "error", F.col("seq"))).over(before)))


def active(rows: DataFrame) -> DataFrame:
    gone = rows.where("supersedes is not null").select(F.col("supersedes").alias("seq")).distinct()
    return rows.where("kind <> 'error'").join(gone, "seq", "left_anti")


@query("ledger_active", f"WITH l AS ({_LEDGER}) SELECT seq, prompt_id, kind FROM l WHERE kind <> 'error' AND seq NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL)")
def ledger_active(spark, d):
    return active(ledger(spark, d)).select("seq", "prompt_id", "kind")


@query("ledger_summary", f"WITH l AS ({_LEDGER}) SELECT count(*) AS lines, count(*) FILTER (kind = 'error') AS tombstones, (SELECT count(DISTINCT supersedes) FROM l) AS superseded, max(seq) AS last_seq FROM l")
def ledger_summary(spark, d):
    return ledger(spark, d).agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "error").alias("tombstones"), F.countDistinct("supersedes").alias("superseded"), F.max("seq").alias("last_seq"))


#: The ledger with faults: tombstones of a later, a missing, another prompt's and an already taken back record, and records out of order.
_FAULTY = f"""SELECT seq, prompt_id, kind, CASE WHEN kind <> 'error' THEN NULL WHEN seq % 11 = 1 THEN seq + 1 WHEN seq % 11 = 2 THEN 0 ELSE supersedes END AS supersedes,
  CASE WHEN kind = 'error' AND seq % 11 = 3 THEN prompt_id + 1000 ELSE prompt_id END AS named FROM ({_LEDGER})"""
_TARGETS = f"""WITH l AS ({_FAULTY}), t AS (SELECT r.seq, r.supersedes, r.named, w.seq AS work, w.prompt_id AS owner, row_number() OVER (PARTITION BY r.supersedes ORDER BY r.seq) AS k
  FROM l r LEFT JOIN l w ON w.seq = r.supersedes AND w.kind <> 'error' WHERE r.kind = 'error')"""


def faulty_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d)
    target = F.expr("CASE WHEN kind <> 'error' THEN NULL WHEN seq % 11 = 1 THEN seq + 1 WHEN seq % 11 = 2 THEN 0 ELSE supersedes END")
    return rows.select("seq", "prompt_id", "kind", target.alias("supersedes"), F.when((F.col("kind") == "error") & (F.col("seq") % 11 == 3), F.col("prompt_id") + 1000).otherwise(F.col("prompt_id")).alias("named"))


def tombstone_faults(rows: DataFrame) -> DataFrame:
    """seq, fault: tombstones that don't name an earlier record of work of the same prompt that is still active. rows: seq, prompt_id, kind, supersedes, named."""
    dead = rows.where("kind = 'error'").select("seq", "supersedes", "named")
    work = rows.where("kind <> 'error'").select(F.col("seq").alias("work"), F.col("prompt_id").alias("owner"))
    first = dead.groupBy("supersedes").agg(F.min("seq").alias("first"))
    both = dead.join(work, F.col("supersedes") == F.col("work"), "left").join(first, "supersedes", "left")
    fault = (
        F.when(F.col("supersedes").isNull() | (F.col("supersedes") <= 0), "not_a_seq").when(F.col("supersedes") >= F.col("seq"), "not_earlier").when(F.col("work").isNull(), "not_work")
        .when(~F.col("named").eqNullSafe(F.col("owner")), "other_prompt").when(F.col("seq") > F.col("first"), "twice")
    )
    return both.select("seq", fault.alias("fault")).where("fault is not null")


@query(
    "ledger_integrity",
    f"{_TARGETS}, f AS (SELECT seq, CASE WHEN supersedes IS NULL OR supersedes <= 0 THEN 'not_a_seq' WHEN supersedes >= seq THEN 'not_earlier' WHEN work IS NULL THEN 'not_work' WHEN named IS DISTINCT FROM owner THEN 'other_prompt' WHEN k > 1 THEN 'twice' END AS fault FROM t) SELECT seq, fault FROM f WHERE fault IS NOT NULL",
)
def ledger_integrity(spark, d):
    """A chain holds where this is empty."""
    return tombstone_faults(faulty_ledger(spark, d))


def sequence_faults(rows: DataFrame, pos: str = "pos", seq: str = "seq", parts: int = 256) -> DataFrame:
    """pos, seq, fault: places of a chain (pos from 0, without gaps) whose seq isn't a positive number above that of the place before. Each place is joined with its predecessor, so no window spans the chain."""
    before = rows.select((F.col(pos) + 1).alias(pos), F.col(seq).alias("_before"))
    fault = F.when(F.col(seq).isNull() | (F.col(seq) <= 0), "not_positive").when(F.col(seq) <= F.col("_before"), "not_increasing")
    return rows.join(before, pos, "left").select(pos, seq, fault.alias("fault")).where("fault is not null")


@query("sequence_violations", "WITH l AS (SELECT event_id AS pos, CASE WHEN event_id % 97 = 5 THEN event_id - 3 WHEN event_id % 89 = 7 THEN -1 ELSE event_id + 1 END AS seq FROM events), b AS (SELECT *, lag(seq) OVER (ORDER BY pos) AS before FROM l) SELECT pos, seq, CASE WHEN seq <= 0 THEN 'not_positive' ELSE 'not_increasing' END AS fault FROM b WHERE seq <= 0 OR seq <= before")
def sequence_violations(spark, d):
    seq = F.expr("CASE WHEN event_id % 97 = 5 THEN event_id - 3 WHEN event_id % 89 = 7 THEN -1 ELSE event_id + 1 END")
    return sequence_faults(table(spark, d, "events").select(F.col("event_id").alias("pos"), seq.alias("seq")))


def last_active(rows: DataFrame, n: int) -> DataFrame:
    """The n active records with the largest seq; all of them if there are fewer, none for n under 1. An ordered limit keeps n rows of each part."""
    return active(rows).orderBy(F.desc("seq")).limit(max(0, n))


_ACTIVE = f"WITH l AS ({_LEDGER}), a AS (SELECT * FROM l WHERE kind <> 'error' AND seq NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL))"


@query("ledger_redo_last", f"{_ACTIVE}, z AS (SELECT seq, prompt_id FROM a ORDER BY seq DESC LIMIT 25) SELECT (SELECT max(seq) FROM l) + row_number() OVER (ORDER BY seq) AS seq, seq AS supersedes, prompt_id FROM z")
def ledger_redo_last(spark, d):
    """Tombstones for the last 25 active records, numbered on from the chain's last. The window is over those 25 rows."""
    return tombstones(ledger(spark, d), 25)


def tombstones(rows: DataFrame, n: int) -> DataFrame:
    top = rows.agg(F.max("seq").alias("_top"))
    last = last_active(rows, n).select("seq", "prompt_id").join(F.broadcast(top), F.lit(True))  # one row
    return last.select((F.col("_top") + F.row_number().over(Window.orderBy("seq"))).alias("seq"), F.col("seq").alias("supersedes"), "prompt_id")


@query(
    "ledger_rollback_summary",
    f"{_ACTIVE}, z AS (SELECT seq FROM a ORDER BY seq DESC LIMIT 25) SELECT (SELECT count(*) FROM l) + 25 AS parsed_records, (SELECT count(*) FROM a) - 25 AS active, (SELECT count(*) FROM l WHERE kind <> 'error') - (SELECT count(*) FROM a) + 25 AS superseded, (SELECT count(*) FROM l WHERE kind = 'error') + 25 AS tombstones",
)
def ledger_rollback_summary(spark, d):
    """The counts of a ledger after its last 25 records are taken back: nothing is rewritten, all is derived again."""
    rows = ledger(spark, d).select("seq", "prompt_id", "kind", "supersedes")
    every = rows.unionByName(tombstones(rows, 25).select("seq", "prompt_id", F.lit("error").alias("kind"), "supersedes"))
    counts = every.agg(F.count("*").alias("parsed_records"), F.count_if(F.col("kind") != "error").alias("work"), F.count_if(F.col("kind") == "error").alias("tombstones"))
    left = active(every).agg(F.count("*").alias("active"))
    return counts.join(F.broadcast(left), F.lit(True)).select("parsed_records", "active", (F.col("work") - F.col("active")).alias("superseded"), "tombstones")  # one row each


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """new (prompt_id, kind) as records after the last of rows: prompts that are active are not taken again, and control records are refused."""
    have = active(rows).select("prompt_id").distinct()
    fresh = new.where("kind <> 'error'").groupBy("prompt_id").agg(F.min("kind").alias("kind")).join(have, "prompt_id", "left_anti")
    top = rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    ranked = numbered(fresh.withColumn("_key", F.sha2(F.col("prompt_id").cast("string"), 256)), "_key").join(F.broadcast(top), F.lit(True))  # one row
    return ranked.select((F.col("_top") + F.col("pos") + 1).alias("seq"), "prompt_id", "kind")


@query(
    "ledger_append",
    f"{_ACTIVE}, n AS (SELECT DISTINCT c_custkey AS prompt_id FROM customer WHERE c_custkey NOT IN (SELECT prompt_id FROM a)) SELECT (SELECT max(seq) FROM l) + row_number() OVER (ORDER BY sha256(CAST(prompt_id AS VARCHAR))) AS seq, prompt_id, 'view' AS kind FROM n",
)
def ledger_append(spark, d):
    return appended(ledger(spark, d), table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("prompt_id"), F.lit("view").alias("kind")))


_SEGMENTS = """SELECT idx, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id)) AS sha FROM (SELECT event_id, event_id // 1000 AS idx FROM events) GROUP BY idx"""
_CHAIN = f"SELECT CASE WHEN idx >= 7 THEN idx + 1 ELSE idx END AS idx, sha, CASE WHEN idx % 5 = 4 THEN 'forged' ELSE lag(sha) OVER (ORDER BY idx) END AS prev_sha FROM ({_SEGMENTS})"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """idx, sha, prev_sha: blocks of events with their digests and the digest each names as its predecessor's, with a gap and a forged link. A block has a thousand rows; windows are over a row for each block."""
    rows = table(spark, d, "events").select(F.expr("event_id div 1000").alias("idx"), "event_id")
    made = rows.groupBy("idx").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "\n"), 256).alias("sha"))
    made = made.withColumn("prev_sha", F.when(F.col("idx") % 5 == 4, "forged").otherwise(F.lag("sha").over(Window.orderBy("idx"))))
    return made.withColumn("idx", F.when(F.col("idx") >= 7, F.col("idx") + 1).otherwise(F.col("idx")))


@query("segment_chain", f"WITH c AS ({_CHAIN}), b AS (SELECT *, lag(idx) OVER (ORDER BY idx) AS before, lag(sha) OVER (ORDER BY idx) AS want FROM c) SELECT idx, before FROM b WHERE before IS NOT NULL AND (idx <> before + 1 OR prev_sha IS DISTINCT FROM want)")
def segment_chain_query(spark, d):
    return segment_chain(segments(spark, d))


@query("sealed_segment", f"WITH c AS ({_CHAIN}) SELECT max(idx) + 1 AS idx, arg_max(sha, idx) AS prev_sha, max(idx) AS prev_idx, 'torn' AS reason FROM c")
def sealed_segment(spark, d):
    """The header of the segment that follows a torn one: its number, and its predecessor's number and digest."""
    return segments(spark, d).agg((F.max("idx") + 1).alias("idx_"), F.max_by("sha", "idx").alias("prev_sha"), F.max("idx").alias("prev_idx"), F.lit("torn").alias("reason")).withColumnRenamed("idx_", "idx")


_LINES = """SELECT event_id AS line_no, CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN '{"seq": ' WHEN event_id % 400 = 17 THEN '{"seq": 1}x' WHEN event_id % 400 = 18 THEN '' ELSE '{"seq": ' || event_id || '}' END AS line FROM events"""


@query("torn_tail", f"WITH l AS ({_LINES}) SELECT line_no, line, line_no = (SELECT max(line_no) FROM l) AS allowed FROM l WHERE line <> '' AND NOT json_valid(line)")
def torn_tail_query(spark, d):
    """Lines that don't parse: only the last may be torn."""
    e = table(spark, d, "events").select("event_id")
    last = e.agg(F.max("event_id").alias("top"))
    line = F.expr("""CASE WHEN event_id = top THEN '{"seq": ' WHEN event_id % 400 = 17 THEN '{"seq": 1}x' WHEN event_id % 400 = 18 THEN '' ELSE concat('{"seq": ', event_id, '}') END""")
    return torn_tail(e.join(F.broadcast(last), F.lit(True)).select(F.col("event_id").alias("line_no"), line.alias("line")))  # one row


@query("ledger_lines", f"WITH l AS ({_LINES}) SELECT count(*) FILTER (line <> '') AS total_lines, count(*) FILTER (line <> '' AND json_valid(line)) AS parsed_records, bool_or(line <> '' AND NOT json_valid(line) AND line_no = (SELECT max(line_no) FROM l)) AS truncated_tail, max(line_no) // 1000 + 1 AS segments FROM l")
def ledger_lines(spark, d):
    """Physical lines and those that parse, whether the tail is torn, and segments."""
    e = table(spark, d, "events").select("event_id")
    last = e.agg(F.max("event_id").alias("top"))
    line = F.expr("""CASE WHEN event_id = top THEN '{"seq": ' WHEN event_id % 400 = 17 THEN '{"seq": 1}x' WHEN event_id % 400 = 18 THEN '' ELSE concat('{"seq": ', event_id, '}') END""")
    rows = e.join(F.broadcast(last), F.lit(True)).select("event_id", "top", line.alias("line")).where("line <> ''").withColumn("ok", is_object("line"))  # one row
    out = rows.agg(F.count("*").alias("total_lines"), F.count_if("ok").alias("parsed_records"), F.bool_or(~F.col("ok") & (F.col("event_id") == F.col("top"))).alias("truncated_tail"), F.max("top").alias("m"))
    return out.select("total_lines", "parsed_records", "truncated_tail", F.expr("m div 1000 + 1").alias("segments"))


@query("ledger_latest", f"WITH l AS ({_LEDGER}), a AS (SELECT * FROM l WHERE kind <> 'error' AND seq NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL)) SELECT prompt_id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM a GROUP BY prompt_id")
def ledger_latest(spark, d):
    return active(ledger(spark, d)).groupBy("prompt_id").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind_")).withColumnRenamed("kind_", "kind")


@query("pass_histogram", "WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), p AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM s WHERE k <= 8 GROUP BY user_id) SELECT CAST(i AS BIGINT) AS passed, count(user_id) AS n FROM range(9) t(i) LEFT JOIN p ON passed = i GROUP BY i")
def pass_histogram(spark, d):
    """Passes of the first eight generations of each prompt, all counts from 0 to 8 present."""
    e = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 8")
    p = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("passed")).groupBy("passed").agg(F.count("*").alias("n"))
    return spark.range(9).withColumnRenamed("id", "passed").join(p, "passed", "left").select("passed", F.coalesce("n", F.lit(0)).alias("n"))


@query("materialize_pairs", "WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT * FROM s WHERE k <= 8) SELECT user_id AS prompt_id, min(event_id) FILTER (event_type = 'purchase') AS chosen, min(event_id) FILTER (event_type <> 'purchase') AS rejected FROM f GROUP BY user_id HAVING count(DISTINCT event_type = 'purchase') = 2")
def materialize_pairs(spark, d):
    """The first accepted and the first rejected generation of each prompt that has both."""
    e = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 8")
    ok = F.col("event_type") == "purchase"
    out = e.groupBy(F.col("user_id").alias("prompt_id")).agg(F.min(F.when(ok, F.col("event_id"))).alias("chosen"), F.min(F.when(~ok, F.col("event_id"))).alias("rejected"))
    return out.where("chosen is not null and rejected is not null")
