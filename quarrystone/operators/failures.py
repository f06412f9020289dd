"""Failures among sampled generations: lenient reading, categories, distinct failures, and gates on their number."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.operators import study
from quarrystone.operators.toolcalls import call_text
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

READ = T.StructType([T.StructField("canon", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
#: Failures that a set of hard pairs needs at least.
ENOUGH = 1500


def lenient(text: str | None) -> tuple[bool, object]:
    """(True, value) of the whole text as JSON, else of what follows its first bracket, else its first brace; (False, None) if none parses."""
    t = (text or "").strip()
    starts = [0] + [at for at in (t.find("["), t.find("{")) if at > 0]
    for at in starts:
        try:
            return True, json.loads(t[at:])
        except (ValueError, RecursionError):
            continue
    return False, None


def called(value) -> list[str] | None:
    """The names of a call or of a list of calls, sorted; None if one isn't a call."""
    calls = value if isinstance(value, list) else [value]
    return sorted(str(c["name"]) for c in calls) if all(isinstance(c, dict) and "name" in c for c in calls) else None


def failure(generation: str | None, chosen: str | None) -> str:
    """success, invalid_json, wrong_tool or wrong_args. A generation that is no call has the wrong tool; a chosen text that is none names none to compare with. Values are compared as Python does: 1 is 1.0 and True."""
    ok, got = lenient(generation)
    known, want = lenient(chosen)
    if not ok or got is None:
        return "invalid_json"
    if known and want is not None and got == want:
        return "success"
    names, wanted = called(got), called(want) if known and want is not None else None
    return "wrong_tool" if names is None or (wanted is not None and names != wanted) else "wrong_args"


@F.pandas_udf(T.StringType())
def category(generation: pd.Series, chosen: pd.Series) -> pd.Series:
    return pd.Series([failure(g, c) for g, c in zip(generation, chosen, strict=True)])


@F.pandas_udf(T.StringType())
def rejected_key(text: pd.Series) -> pd.Series:
    """What tells a rejected text apart: its value with keys sorted, or the text itself without space around."""

    def key(t: str | None) -> str:
        ok, value = lenient(t)
        return json.dumps(value, sort_keys=True) if ok and value is not None else (t or "").strip()

    return text.map(key)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, generation, chosen: right calls, with prose before them, spaced otherwise, in a list, torn, of other arguments, of another tool, and no call at all."""
    e = table(spark, d, "events").withColumn("c", call_text())
    forms = ("c", "concat('Sure: ', c)", "replace(c, ': ', ':')", "concat('[', c, ']')", "left(c, length(c) - 1)", "replace(c, '\"k\": ', '\"k\": 9')", "replace(c, event_type, 'lookup')", "'[7]'", "'prose'")
    made = F.array(*map(F.expr, forms))[(F.col("event_id") % len(forms)).cast("int")]
    return e.select("event_id", "user_id", made.alias("generation"), F.col("c").alias("chosen"))


_FAILURES = "SELECT event_id, user_id, CASE event_id % 9 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'success' WHEN 3 THEN 'wrong_args' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'wrong_args' WHEN 6 THEN 'wrong_tool' WHEN 7 THEN 'wrong_tool' ELSE 'invalid_json' END AS failure FROM events"


@query("failure_classify", f"SELECT event_id, failure FROM ({_FAILURES})")
def failure_classify(spark, d):
    return attempts(spark, d).select("event_id", category("generation", "chosen").alias("failure"))


@query("failure_rate", f"SELECT count(DISTINCT user_id) AS prompts, count(*) AS attempts, count(*) FILTER (failure <> 'success') AS failures, count(DISTINCT CASE WHEN failure <> 'success' THEN user_id END) AS prompts_with_failure, round(count(*) FILTER (failure <> 'success') / count(*), 6) AS rate, count(*) FILTER (failure <> 'success') >= {ENOUGH} AS enough FROM ({_FAILURES})")
def failure_rate(spark, d):
    """Failures, the prompts that have one, and whether they are enough for a set of pairs."""
    r = attempts(spark, d).select("user_id", (category("generation", "chosen") != "success").alias("bad"))
    out = r.agg(F.countDistinct("user_id").alias("prompts"), F.count("*").alias("attempts"), F.count_if("bad").alias("failures"), F.countDistinct(F.when(F.col("bad"), F.col("user_id"))).alias("prompts_with_failure"))
    return out.select("*", F.round(F.try_divide("failures", "attempts"), 6).alias("rate"), (F.col("failures") >= ENOUGH).alias("enough"))


@query("distinct_failures", f"SELECT user_id, n_keys, n FROM (SELECT user_id, count(DISTINCT k) AS n_keys, count(*) AS n FROM (SELECT f.user_id, CASE e.event_id % 9 WHEN 4 THEN 'torn' || event_type || (props->>'k') WHEN 7 THEN '[7]' WHEN 8 THEN 'prose' WHEN 3 THEN 'list' || event_type || (props->>'k') WHEN 5 THEN 'call' || event_type || '9' || (props->>'k') ELSE 'calllookup' || (props->>'k') END AS k FROM ({_FAILURES}) f JOIN events e USING (event_id) WHERE failure <> 'success') GROUP BY user_id)")
def distinct_failures(spark, d):
    """How many different failures each prompt has: texts that parse to the same value are one."""
    r = attempts(spark, d).where(category("generation", "chosen") != "success").select("user_id", rejected_key("generation").alias("k"))
    return r.groupBy("user_id").agg(F.countDistinct("k").alias("n_keys"), F.count("*").alias("n"))


@query("canonical_drop", "SELECT event_id FROM events WHERE event_id % 9 NOT IN (0, 1, 2)")
def canonical_drop(spark, d):
    """Pairs stay unless both sides parse to the same value."""
    return attempts(spark, d).where(rejected_key("generation") != rejected_key("chosen")).select("event_id")


@query("marker_rows", "SELECT event_id % 50 = 0 AS marker, count(*) AS n FROM events GROUP BY 1")
def marker_rows(spark, d):
    """Rows that mark a prompt as sampled, and rows of failures: told apart by a field that only the markers have."""
    marked = F.when(F.col("event_id") % 50 == 0, F.col("user_id"))
    return table(spark, d, "events").groupBy(marked.isNotNull().alias("marker")).agg(F.count("*").alias("n"))


@query("exact_after_strip", "SELECT count(*) AS n, count(*) FILTER (trim(a) = trim(b)) AS same FROM (SELECT event_type AS a, CASE WHEN event_id % 3 = 0 THEN '  ' || event_type || ' ' WHEN event_id % 3 = 1 THEN event_type ELSE upper(event_type) END AS b FROM events)")
def exact_after_strip(spark, d):
    b = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), "event_type", F.lit(" "))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.upper("event_type"))
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(F.trim("event_type") == F.trim(b)).alias("same"))


_METRICS = "SELECT event_id AS step, user_id % 5 AS run, value / 100 AS accuracy, value / 40 - 1 AS reward FROM events WHERE event_id % 10 = 0"


@query(
    "abort_conditions",
    f"WITH m AS ({_METRICS}), f AS (SELECT run, arg_min(accuracy, step) AS first_accuracy, min(step) AS first_step, min(step) FILTER (reward < -0.9) AS kill_step FROM m GROUP BY run) SELECT run, first_accuracy >= 0.3 AS too_easy, kill_step, CASE WHEN first_accuracy >= 0.3 THEN first_step ELSE kill_step END AS stop_step FROM f",
)
def abort_conditions(spark, d):
    """Where a run stops: at its first evaluation if that is too good, else at the first whose reward is below the line."""
    m = table(spark, d, "events").where("event_id % 10 = 0").select(F.col("event_id").alias("step"), (F.col("user_id") % 5).alias("run"), (F.col("value") / 100).alias("accuracy"), (F.col("value") / 40 - 1).alias("reward"))
    f = m.groupBy("run").agg((F.min_by("accuracy", "step") >= 0.3).alias("too_easy"), F.min("step").alias("first_step"), F.min(F.when(F.col("reward") < -0.9, F.col("step"))).alias("kill_step"))
    return f.select("run", "too_easy", "kill_step", F.when(F.col("too_easy"), F.col("first_step")).otherwise(F.col("kill_step")).alias("stop_step"))


@query("running_accuracy", "SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 20")
def running_accuracy(spark, d):
    """The share of right answers so far, for the first twenty of each run."""
    e = study.first_events(spark, d, 20)
    so_far = F.avg((F.col("event_type") == "purchase").cast("double")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("user_id", "event_id", F.round(so_far, 6).alias("accuracy"))
