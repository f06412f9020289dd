"""Scoring of model outputs against answer keys, audits of stored scores, and comparison of keys."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.operators.toolcalls import call_text, canonical_json
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE = T.StructType([*(T.StructField(f, T.BooleanType()) for f in ("name_ok", "args_ok", "overall_ok")), T.StructField("reason", T.StringType())])


def embedded_object(text: str | None) -> dict | None:
    """The JSON object from the first opening to the last closing brace."""
    t = text or ""
    try:
        value = json.loads(t[t.index("{") : t.rindex("}") + 1])
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def same_value(got, want) -> bool:
    """Numbers by value as floats, truth values and all else by Python's equality (where True == 1)."""
    numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (got, want))
    return float(got) == float(want) if numbers else got == want


def argument_faults(args: dict, key: dict) -> Iterator[str]:
    """All that is wrong with arguments, in the order in which one is reported: names the key doesn't know come first. An empty string among the accepted values makes an argument optional."""
    yield from (f"extra_arg:{a}" for a in args if a not in key)
    for a, accepted in key.items():
        if a in args:
            if not any(same_value(args[a], v) for v in accepted):
                yield f"bad_value:{a}"
        elif "" not in accepted:
            yield f"missing_arg:{a}"


def scored(output: str | None, key: dict[str, dict]) -> tuple[bool, bool, bool, str]:
    """name_ok, args_ok, overall_ok and the first fault. Only the first function of the key counts."""
    call = embedded_object(output)
    if call is None:
        return False, False, False, "json_unparseable"
    if not {"name", "arguments"} <= call.keys():
        return False, False, False, "missing_name_or_arguments"
    if not isinstance(call["arguments"], dict):
        return False, False, False, "arguments_not_dict"
    name, args = next(iter(key.items()))
    name_ok, fault = call["name"] == name, next(argument_faults(call["arguments"], args), "")
    return name_ok, not fault, name_ok and not fault, fault or ("" if name_ok else "bad_name")


@F.pandas_udf(SCORE)
def score(output: pd.Series, key: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scored(o, json.loads(k)) for o, k in zip(output, key, strict=True)], columns=SCORE.names)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """event_id, output, key: outputs as they should be, in prose, torn, with an argument too many, without arguments, and of another shape."""
    output = F.expr("""CASE event_id % 6 WHEN 0 THEN call WHEN 1 THEN concat('Sure: ', call, ' done') WHEN 2 THEN left(call, length(call) - 1)
      WHEN 3 THEN concat(left(call, length(call) - 2), ', "z": 1}}') WHEN 4 THEN concat('{"name": "', event_type, '", "arguments": {}}') ELSE '{"name": "x", "k": 1}' END""")
    key = F.expr("""concat('{"', if(user_id % 5 = 0, 'other', event_type), '": {"k": [', cast(get_json_object(props, '$.k') AS bigint) + if(event_id % 4 = 0, 1, 0), '.0', if(user_id % 2 = 0, ', ""', ''), ']}}')""")
    return table(spark, d, "events").withColumn("call", call_text()).select("event_id", output.alias("output"), key.alias("key"))


_SCORED = """SELECT event_id, coalesce(name_ok AND m NOT IN (2, 5), false) AS name_ok, reason IN ('', 'bad_name') AS args_ok, reason = '' AS overall_ok, reason FROM (
  SELECT event_id, m, name_ok, CASE WHEN m = 2 THEN 'json_unparseable' WHEN m = 5 THEN 'missing_name_or_arguments' WHEN m = 3 THEN 'extra_arg:z'
    WHEN m = 4 AND NOT optional THEN 'missing_arg:k' WHEN m < 2 AND NOT value_ok THEN 'bad_value:k' WHEN NOT name_ok THEN 'bad_name' ELSE '' END AS reason
  FROM (SELECT event_id, event_id % 6 AS m, user_id % 5 <> 0 AS name_ok, user_id % 2 = 0 AS optional, event_id % 4 <> 0 AS value_ok FROM events))"""


@query("score_calls", _SCORED)
def score_calls(spark, d):
    return answers(spark, d).select("event_id", score("output", "key").alias("s")).select("event_id", "s.*")


@query("rescore_vs_stored", f"SELECT event_id, event_id % 6 < 2 AS stored, overall_ok AS recomputed FROM ({_SCORED}) WHERE (event_id % 6 < 2) IS DISTINCT FROM overall_ok")
def rescore_vs_stored(spark, d):
    """Rows whose stored verdict isn't the one that scoring gives now."""
    rows = score_calls(spark, d).select("event_id", (F.col("event_id") % 6 < 2).alias("stored"), F.col("overall_ok").alias("recomputed"))
    return rows.where("not (stored <=> recomputed)")


@query("score_reason_counts", f"SELECT reason, count(*) AS n FROM ({_SCORED}) GROUP BY reason")
def score_reason_counts(spark, d):
    return score_calls(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query("key_difference", "SELECT event_id FROM events WHERE event_id % 10 = 0")
def key_difference(spark, d):
    """Ids whose two keys differ in value, not in spacing alone."""
    rows = table(spark, d, "events").select("event_id", "props")
    other = F.when(F.col("event_id") % 10 == 0, F.expr("""concat(left(props, length(props) - 1), ', "extra": 1}')""")).otherwise(F.regexp_replace("props", ": ", ":"))
    a, b = rows.select("event_id", canonical_json("props").alias("a")), rows.select("event_id", canonical_json(other).alias("b"))
    return a.join(b, "event_id").where("not (a <=> b)").select("event_id")


_CANDIDATES = ("ref", "cand_a", "cand_b")


@query(
    "completeness_check",
    """WITH seen AS (SELECT doc_id, c AS candidate, 1 AS k FROM labels, (SELECT unnest(['ref', 'cand_a', 'cand_b', 'cand_z']) AS c) WHERE NOT (c = 'cand_a' AND doc_id % 50 = 0) AND (c <> 'cand_z' OR doc_id % 70 = 0)
      UNION ALL SELECT doc_id, 'ref', 1 FROM labels WHERE doc_id % 60 = 0
    ), n AS (SELECT doc_id, candidate, count(*) AS n FROM seen GROUP BY ALL), want AS (SELECT DISTINCT doc_id, c AS candidate FROM labels, (SELECT unnest(['ref', 'cand_a', 'cand_b']) AS c))
    SELECT coalesce(w.doc_id, n.doc_id) AS doc_id, coalesce(w.candidate, n.candidate) AS candidate, CASE WHEN n.n IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'extra' ELSE 'duplicate' END AS fault
    FROM want w FULL JOIN n ON w.doc_id = n.doc_id AND w.candidate = n.candidate WHERE n.n IS NULL OR w.doc_id IS NULL OR n.n > 1""",
)
def completeness_check(spark, d):
    """Each item must be there once for each candidate: what is missing, extra or there twice."""
    ids = table(spark, d, "labels").select("doc_id")
    by = lambda names: ids.select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("candidate"))
    seen = by((*_CANDIDATES, "cand_z")).where("not (candidate = 'cand_a' and doc_id % 50 = 0) and (candidate <> 'cand_z' or doc_id % 70 = 0)")
    seen = seen.union(ids.where("doc_id % 60 = 0").select("doc_id", F.lit("ref")))
    want, n = by(_CANDIDATES).distinct().withColumn("w", F.lit(True)), seen.groupBy("doc_id", "candidate").agg(F.count("*").alias("n"))
    both = want.join(n, ["doc_id", "candidate"], "full").where("n is null or w is null or n > 1")
    return both.select("doc_id", "candidate", F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("duplicate").alias("fault"))


@query("manifest_entry_violations", "SELECT source AS category, lang AS role, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) <> 1")
def manifest_entry_violations(spark, d):
    """A manifest holds one entry for each category and role."""
    return table(spark, d, "documents").groupBy(F.col("source").alias("category"), F.col("lang").alias("role")).agg(F.count("*").alias("n")).where("n <> 1")


def field_differences(have: DataFrame, want: DataFrame) -> DataFrame:
    """Fields (field, value) of two records that aren't the same, absent ones included: a gate passes where there are none."""
    a, b = have.select("field", F.col("value").alias("have")), want.select("field", F.col("value").alias("want"))
    return a.join(b, "field", "full").where("not (have <=> want)")


@query(
    "run_metadata_diff",
    "SELECT coalesce(a.n_name, b.n_name) AS field, CAST(a.n_regionkey AS VARCHAR) AS have, CAST(b.v AS VARCHAR) AS want FROM (SELECT * FROM nation WHERE n_nationkey <> 3) a FULL JOIN (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey <> 4) b ON a.n_name = b.n_name WHERE a.n_regionkey IS DISTINCT FROM b.v",
)
def run_metadata_diff(spark, d):
    n = table(spark, d, "nation")
    have = n.where("n_nationkey <> 3").select(F.col("n_name").alias("field"), F.col("n_regionkey").cast("string").alias("value"))
    want = n.where("n_nationkey <> 4").select(F.col("n_name").alias("field"), F.expr("cast(if(n_nationkey % 5 = 0, n_regionkey + 1, n_regionkey) as string)").alias("value"))
    return field_differences(have, want)
