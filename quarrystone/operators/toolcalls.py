"""Tool calls: strict parsing, canonical form, classification of targets, verification of generations.

JSON is parsed strictly (no trailing text, the last of repeated keys wins), which the built-in functions don't do,
so these functions run on Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = T.StructType([T.StructField("kind", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
CALLS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("calls", T.ArrayType(T.StringType()))])


# The marks around a call in running text, and the reasons of verdicts.
OPEN, CLOSE = "<tool_call>", "</tool_call>"
REASONS = ["spurious_call", "invalid_json", "missing_call", "wrong_tool", "wrong_args"]
#: Targets that no verdict may rest on.
REFUSALS = ["target_unreadable", "parser_disagreement"]


def parsed(text: str | None, literal: bool = True):
    """(True, value) of JSON or, where that is allowed, a Python literal; else (False, None)."""
    for read in (json.loads, ast.literal_eval) if literal else (json.loads,):
        try:
            return True, read((text or "").strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return False, None


def canonical(value) -> str | None:
    """Compact JSON with sorted keys; None for what JSON can't hold (sets, bytes, keys that don't sort)."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError, RecursionError):
        return None


def bare(block: str) -> str:
    """block without the space and the written-out line ends and tabs around it."""
    while True:
        cut = block.strip()
        for mark in (r"\n", r"\r", r"\t"):
            cut = cut.removeprefix(mark).removesuffix(mark)
        if cut == block:
            return cut
        block = cut


def marked_blocks(text: str) -> list[str] | None:
    """What stands between each opening mark and its closing one; None if one is without the other or holds no object."""
    before, *pieces = text.split(OPEN)
    if CLOSE in before or any(p.count(CLOSE) != 1 for p in pieces):
        return None
    blocks = [bare(p.partition(CLOSE)[0]) for p in pieces]
    return blocks if all(b[:1] == "{" and b[-1:] == "}" for b in blocks) else None


def members(text: str) -> tuple[str, list]:
    """Kind (call, no_call, unreadable) as the form of the text tells, and the values that should be calls."""
    t = text.strip()
    if OPEN in t:
        blocks = marked_blocks(t)
        read = [parsed(b) for b in blocks or []]
        return ("call", [v for _, v in read]) if read and all(ok for ok, _ in read) else ("unreadable", [])
    if t[:1] in ("{", "["):
        ok, value = parsed(t, literal=False)
        values = value if isinstance(value, list) else [value]
        return ("call", values) if ok and values else ("unreadable", [])
    return ("no_call" if t else "unreadable"), []


def classified(text: str | None) -> tuple[str, set[str]]:
    """Kind of a target and the names it calls. Outside of marks an empty name counts as one."""
    kind, values = members(text or "")
    empty_too = OPEN not in (text or "")
    if any(not isinstance(v, dict) or not isinstance(v.get("name"), str) or not (v["name"] or empty_too) for v in values):
        return "unreadable", set()
    return kind, {v["name"] for v in values}


def calls_of(text: str | None) -> tuple[str, list[str]]:
    """Kind and the canonical [name, arguments] of each call; one bad member makes the whole unreadable. Arguments may be named parameters; absent ones are null."""
    kind, values = members(text or "")
    if any(not isinstance(v, dict) or not isinstance(v.get("name"), str) or not v["name"] for v in values):
        return "unreadable", []
    calls = [canonical([v["name"], v.get("arguments", v.get("parameters"))]) for v in values]
    return (kind, calls) if all(c is not None for c in calls) else ("unreadable", [])


def judged(generation: str | None, target: str | None) -> str:
    """accepted or one of REASONS; one of REFUSALS where the target can't be read, or its two readings differ."""
    kind, names = classified(target)
    own, wanted = calls_of(target)
    named = lambda calls: sorted(json.loads(c)[0] for c in calls)
    if kind == "unreadable":
        return "target_unreadable"
    if own != kind or set(named(wanted)) != names:
        return "parser_disagreement"
    got, calls = calls_of(generation)
    if got == "unreadable":
        return "invalid_json"
    if kind != got:
        return "missing_call" if kind == "call" else "spurious_call"
    if sorted(calls) == sorted(wanted):
        return "accepted"
    return "wrong_args" if named(calls) == named(wanted) else "wrong_tool"


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: canonical(v) if (v := parsed(t, literal=False)[1]) is not None else None)


@F.pandas_udf(CALLS)
def extract_calls(text: pd.Series) -> pd.DataFrame:
    found = [calls_of(t) for t in text]
    return pd.DataFrame({"kind": [k for k, _ in found], "calls": [c for _, c in found]})


@F.pandas_udf(TARGET)
def classify(text: pd.Series) -> pd.DataFrame:
    found = [classified(t) for t in text]
    return pd.DataFrame({"kind": [k for k, _ in found], "names": [sorted(n) for _, n in found]})


@F.pandas_udf(T.StringType())
def verdict(generation: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([judged(g, t) for g, t in zip(generation, target, strict=True)])


def call_text():
    return F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}"))


#: (generation, target, verdict): C is a call, T its tool's name, P its arguments, D another call, Q arguments of another type.
CASES = (
    ("C", "C", "accepted"),
    ("<tool_call>C</tool_call>", "C", "accepted"),
    ("<tool_call>\n{'name': 'T', 'arguments': P}\n</tool_call>", "[C]", "accepted"),
    ("{'name': 'T', 'arguments': P}", "C", "invalid_json"),
    ("", "C", "invalid_json"),
    ("I can not.", "C", "missing_call"),
    ("C", "Which one?", "spurious_call"),
    ("<tool_call>C", "No.", "invalid_json"),
    ("<tool_call>C</tool_call> and <tool_call>D</tool_call>", "[D, C]", "accepted"),
    ("<tool_call>C</tool_call><tool_call>torn</tool_call>", "C", "invalid_json"),
    ('{"name": "T", "parameters": P}', "C", "accepted"),
    ('{"name": "T"}', "C", "wrong_args"),
    ("D", "C", "wrong_tool"),
    ("C", "", "target_unreadable"),
    ("C", '{"name": "", "arguments": {}}', "parser_disagreement"),
    ("[C, 7]", "C", "invalid_json"),
    ('{"name": "T", "arguments": Q}', "C", "wrong_args"),
    ('<tool_call>{"name": "T", "arguments": {1, 2}}</tool_call>', "C", "invalid_json"),
)
PARTS = {"C": "c", "D": """'{"name": "lookup", "arguments": {}}'""", "T": "event_type", "P": "props", "Q": """'{"k": "5"}'"""}


def by_case(of) -> str:
    return f"CASE event_id % {len(CASES)} " + " ".join(f"WHEN {i} THEN {of(case)}" for i, case in enumerate(CASES)) + " END"


def graded(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, generation, target: every form of CASES."""
    e = table(spark, d, "events").withColumn("c", call_text())
    spark_text = lambda template: F.concat(*(F.expr(PARTS[x]) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\b([CDTPQ])\b", template))))
    pick = lambda j: F.array(*(spark_text(case[j]) for case in CASES))[(F.col("event_id") % len(CASES)).cast("int")]
    return e.select("event_id", "user_id", pick(0).alias("generation"), pick(1).alias("target"))


_CALL = """'{"name": "' || event_type || '", "arguments": ' || props || '}'"""
_quoted = lambda j: lambda case: f"'{case[j]}'"
_VERDICT = f"SELECT event_id, user_id, {by_case(_quoted(2))} AS verdict FROM events"


@query("canonical_json", f"SELECT event_id, '{{\"arguments\":{{\"k\":' || (props->>'k') || '}},\"name\":\"' || event_type || '\"}}' AS canon FROM events")
def canonical_json_query(spark, d):
    return table(spark, d, "events").select("event_id", canonical_json(call_text()).alias("canon"))


@query("verify_generations", f"SELECT event_id, verdict FROM ({_VERDICT})")
def verify_generations(spark, d):
    """The verdict on each generation; refusals of a target are verdicts of their own, so no row stops the job."""
    return graded(spark, d).select("event_id", verdict("generation", "target").alias("verdict"))


@query("verdict_reason_counts", f"SELECT verdict, count(*) AS n FROM ({_VERDICT}) GROUP BY verdict")
def verdict_reason_counts(spark, d):
    return verify_generations(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("target_refusals", f"SELECT event_id, verdict AS refusal FROM ({_VERDICT}) WHERE verdict IN ('target_unreadable', 'parser_disagreement')")
def target_refusals(spark, d):
    """Targets that no verdict may rest on: an assertion that holds where this is empty."""
    return verify_generations(spark, d).where(F.col("verdict").isin(REFUSALS)).select("event_id", F.col("verdict").alias("refusal"))


_READINGS = {  # of the generations of CASES: kind, names, calls
    0: ("call", 1, 1), 1: ("call", 1, 1), 2: ("call", 1, 1), 3: ("unreadable", 0, 0), 4: ("unreadable", 0, 0), 5: ("no_call", 0, 0), 6: ("call", 1, 1), 7: ("unreadable", 0, 0), 8: ("call", 2, 2),
    9: ("unreadable", 0, 0), 10: ("call", 1, 1), 11: ("call", 1, 1), 12: ("call", 1, 1), 13: ("call", 1, 1), 14: ("call", 1, 1), 15: ("unreadable", 0, 0), 16: ("call", 1, 1), 17: ("call", 1, 0),
}
_reading = lambda j: f"CASE event_id % {len(CASES)} " + " ".join(f"WHEN {i} THEN {v[j]!r}" for i, v in _READINGS.items()) + " END"


@query("target_classification", f"SELECT event_id, {_reading(0)} AS kind, CAST({_reading(1)} AS INTEGER) AS n_names, CASE WHEN event_id % {len(CASES)} = 17 THEN 'unreadable' ELSE {_reading(0)} END AS own_kind, CAST({_reading(2)} AS INTEGER) AS n_calls FROM events")
def target_classification(spark, d):
    """Both readings of each form: kind and names, and kind and calls."""
    out = graded(spark, d).select("event_id", classify("generation").alias("t"), extract_calls("generation").alias("x"))
    return out.select("event_id", "t.kind", F.size("t.names").alias("n_names"), F.col("x.kind").alias("own_kind"), F.size("x.calls").alias("n_calls"))


_EXPECTED = "CASE WHEN user_id % 5 = 0 THEN 'accepted' WHEN user_id % 5 = 1 THEN 'wrong_args' ELSE verdict END"


@query(
    "self_test_tallies",
    f"WITH v AS (SELECT verdict, {_EXPECTED} AS expected FROM ({_VERDICT})), r AS (SELECT *, verdict IN ('target_unreadable', 'parser_disagreement') AS refused FROM v) SELECT count(*) AS total, count(*) FILTER (refused) AS refusals, "
    "count(*) FILTER (NOT refused AND verdict = expected) AS passed, count(*) FILTER (NOT refused AND verdict = 'accepted' AND expected <> 'accepted') AS misses, "
    "count(*) FILTER (NOT refused AND verdict <> 'accepted' AND expected = 'accepted') AS false_positives, count(*) FILTER (NOT refused AND verdict <> 'accepted' AND expected <> 'accepted' AND verdict <> expected) AS reason_mismatches FROM r",
)
def self_test_tallies(spark, d):
    """A verifier's test on labelled rows: faults it misses, right answers it rejects, wrong reasons, and targets it refuses."""
    rows = graded(spark, d).withColumn("verdict", verdict("generation", "target")).withColumn("expected", F.expr(_EXPECTED))
    refused, ok, want = F.col("verdict").isin(REFUSALS), F.col("verdict") == "accepted", F.col("expected") == "accepted"
    return rows.agg(
        F.count("*").alias("total"), F.count_if(refused).alias("refusals"), F.count_if(~refused & (F.col("verdict") == F.col("expected"))).alias("passed"), F.count_if(~refused & ok & ~want).alias("misses"),
        F.count_if(~refused & ~ok & want).alias("false_positives"), F.count_if(~refused & ~ok & ~want & (F.col("verdict") != F.col("expected"))).alias("reason_mismatches"),
    )
