"""Tool lists in system prompts: how many tools a prompt offers, its stratum, the offered names, and names called without being offered."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OFFER = T.StructType([T.StructField("n_tools", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType()))])
# What announces a tool list.
MARKER, TAG, END = "Tools:", "<tools>", "</tools>"


def value_at(text: str) -> tuple[object, str]:
    """The JSON value at the start of text and what follows it, both without space around; (None, text) where there is none."""
    t = text.strip()
    try:
        value, end = json.JSONDecoder().raw_decode(t)
    except (ValueError, RecursionError):
        return None, t
    return value, t[end:].strip()


def tool_lists(prompt: str | None) -> list[list]:
    """The lists of a prompt: one that fills all that follows the first marker, and one that fills a tag's content."""
    text = prompt or ""
    _, *after = text.split(MARKER, 1)
    read = [(value, rest == "") for value, rest in map(value_at, after)]
    read += [(value, rest.startswith(END)) for value, rest in map(value_at, text.split(TAG)[1:])]
    return [value for value, whole in read if whole and isinstance(value, list)]


def _name(tool) -> str | None:
    """A tool's own name, or that of the function in it."""
    levels = [tool, tool.get("function")] if isinstance(tool, dict) else []
    first = next((n for n in (x.get("name") for x in levels if isinstance(x, dict)) if n), None)
    return first if isinstance(first, str) else None


@F.pandas_udf(OFFER)
def offer(prompt: pd.Series) -> pd.DataFrame:
    """Of the longest list (the first of equals): its length, null where no list parses, and its names."""
    longest = [max(tool_lists(p), key=len, default=None) for p in prompt]
    names = [sorted({n for t in x or [] if (n := _name(t)) is not None}) for x in longest]
    return pd.DataFrame({"n_tools": pd.array([None if x is None else len(x) for x in longest], "Int32"), "names": names})


def stratum(n_tools: Column) -> Column:
    return F.when(n_tools >= 2, "multi").when(n_tools == 1, "single").otherwise("ineligible")


def ineligible_because(n_tools: Column) -> Column:
    return F.when(n_tools.isNull(), "no_tool_list").when(n_tools < 1, "zero_tools")


def pool(spark: SparkSession, d: str) -> DataFrame:
    """event_id, source, called, prompt: prompts of both formats, with an empty, a torn, a missing and a second list."""
    text = F.expr(r"""CASE event_id % 6
      WHEN 0 THEN concat('You can call tools.\nTools:\n[{"name": "lookup"}, {"name": "', event_type, '"}]')
      WHEN 1 THEN concat('Tools stand in <tools></tools>.\n<tools>\n[{"type": "function", "function": {"name": "', event_type, '"}}]\n</tools>')
      WHEN 2 THEN 'No list here.'
      WHEN 3 THEN 'Tools:\n[]'
      WHEN 4 THEN 'Tools:\n[{"name": "lookup"},'
      ELSE concat('<tools>[{"name": "lookup"}]</tools>, then <tools>[{"name": "lookup"}, {"name": 7}, {"name": "', event_type, '"}]</tools>') END""")
    called = F.when(F.col("event_id") % 12 == 0, "unheard_of").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("long").alias("source"), called.alias("called"), text.alias("prompt"))


_POOL = """SELECT event_id, CAST(user_id % 3 AS BIGINT) AS source, CASE WHEN event_id % 12 = 0 THEN 'unheard_of' ELSE event_type END AS called,
  CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 0 WHEN 5 THEN 3 END AS n_tools,
  CASE event_id % 6 WHEN 0 THEN [event_type, 'lookup'] WHEN 1 THEN [event_type] WHEN 5 THEN [event_type, 'lookup'] ELSE [] END AS names FROM events"""
_STRATUM = f"SELECT *, CASE WHEN n_tools >= 2 THEN 'multi' WHEN n_tools = 1 THEN 'single' ELSE 'ineligible' END AS stratum, CASE WHEN n_tools IS NULL THEN 'no_tool_list' WHEN n_tools < 1 THEN 'zero_tools' END AS reason FROM ({_POOL})"


def offered(spark: SparkSession, d: str) -> DataFrame:
    read = pool(spark, d).withColumn("o", offer("prompt")).select("event_id", "source", "called", "o.n_tools", "o.names")
    return read.withColumns({"stratum": stratum(F.col("n_tools")), "reason": ineligible_because(F.col("n_tools"))})


@query("prompt_stratum", f"SELECT event_id, n_tools, stratum, reason FROM ({_STRATUM})")
def prompt_stratum(spark, d):
    return offered(spark, d).select("event_id", "n_tools", "stratum", "reason")


@query("stratum_composition", f"SELECT source, count(*) FILTER (stratum = 'multi') AS multi, count(*) FILTER (stratum = 'single') AS single, count(*) FILTER (stratum = 'ineligible') AS ineligible, round(count(*) FILTER (stratum = 'multi') / nullif(count(*) FILTER (stratum <> 'ineligible'), 0), 6) AS multi_share FROM ({_STRATUM}) GROUP BY source")
def stratum_composition(spark, d):
    """Counts by source; the share of multi among the eligible is null where there are none."""
    of = lambda s: F.count_if(F.col("stratum") == s).alias(s)
    n = offered(spark, d).groupBy("source").agg(of("multi"), of("single"), of("ineligible"))
    return n.withColumn("multi_share", F.round(F.try_divide(F.col("multi"), F.col("multi") + F.col("single")), 6))


@query("tool_presented_names", f"SELECT event_id, array_to_string(list_sort(names), ',') AS names FROM ({_POOL})")
def tool_presented_names(spark, d):
    return offered(spark, d).select("event_id", F.array_join(F.array_sort("names"), ",").alias("names"))


@query("name_defects", f"SELECT event_id, called FROM ({_STRATUM}) WHERE stratum <> 'ineligible' AND NOT list_contains(names, called)")
def name_defects(spark, d):
    """Eligible rows whose target calls a name that the prompt doesn't offer: none may be there."""
    rows = offered(spark, d).where("stratum <> 'ineligible'")
    return rows.where(F.size(F.array_except(F.array("called"), "names")) > 0).select("event_id", "called")
