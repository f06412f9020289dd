"""Sources and sinks: Parquet tables, JSON lines in a strict and a tolerant regime, segment chains, pinned payloads, runs that are bound once."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a schema. strict: a malformed line is an error; else it is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def readable(read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """What read gives, or an empty table where the source isn't there."""
    try:
        return read()
    except AnalysisException:
        return SparkSession.getActiveSession().createDataFrame([], schema)


@F.pandas_udf(T.BooleanType())
def is_object(line: pd.Series) -> pd.Series:
    """Whether a line is one JSON object and nothing else; the built-in parsers accept text after it."""

    def strict(text: str | None) -> bool:
        try:
            return isinstance(json.loads(text or ""), dict)
        except (ValueError, RecursionError):
            return False

    return line.map(strict).astype(bool)


def torn_tail(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines that aren't one JSON object, with whether that is allowed: only the last one may be torn. Blank lines don't count."""
    last = lines.agg(F.max(order).alias("_last"))
    bad = lines.where((F.trim(text) != "") & ~is_object(text))
    return bad.join(F.broadcast(last)).select(order, text, (F.col(order) == F.col("_last")).alias("allowed"))  # one row


def segment_chain(segments: DataFrame) -> DataFrame:
    """Breaks in a chain of segments (idx, sha, prev_sha): a gap in the index or a predecessor's digest that doesn't fit."""
    w = Window.orderBy("idx")
    seen = segments.select("idx", "prev_sha", F.lag("idx").over(w).alias("before"), F.lag("sha").over(w).alias("want"))
    return seen.where("before is not null and (idx <> before + 1 or not (prev_sha <=> want))").select("idx", "before")


def pinned(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and git blob id of files."""
    files = spark.read.format("binaryFile").load(path)
    blob = F.concat(F.lit("blob ").cast("binary"), F.col("length").cast("string").cast("binary"), F.unhex(F.lit("00")), F.col("content"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.sha1(blob).alias("blob"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replaced as a whole by the commit protocol: readers see the old rows or the new."""
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def bind_run(fields: DataFrame, path: str) -> DataFrame:
    """Binds a run to its fields (field, value: texts): the first call writes them, later ones give the fields that differ. Empty where the run is the same."""
    try:
        fields.select("field", "value").write.mode("errorifexists").json(path)
    except AnalysisException as e:
        if "ALREADY_EXISTS" not in str(e.getCondition()):
            raise
    kept = fields.sparkSession.read.schema("field string, value string").json(path)
    both = kept.select("field", F.col("value").alias("have")).join(fields.select("field", F.col("value").alias("want")), "field", "full")
    return both.where("not (have <=> want)")
