"""Reading tables, and cutting lineage through tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: it is larger than any real id.
NO_ID = (1 << 63) - 1

#: Seconds that writing a table takes at least before what it shuffled is let go: collecting the plans takes a while, and small tables shuffle little.
WRITTEN_S = 1.0
#: Of each open scratch(), the folders of the tables that were stored in it.
_SCRATCH: list[dict[str, str]] = []


def ship(module: str) -> None:
    """Functions of this module travel to the executors by value, so these need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_id(column: str | Column = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One is set only where none is: beside the warehouse on a cluster, a temporary one in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        where = tempfile.mkdtemp(prefix="quarrystone-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to a table in the shared folder and read back: what follows survives lost executors without running df again.

    What df shuffled is let go if there was much to write (WRITTEN_S): Spark deletes shuffle files once the driver has
    collected the plans that wrote them, which may take half an hour by itself.
    """
    spark, schema, began = df.sparkSession, df.schema, time.monotonic()
    folder = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{folder}"
    if _SCRATCH:
        _SCRATCH[-1][folder] = path
    df.write.parquet(path)
    del df
    if time.monotonic() - began > WRITTEN_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that are stored in the block are deleted at its end, but for those that are read by a DataFrame given to
    the function that the block gets. These stay, or go with the block around it. Other results of the block can't be read after it.
    """
    here: dict[str, str] = {}
    stay: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        stay.update(f.rsplit("/", 2)[-2] for f in df.inputFiles())
        return df

    _SCRATCH.append(here)
    try:
        yield keep
    except BaseException:
        stay.clear()
        raise
    finally:
        _SCRATCH.pop()
        for folder, path in here.items():
            if folder not in stay:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            elif _SCRATCH:
                _SCRATCH[-1][folder] = path


def parts(spark: SparkSession, least: int = 32) -> int:
    """How many parts to deal rows to: it follows the session's shuffle setting, and results never depend on it."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
