"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of a local application that names no shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names for checkpoints; a local session without one gets a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[context.applicationId] = root
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back, so that they are computed once and survive lost executors."""
    path = shared_folder(rows.sparkSession, "cut")
    rows.write.parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    _CUT.add(written)
    return written


#: Rows that ``cut`` has given.
_CUT: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` if ``cut`` has given them, else ``rows`` cut: for what is read many times and may have been written before."""
    return rows if rows in _CUT else cut(rows)


def many(rows: DataFrame) -> DataFrame:
    """Rows that grow with the input, for a join: always shuffled, so none are sent through the driver, where a chain of joins adds up."""
    return rows.hint("merge")


#: Rows of a few values that are broadcast at most.
MOST_ROWS = 200_000


def few(rows: DataFrame) -> DataFrame:
    """Rows of a few values, written before: broadcast while there are at most ``MOST_ROWS``; with more, Spark joins them as it likes."""
    return F.broadcast(rows) if rows.count() <= MOST_ROWS else rows
