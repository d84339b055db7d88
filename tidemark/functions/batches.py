"""Batches of whole texts that Spark hands to Python at once."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Rows and bytes of a batch. Spark's default of 10,000 rows has no useful bound in bytes where rows are whole texts.
ROWS, BYTES = 512, 4 << 20
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}


def bound() -> None:
    """Lower both in the session that is active, unless it already asks for less."""
    spark = SparkSession.active()
    for name, most in (("Records", ROWS), ("Bytes", BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = re.fullmatch(r"([0-9]+)([bkmg]?)b?", spark.conf.get(key).lower())
        if not now or not 0 < int(now[1]) << _UNITS[now[2]] <= most:
            spark.conf.set(key, str(most))
