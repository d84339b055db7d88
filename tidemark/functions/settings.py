"""Settings as columns: values that older versions stored become ones that are valid now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STRATEGIES, DELETION_LIMIT = ("auto_merge", "duplicate"), 20


def conflict_strategy(value: Column) -> Column:
    """The removed interactive strategy did what ``duplicate`` does; all else that is unknown is the default."""
    return F.when(value.isin(*STRATEGIES), value).when(value == "ask", "duplicate").otherwise("auto_merge")


def deletion_limit(value: Column) -> Column:
    """Zero meant no limit by mistake, and becomes the default; -1 is no limit."""
    return F.when(value == 0, F.lit(DELETION_LIMIT)).otherwise(value)


def with_default_patterns(patterns: Column, defaults: Sequence[str]) -> Column:
    """The patterns and, after them, the defaults that are neither there nor negated there."""
    wanted = [F.when(~F.array_contains(patterns, d) & ~F.array_contains(patterns, f"!{d}"), F.lit(d)) for d in dict.fromkeys(defaults)]
    return F.concat(patterns, F.array_compact(F.array(*wanted)))
