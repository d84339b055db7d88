"""What ``__spark_entry__`` registers from this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracles
from tidemark.llm.contamination import op8_benchmark_decontamination
from tidemark.llm.fingerprints import op12_fingerprints
from tidemark.llm.jaccard import op6_ngram_jaccard_join
from tidemark.llm.licenses import op3_license_scans
from tidemark.llm.negatives import op13_hard_negatives
from tidemark.llm.packing import op10_packing
from tidemark.llm.phrases import op11_collocations
from tidemark.llm.pii import op9_pii
from tidemark.llm.quality import op7_quality_rules
from tidemark.llm.sharding import op5_sharding
from tidemark.llm.substrings import op2_substring_dedup
from tidemark.llm.token_counts import op4_token_counts
from tidemark.llm.token_files import op1_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_substring_dedup, op3_license_scans, op4_token_counts, op5_sharding, op6_ngram_jaccard_join, op7_quality_rules, op8_benchmark_decontamination, op9_pii, op10_packing, op11_collocations, op12_fingerprints, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
