"""Content fingerprints."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import batches

#: Bytes of a block of the block hash.
BLOCK = 4 * 1024 * 1024
_WIDTH, _SHIFT = 160, 11


def block_hash(content: Column) -> Column:
    """sha256 over the raw sha256 of each 4 MiB block; that of nothing for empty content."""
    blocks = F.sequence(F.lit(0), F.ceil(F.octet_length(content) / BLOCK).cast("int") - 1)
    raw = F.transform(blocks, lambda i: F.sha2(F.substring(content, i * BLOCK + 1, F.lit(BLOCK)), 256))
    return F.when(F.octet_length(content) == 0, F.sha2(content, 256)).otherwise(F.sha2(F.unhex(F.array_join(raw, "")), 256))


def quickxor_bytes(data: bytes) -> str:
    """A 160-bit ring: byte i is xored in at bit 11 i, the length into the last 8 bytes. Base64."""
    n = len(data)
    ring = 0
    if n:
        # bytes that are 160 apart stand at the same bit, so they can be xored first
        folded = np.bitwise_xor.reduce(np.frombuffer(data + b"\0" * (-n % _WIDTH), np.uint8).reshape(-1, _WIDTH), axis=0)
        for i in np.flatnonzero(folded):
            value = int(folded[i]) << (int(i) * _SHIFT % _WIDTH)
            ring ^= (value & ((1 << _WIDTH) - 1)) | (value >> _WIDTH)
    ring ^= n << (_WIDTH - 64)
    return base64.b64encode(ring.to_bytes(_WIDTH // 8, "little")).decode()


def quickxor(content: Column) -> Column:
    batches.bound()
    return _quickxor(content)


@F.pandas_udf(T.StringType())
def _quickxor(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else quickxor_bytes(bytes(c)))


def digest(content: Column, algo: Column) -> Column:
    """By algorithm; an opaque one has none. Every branch but the one in Python is built in."""
    plain = F.when(algo == "md5", F.md5(content)).when(algo == "sha1", F.sha1(content)).when(algo == "sha256", F.sha2(content, 256)).when(algo == "dropbox", block_hash(content))
    return F.when(algo == "quickxor", quickxor(F.when(algo == "quickxor", content))).otherwise(plain)


def is_computable(algo: Column) -> Column:
    return algo != "opaque"
