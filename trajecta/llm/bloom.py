"""A blocked Bloom filter as a table, built and probed with DataFrame functions alone.

A key's hash names one block of four 64-bit words and a bit in each. The number of blocks is bounded by a parameter, so
the filter can be broadcast whatever the number of keys: more keys only let more false positives through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BLOCK_BYTES = 4, 32
MAX_BYTES = 1 << 20


def blocks_for(n_keys: int, bits_per_key: int = 16, max_bytes: int = MAX_BYTES) -> int:
    return max(1, min(-(-n_keys * bits_per_key // (8 * BLOCK_BYTES)), max_bytes // BLOCK_BYTES))


def block_and_masks(keys: list[Column], n_blocks: int) -> list[Column]:
    """__block and __m0 to __m3, the bit of each word."""
    h = F.xxhash64(*keys, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return [F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).alias("__block"), *[m.alias(f"__m{i}") for i, m in enumerate(masks)]]


def bloom_table(keys: DataFrame, columns: list[str], n_blocks: int) -> DataFrame:
    """One row for each block in use: its words __w0 to __w3. At most n_blocks rows."""
    masked = keys.select(*block_and_masks([F.col(c) for c in columns], n_blocks))
    return masked.groupBy("__block").agg(*[F.bit_or(f"__m{i}").alias(f"__w{i}") for i in range(WORDS)])


HIT = " and ".join(f"(__w{i} & __m{i}) = __m{i}" for i in range(WORDS))


def with_hit(df: DataFrame, columns: list[str], keys: DataFrame, n_keys: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with __hit: false where its columns are surely not among keys (columns of the same names)."""
    n = blocks_for(n_keys, max_bytes=max_bytes)
    masks = block_and_masks([F.col(c) for c in columns], n)
    probed = df.select("*", *masks).join(F.broadcast(bloom_table(keys, columns, n)), "__block", "left")
    return probed.select(*df.columns, F.coalesce(F.expr(HIT), F.lit(False)).alias("__hit"))
