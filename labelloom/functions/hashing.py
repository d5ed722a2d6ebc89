"""Repeatable pseudo-random values: pure functions of a seed and a row key.

Results do not depend on partitioning, on the number of executors or on task
retries, and any engine with ``md5`` can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_key(seed: int | str | Column, *keys: Column) -> Column:
    """32 hexadecimal digits, uniformly distributed, in random order of the keys."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]))


def random_integer(seed: int | str | Column, *keys: Column) -> Column:
    """Uniform integer in [0, 2^32)."""
    digits = F.substring(random_key(seed, *keys), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def random_index(size: Column, seed: int | str | Column, *keys: Column) -> Column:
    """Uniform position in 1..size."""
    return random_integer(seed, *keys) % size + 1


def content_key(*columns: Column) -> Column:
    """Fixed-size key of the columns' content; nulls and empty strings differ."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
