"""A Bloom filter of a column's values as an expression: rows that cannot match are dropped before they move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per value, and the bounds of a filter; the largest one is 256 KB.
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 10, 1 << 10, 1 << 21


@dataclass
class Bloom:
    """Words of 64 bits; two bits stand for a value."""

    words: list[int]

    def may_contain(self, value: Column) -> Column:
        """False only for values that were not put in. Beyond its size a filter passes more, never less."""
        # One string literal instead of thousands; it is folded into an array once.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for at in _places(value, 64 * len(self.words)):
            found = found & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def build(df: DataFrame, column: str) -> Bloom:
    """A filter of the distinct values of a column; the driver gets its words only."""
    size = df.select(column).distinct().count()
    bits = LEAST_BITS
    while bits < min(size * BITS_PER_VALUE, MOST_BITS):
        bits *= 2
    places = df.select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    word = F.floor(F.col("at") / 64).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")
    found = places.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words = [0] * (bits // 64)
    for row in found:
        words[row["word"]] = row["bits"]
    return Bloom(words)
