"""Bit tables of fixed size that tell which hashes are surely not in a set: one for numpy in
tasks, and one that stays inside Spark's own plans."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import by_value

by_value(__name__)

# Bits of one row of Spark's bitmap functions.
_BUCKET = 1 << 15

# Rows of a table inside a plan; each is one 64-bit word.
_WORDS_BITS = 18


def with_flag(df: DataFrame, key: Column, taken: DataFrame, name: str) -> DataFrame:
    """Adds a column that is false where the 64-bit key is surely none of `taken`'s `key`.

    What is broadcast has at most 2 ** 18 rows of 16 bytes, at any input size; a fuller table
    says true more often, never less. A null key is none of them.
    """
    word = F.pmod("key", F.lit(1 << _WORDS_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(shiftright(key, {_WORDS_BITS}), 64) AS INT))")
    bits = taken.where("key IS NOT NULL").groupBy(word.alias("_word")).agg(
        F.bit_or(bit).alias("_bits")
    )
    own = df.withColumn("_key", key)
    at = F.pmod("_key", F.lit(1 << _WORDS_BITS))
    own_bit = F.expr(f"shiftleft(1L, CAST(pmod(shiftright(_key, {_WORDS_BITS}), 64) AS INT))")
    return (
        own.withColumn("_word", at)
        .join(F.broadcast(bits), "_word", "left")
        .withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(own_bit) != 0, F.lit(False)))
        .drop("_key", "_word", "_bits")
    )


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each 64-bit hash; `bits` is a power of two up to 2 ** 32."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


def collect_bits(taken: DataFrame, bits: int) -> np.ndarray:
    """The table with the bits at `place` set, eight to a byte. Tasks combine their bits
    first; the driver gets bits / 32768 rows of 4 KB at most, however many rows there are."""
    # Spark counts places from one.
    found = taken.groupBy((F.bitmap_bucket_number(F.col("place") + 1) - 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bitmap")
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in found.toPandas().itertuples(index=False):
        row = np.frombuffer(bitmap, np.uint8)[: bits // 8]
        out[bucket * (_BUCKET // 8) :][: len(row)] = row
    return out


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where the hash is surely not in the set."""
    one, two = places(hashes, 8 * len(table))
    found = (table[one >> 3] >> (one & 7)) & 1
    found &= (table[two >> 3] >> (two & 7)) & 1
    return found.astype(bool)
