"""Tells copies of rows apart, and writes rows out as often as a count says."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 100_000

# Eight bits for each key, but at most 64 MB for each mark: beyond that more keys share a bit.
_BITS_PER_KEY = 8
_MOST_BITS = 1 << 29

# Bits that `bitmap_construct_agg` packs into one value.
_MAP_BITS = 1 << 15

# Rows as text without loss, so that only whole-row copies are alike: JSON would cut
# timestamps to milliseconds and leave nulls out.
_LOSSLESS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def content_key(columns: list[str]) -> Column:
    """A hash that only whole-row copies share. Takes any type, maps too, and tells 0.0
    from -0.0."""
    return content_hash([F.col(f"`{c.replace('`', '``')}`") for c in columns])


def content_hash(columns: list[Column]) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns), _LOSSLESS)))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place % 8) == 1


def key_marks(
    keys: DataFrame, key: str, marks: dict[str, Column]
) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the marks of a row's key to it, by small bit maps.

    A mark that the key has is always true; one that it lacks is false unless another key
    with the same bit has it. Frames are not shuffled for it. `keys` holds each key once and
    is read twice; rows whose key it lacks may be dropped.
    """
    wanted = (keys.count() * _BITS_PER_KEY).bit_length()
    bits = min(max(1 << wanted, _MAP_BITS), _MOST_BITS)
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    number, bit = F.shiftright(place, 15).cast("int"), place.bitwiseAND(_MAP_BITS - 1).cast("int")
    maps = keys.groupBy(number.alias("_map")).agg(
        *[F.bitmap_construct_agg(F.when(has, bit.cast("long"))).alias(mark) for mark, has in marks.items()]
    )

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(maps), number == F.col("_map")).select(
            *df.columns, *[_bit(F.col(mark), bit).alias(mark) for mark in marks]
        )

    return marked


def repeat_rows(df: DataFrame, count: str) -> DataFrame:
    """Each row `count` times, and without that column.

    Chunks of a row that is wanted very often are dealt to several tasks first; all other
    rows stay where they are.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c != count]
    few = df.where(F.col(count) <= _CHUNK)
    chunks = (
        df.where(F.col(count) > _CHUNK)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(`{count}` - 1) div {_CHUNK}"))))
        .withColumn(count, F.least(F.lit(_CHUNK), F.col(count) - F.col("_chunk") * _CHUNK))
    )
    spread = chunks.repartition("_chunk").drop("_chunk")
    return (
        few.unionByName(spread)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
        .select(*columns)
    )
