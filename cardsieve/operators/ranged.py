"""Deals rows to ranges of a binary key, packed column by column for the shuffle.

Spark shuffles row by row and packs by LZ4, which leaves digits and hashes as long as they are.
Each task gathers its rows here and packs those of one range as Parquet, so they take less
than half of that on the way.
"""

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Types that come back from Arrow and Parquet as they were.
_PLAIN = (BinaryType, BooleanType, DateType, NumericType, TimestampNTZType, TimestampType)

# Bytes of rows that a task gathers before it packs them.
_GATHERED = 96 << 20

# Keys drawn for each range to find where it ends.
_DRAWN = 100

_HEAD, _TAIL, _RANGE, _ROWS = "_head", "_tail", "_range", "_rows"


def is_plain(schema: StructType) -> bool:
    """Whether `deal_by_range` takes frames of these columns: none nested, no intervals."""
    return all(isinstance(f.dataType, _PLAIN) or f.dataType == StringType() for f in schema)


def _ends(df: DataFrame, head: Column, tail: Column, ranges: int) -> list[tuple[bytes, bytes]]:
    """The first keys of all ranges but the first, from a sample of the keys."""
    rows = df.count()
    drawn = df.where(F.rand(0) < _DRAWN * ranges / max(rows, 1)).select(head, tail)
    keys = sorted((bytes(row[0]), bytes(row[1])) for row in drawn.collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, compression="zstd", write_statistics=False)
    return sink.getvalue().to_pybytes()


def _cut(table: pa.Table, ends: Sequence[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """One row for each range that the rows fall in."""
    keys = zip(table[_HEAD].to_pylist(), table[_TAIL].to_pylist(), strict=True)
    found = np.array([bisect_right(ends, key) for key in keys], dtype=np.int32)
    order = np.argsort(found, kind="stable")
    table = table.drop_columns([_HEAD, _TAIL]).combine_chunks().take(pa.array(order))
    ranges, starts = np.unique(found[order], return_index=True)
    stops = [*starts[1:], len(found)]
    rows = [_packed(table.slice(a, b - a)) for a, b in zip(starts, stops, strict=True)]
    return pa.record_batch([pa.array(ranges, pa.int32()), pa.array(rows, pa.binary())], [_RANGE, _ROWS])


def deal_by_range(df: DataFrame, head: Column, tail: Column) -> DataFrame:
    """The same rows, dealt to partitions by ranges of the key, the least keys first.

    Rows of one partition have no order, so sort them in it. The key's two parts are binary and
    never null; the tail lets a range end among rows of one head, and is only computed for heads
    where one does. `df` is read for the count, for a sample, and twice for its rows.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = _ends(df, head, tail, ranges)
    tied = head.isin([bytearray(end) for end in {end[0] for end in ends}])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _GATHERED:
                yield _cut(pa.Table.from_batches(held), ends)
                held, size = [], 0
        if size:
            yield _cut(pa.Table.from_batches(held), ends)
        pa.default_memory_pool().release_unused()

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(_ROWS):
                file = pq.ParquetFile(pa.BufferReader(rows.as_buffer()))
                yield from file.read(use_threads=False).to_batches()

    # By place, as `mapInArrow` takes no name with a dot.
    names = [f"_{place}" for place in range(len(df.columns))]
    schema = df.toDF(*names).schema
    keyed = df.select("*", head.alias(_HEAD), F.when(tied, tail).otherwise(F.lit(b"")).alias(_TAIL))
    packed = keyed.toDF(*names, _HEAD, _TAIL).mapInArrow(pack, f"{_RANGE} INT, {_ROWS} BINARY")
    # More partitions than ranges, so that each range is one of its own.
    dealt = packed.repartitionByRange(4 * ranges, _RANGE).select(_ROWS)
    return dealt.mapInArrow(unpack, schema).toDF(*df.columns)
