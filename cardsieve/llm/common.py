"""What several operators share: word hashing, blocks of rows inside tasks, stored steps."""

import string
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsieve.scratch import scratch_path

# White space of the contracts: space and \x09-\x0D, which is also what bytes.split() cuts at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Text that is split into words at one time; this bounds memory only.
SLICE_BYTES = 8_000_000


def by_value(module: str) -> None:
    """Ship the module's functions with each task, so executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a step to the shared folder and read it back, so lost executors cost nothing.

    With `release` Spark deletes the step's shuffle files as soon as it is written, not at
    some later collection of the driver's memory.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    if release:
        conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            conf.unset(_RELEASE) if before is None else conf.set(_RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_memory(name: str, make: Callable[[], object]) -> object:
    """Something a Python worker keeps between tasks, such as a loaded vocabulary."""
    held = vars(sys).setdefault("_cardsieve_worker", {})
    if name not in held:
        held[name] = make()
    return held[name]


def releasing(work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task's work that gives Arrow's unused memory back at its end; Python workers live on
    beside later steps and would keep it."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_TO_SPACE_LOWER = bytes.maketrans(
    b"\t\n\x0b\x0c\r" + _UPPER.encode(), b"     " + _UPPER.lower().encode()
)
_MARKS = string.punctuation.encode()
_TO_SPACE_BARE = bytes.maketrans(
    b"\t\n\x0b\x0c\r" + _MARKS + _UPPER.encode(),
    b" " * (5 + len(_MARKS)) + _UPPER.lower().encode(),
)


def text_slices(column: pa.Array, most_bytes: int) -> Iterator[pa.LargeStringArray]:
    """Runs of whole texts of about `most_bytes`, nulls as empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield column[start:end]
        start = end


def split_words(
    column: pa.LargeStringArray, lower: bool, bare: bool = False
) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts, as one dictionary array, and where each text's words begin.
    `bare` words are lower-cased and cut at ASCII punctuation too.

    The white space of the contracts becomes plain spaces byte by byte, which UTF-8 allows,
    and so does lower-casing of A-Z; then Arrow cuts at spaces.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
    raw = raw.translate(_TO_SPACE_BARE if bare else _TO_SPACE_LOWER if lower else _TO_SPACE)
    plain = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(column),
        [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw)],
    )
    lists = pc.split_pattern(plain.cast(pa.large_string(), safe=False), " ")
    found = lists.flatten()
    full = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    starts = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return found.filter(pa.array(full)).dictionary_encode(), starts


def dictionary_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of each word; each different word is hashed once."""
    different = words.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
    return hashes[words.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in place order; fewer words make one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return out


def sorted_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Groups of rows that share the keys, from a partition that is sorted by them.

    A group is put together across batches; the caller sees to it that groups are small.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        change = np.zeros(rows.num_rows, bool)
        for key in keys:
            values = rows[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
            if held:
                change[0] |= values[0] != held[-1][key][-1].as_py()
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(rows)
            continue
        if cuts[0] > 0:
            held.append(rows.slice(0, cuts[0]))
        if held:
            yield pa.concat_tables(held)
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield rows.slice(start, end - start)
        held = [rows.slice(cuts[-1])]
    if held:
        yield pa.concat_tables(held)


def with_dense_index(df: DataFrame, order: list[str], index: str, parts: int) -> DataFrame:
    """Number all rows from 0 in the given order, without one task that sees all of them.

    Rows are dealt by range and sorted inside each part; the sizes of the parts, one number
    each, give the offset of the next. The dealt rows are stored first, so the numbers stay
    the same when a task runs again.
    """
    dealt = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"))
        .select("*", F.monotonically_increasing_id().alias("_place"))
    )
    dealt = keep(dealt, "dealt")
    sizes = dealt.groupBy("_part").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first")
    )
    offsets = sizes.selectExpr(
        "_part", "_first", "sum(_n) OVER (ORDER BY _part) - _n AS _offset"
    )
    return (
        dealt.join(F.broadcast(offsets), "_part")
        .withColumn(index, F.col("_place") - F.col("_first") + F.col("_offset"))
        .drop("_part", "_place", "_first", "_offset")
    )


def input_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
