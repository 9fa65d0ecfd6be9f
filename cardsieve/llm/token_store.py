"""Token ids in files: ids ranked by frequency, in a byte-aligned variable-length code.

The most frequent id gets number 0, and so on. A number takes one to four bytes; how many
stands in a separate control stream, two bits each, four to a control byte; a document
begins a new control byte. Decoding looks up the lengths of each control byte in a table and
puts the bytes in place by numpy.

A store is a folder with two Parquet tables, so that Spark commits and reads its files in
any file system: `ranks` (rank, id, n) and `blocks`, one row for a run of documents (part,
block, tokens_before, doc_ids, sizes, control, data). The files of `blocks`, by name, and the
rows in each are in ascending doc_id order.
"""

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsieve.llm.common import by_value, input_parts, keep, releasing, text_slices
from cardsieve.llm.tokens import encoder

by_value(__name__)

BLOCK_TOKENS = 262_144
# Text that is tokenized at one time; this bounds memory only.
ENCODE_BYTES = 8_000_000
_LENGTHS = np.array(
    [codes[::-1] for codes in product((1, 2, 3, 4), repeat=4)], np.uint8
)  # of the four numbers of each control byte, lowest bits first


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    lengths = 1 + (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[: len(numbers)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) < lengths[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_numbers(control: bytes, data: bytes, sizes) -> np.ndarray:
    """The numbers of runs that were encoded one by one, from their streams put together."""
    sizes = np.atleast_1d(np.asarray(sizes, np.int64))
    padded = -(-sizes // 4) * 4
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    # Places behind the last number of a run only fill its control byte.
    place = np.arange(len(lengths)) - np.repeat(np.cumsum(padded) - padded, padded)
    lengths = lengths[place < np.repeat(sizes, padded)]
    out = np.zeros((len(lengths), 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tie, n, ids) of each row, ids as plain numbers of two or four bytes."""

    @releasing
    def work(batches):
        for batch in batches:
            place = 0
            for some in text_slices(batch["text"], ENCODE_BYTES):
                found = encoder(vocabulary).encode_all(some)
                small = [ids.astype("<u2" if ids.max() < 65_536 else "<u4").tobytes() for ids in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(place, len(some)),
                        batch["tie"].slice(place, len(some)),
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array(small, pa.binary()),
                    ],
                    ["doc_id", "tie", "n", "ids"],
                )
                place += len(some)

    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
        "text",
    )
    return own.mapInArrow(work, "doc_id long, tie long, n long, ids binary")


def _plain_ids(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2")


def count_ids(documents: DataFrame) -> DataFrame:
    """(id, n) over all documents; counted inside each task first."""

    @releasing
    def work(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            held = [_plain_ids(*row) for row in zip(batch["ids"].to_pylist(), batch["n"].to_pylist())]
            found = np.bincount(np.concatenate(held)) if held else total[:0]
            if len(found) > len(total):
                found, total = total, found
            total = total.copy()
            total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"]
        )

    return documents.select("ids", "n").mapInArrow(work, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")
    )


_BLOCK_SCHEMA = (
    "part int, block int, tokens_before long, doc_ids array<long>, sizes array<long>,"
    " control binary, data binary"
)


def _blocks(batches):
    """Rows of coded documents, in order, as blocks of about BLOCK_TOKENS tokens."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    block, before, held = 0, 0, []

    def row():
        doc_ids, sizes, control, data = zip(*held)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        cells = [part, block, before, doc_ids, sizes, b"".join(control), b"".join(data)]
        names = ["part", "block", "tokens_before", "doc_ids", "sizes", "control", "data"]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names), sum(sizes)

    waiting = 0
    for batch in batches:
        for document in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "control", "data"))):
            held.append(document)
            waiting += document[1]
            if waiting >= BLOCK_TOKENS:
                out, n = row()
                yield out
                block, before, held, waiting = block + 1, before + n, [], 0
    if held:
        yield row()[0]


def write_tokens(docs: DataFrame, path: str, vocabulary: str) -> str:
    """Tokenize (doc_id, text) and write a store to `path`.

    Null texts are empty ones and hold the end id alone; rows that repeat a doc_id stay,
    ordered by a hash of their text; null doc_ids come first. Other columns are left out. An
    empty table gives a store without blocks. Texts are tokenized where they are read; only
    coded ids are shuffled, and rows of one doc_id may go to several tasks.
    """
    documents = keep(encode_documents(docs, vocabulary), "ids")
    # At most one row for each id of the vocabulary.
    counts = count_ids(documents).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ids = counts["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    counts = counts.assign(rank=range(len(ids)))[["rank", "id", "n"]]
    spark = docs.sparkSession
    spark.createDataFrame(counts, "rank long, id long, n long").coalesce(1).write.parquet(
        f"{path}/ranks"
    )

    def code(batches):
        for batch in batches:
            rows = zip(batch["ids"].to_pylist(), batch["n"].to_pylist())
            coded = [encode_numbers(rank_of[_plain_ids(*row)]) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("doc_id", "tie", "n")),
                    pa.array([c for c, _ in coded], pa.binary()),
                    pa.array([d for _, d in coded], pa.binary()),
                ],
                names=["doc_id", "tie", "n", "control", "data"],
            )

    coded = documents.mapInArrow(code, "doc_id long, tie long, n long, control binary, data binary")
    # The tasks' ranges follow each other, and so do the names of the files they write.
    coded.repartitionByRange(input_parts(spark), "doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie"
    ).mapInArrow(_blocks, _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store; ids as little-endian 32-bit numbers.

    `start` counts the ids of all documents before: inside a part it is in the file, and
    each part, of which there are as many as shuffle partitions, adds the sizes of those
    before it.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()
    id_of = ranks["id"].to_numpy(np.uint32)
    sizes = blocks.groupBy("part").agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")
    )
    offsets = sizes.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS part_start")

    @releasing
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                ends = np.cumsum(sizes)
                ids = id_of[decode_numbers(row["control"], row["data"], sizes)].astype("<u4")
                raw, bounds = ids.tobytes(), 4 * np.append(0, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["part_start"] + row["tokens_before"] + ends - sizes),
                        pa.array(sizes, pa.int64()),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]
                        ).cast(pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(F.broadcast(offsets), "part").mapInArrow(
        work, "doc_id long, start long, n_tokens long, ids binary"
    )
