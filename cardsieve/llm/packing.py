"""Harmonic packing of token sequences.

A sequence of capacity C holds k documents of a class whose lengths lie just below C / k.
Every class fills its own sequences with its fixed number of pieces, so tasks pack their own
documents without hearing of others. Whole sequences are cut off long documents first. A
rest that would waste more than `slack` of its share is cut to the next smaller class and
its remainder goes on. Sequences that a task cannot fill are cut into lengths that are
powers of two, which need no padding.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import by_value, releasing, text_slices
from cardsieve.llm.tokens import encoder

by_value(__name__)

CAPACITY = 1024
ENCODE_BYTES = 8_000_000
# A task numbers its sequences from its own place on: 2 to the power of this many apart.
TASK_BITS = 36


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = 0.03, least: int = 24):
    """Lengths of the pieces of n tokens, and how many of each fill a sequence."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        share = capacity // rest
        whole = capacity // share
        if rest >= (1 - slack) * whole or rest <= least:
            pieces.append((rest, share))
            break
        share += 1
        pieces.append((capacity // share, share))
        rest -= capacity // share
    return pieces


class Bins:
    """The open sequences of one task, one for each class."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.next = first
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int, share: int):
        """Put a piece into its class; gives (sequence, offset, piece, begin, length) rows."""
        held = self.open.setdefault(share, [])
        held.append((piece, length))
        if len(held) == share:
            yield from self._close(self.open.pop(share))

    def _close(self, held):
        offset = 0
        for piece, length in held:
            yield self.next, offset, piece, 0, length
            offset += length
        self.next += 1

    def rest(self):
        """Cut what is left of each class at powers of two."""
        for share in sorted(self.open):
            left = sum(length for _, length in self.open[share])
            pieces = [(piece, 0, length) for piece, length in self.open[share]]
            while left:
                room = min(self.capacity, 1 << (left.bit_length() - 1))
                left -= room
                offset = 0
                while offset < room:
                    piece, begin, length = pieces.pop(0)
                    used = min(length, room - offset)
                    yield self.next, offset, piece, begin, used
                    offset += used
                    if used < length:
                        pieces.insert(0, (piece, begin + used, length - used))
                self.next += 1
        self.open = {}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Null texts are empty and hold the end id alone; rows that repeat a doc_id are packed
    each for itself; a null doc_id stays null; other columns are left out. An empty table
    gives an empty result. No row is moved: a task's sequences hold its own documents.
    """

    @releasing
    def work(batches):
        from pyspark import TaskContext

        bins = Bins(TaskContext.get().partitionId() << TASK_BITS, capacity)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3

        def rows(placed):
            out = []
            for sequence, offset, (name, start, ids, total), begin, length in placed:
                some = ids[begin : begin + length].tobytes()
                out.append((name, start + begin, length, some, total, sequence, offset))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names
            )

        for batch in batches:
            place = 0
            doc_ids = batch["doc_id"].to_pylist()
            for some in text_slices(batch["text"], ENCODE_BYTES):
                placed = []
                for ids in encoder(vocabulary).encode_all(some):
                    start = 0
                    for length, share in cut_lengths(len(ids), capacity):
                        piece = (doc_ids[place], start, ids[start : start + length], len(ids))
                        placed.extend(bins.add(piece, length, share))
                        start += length
                    place += 1
                if placed:
                    yield rows(placed)
        placed = list(bins.rest())
        if placed:
            yield rows(placed)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work,
        "doc_id long, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long",
    )


def piece_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
