"""Lines that many documents share, found by two Bloom filters and confirmed exactly.

A first pass puts every line's hash into bit sets: those seen once, and those seen in a
second document. Tasks send the bits they set, block by block, and the blocks are merged: a
bit that two of them set is a bit of the second filter. Only the second filter is broadcast.
A second pass sends on the lines whose bits all stand in it, so that most lines, which no
other document has, are never shuffled. Their documents are counted by 128-bit hashes.
A last pass writes the texts without the lines that were confirmed.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import by_value, input_parts, keep, text_slices

by_value(__name__)

# Fixed value: the letters that a line's key has in lower case.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

SLICE_BYTES = 8_000_000
# Keys whose bits one row set of a task covers, and bits in a block; they bound memory only.
CHUNK_KEYS = 2_000_000
_BLOCK = 1 << 16


@dataclass(frozen=True)
class LineDedup:
    """Lines found in `min_documents` documents or more go, if their key has `min_chars` code
    points. `keep_first` leaves the first of them: least doc_id (none comes last), then
    content, then place.

    A filter has at least `bits_per_line` bits a line, up to `most_bits`; beyond that more
    lines are shuffled, never fewer. Up to `broadcast_lines` confirmed lines are broadcast;
    beyond that documents and lines are joined.
    """

    min_documents: int = 2
    min_chars: int = 1
    keep_first: bool = True
    bits_per_line: int = 8
    most_bits: int = 1 << 30
    broadcast_lines: int = 1 << 20


def line_keys(text: str) -> list[bytes]:
    """Each line stripped of white space at both ends, A-Z in lower case."""
    return [line.strip() for line in text.encode().translate(_LOWER).split(b"\n")]


def _hashed(texts: pa.LargeStringArray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, line number and 128-bit hash of each line that is long enough."""
    docs, lines, digests = [], [], []
    for i, text in enumerate(texts.to_pylist()):
        for j, key in enumerate(line_keys(text)):
            if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                docs.append(i)
                lines.append(j)
                digests.append(xxhash.xxh3_128_digest(key))
    hashes = np.frombuffer(b"".join(digests), "S16") if digests else np.zeros(0, "S16")
    return np.array(docs, np.int64), np.array(lines, np.int64), hashes


def _once_a_document(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first line of each key in each document."""
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    return np.sort(order[new])


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a filter for each hash, as two columns."""
    halves = np.ascontiguousarray(hashes).view("<u8").reshape(-1, 2)
    return (halves & np.uint64(bits - 1)).astype(np.int64)


def _by_block(places: np.ndarray, blocks: int) -> pa.Array:
    """Places in order, as 16-bit numbers, in one binary cell for each block."""
    places = np.unique(places)
    bounds = 2 * np.searchsorted(places, np.arange(blocks + 1) * _BLOCK)
    data = (places & (_BLOCK - 1)).astype("<u2").tobytes()
    return pa.BinaryArray.from_buffers(
        pa.binary(), blocks, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
    )


def filter_size(docs: DataFrame, how: LineDedup) -> int:
    """Bits of a filter: a power of two, from the number of lines."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.agg(F.sum(F.regexp_count(text, F.lit("\n")).cast("long") + 1)).first()[0] or 0
    wanted = max(how.bits_per_line * lines, _BLOCK)
    return min(1 << (int(wanted) - 1).bit_length(), how.most_bits)


def seen_twice(docs: DataFrame, bits: int, how: LineDedup) -> np.ndarray:
    """The filter of lines seen in a second document, eight bits to a byte.

    It holds all of them, and others by chance. Its size is bounded by `most_bits`.
    """
    blocks = bits // _BLOCK

    def collect(batches):
        held, waiting = [], 0

        def rows():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            once = _by_block(_bits(keys, bits).ravel(), blocks)
            twice = _by_block(_bits(keys[counts > 1], bits).ravel(), blocks)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(blocks), pa.int32()), once, twice], ["block", "once", "twice"]
            )
            return out.filter(pc.greater(pc.binary_length(once), 0))

        for batch in batches:
            for some in text_slices(batch["text"], SLICE_BYTES):
                found, _, hashes = _hashed(some, how.min_chars)
                held.append(hashes[_once_a_document(found, hashes)])
                waiting += len(held[-1])
                if waiting >= CHUNK_KEYS:
                    yield rows()
                    held, waiting = [], 0
        if waiting:
            yield rows()

    def merge(batches):
        block, once, twice = None, None, None

        def row():
            packed = zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "twice": pa.array([packed], pa.binary())}
            )

        for batch in batches:
            for place, some, again in zip(
                batch["block"].to_pylist(), batch["once"].to_pylist(), batch["twice"].to_pylist()
            ):
                if place != block:
                    if block is not None:
                        yield row()
                    block, once, twice = place, np.zeros(_BLOCK, bool), np.zeros(_BLOCK, bool)
                found = np.frombuffer(some, "<u2")
                twice[found[once[found]]] = True
                twice[np.frombuffer(again, "<u2")] = True
                once[found] = True
        if block is not None:
            yield row()

    sent = docs.select("text").mapInArrow(collect, "block int, once binary, twice binary")
    merged = (
        sent.repartition(input_parts(docs.sparkSession), "block")
        .sortWithinPartitions("block")
        .mapInArrow(merge, "block int, twice binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    for block, twice in merged.toPandas().itertuples(index=False):
        start = block * (_BLOCK // 8)
        out[start : start + _BLOCK // 8] = np.frombuffer(zlib.decompress(twice), np.uint8)
    return out


def _suspects(docs: DataFrame, bits: int, twice, how: LineDedup) -> DataFrame:
    """(key, doc_id, content, line) of the lines that may stand in two documents, once for
    each key of a document."""

    def work(batches):
        table = twice.value
        for batch in batches:
            start = 0
            for some in text_slices(batch["text"], SLICE_BYTES):
                found, lines, hashes = _hashed(some, how.min_chars)
                own = _once_a_document(found, hashes)
                places = _bits(hashes[own], bits)
                own = own[((table[places >> 3] >> (places & 7)) & 1).all(axis=1)]
                rows = pa.array(start + found[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(16), len(own), [None, pa.py_buffer(hashes[own].tobytes())]
                        ).cast(pa.binary()),
                        batch["doc_id"].take(rows),
                        batch["content"].take(rows),
                        pa.array(lines[own], pa.int64()),
                    ],
                    ["key", "doc_id", "content", "line"],
                )
                start += len(some)

    return docs.mapInArrow(work, "key binary, doc_id long, content binary, line long")


def _confirmed(suspects: DataFrame, how: LineDedup) -> DataFrame:
    """(key, n, first) of the lines that enough documents have; first is null unless wanted."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "line")
    first = F.min(place) if how.keep_first else F.lit(None).cast(
        "struct<no_id: boolean, doc_id: bigint, content: binary, line: bigint>"
    )
    counted = suspects.groupBy("key").agg(F.count("*").alias("n"), first.alias("first"))
    return counted.where(F.col("n") >= how.min_documents)


def _without(texts: list[str], gone: list[set]) -> list[pa.Array]:
    """Texts without the lines of some numbers."""
    n_lines, n_dropped, kept = [], [], []
    for text, numbers in zip(texts, gone):
        lines = text.split("\n")
        n_lines.append(len(lines))
        n_dropped.append(len(numbers))
        if numbers:
            text = "\n".join(line for j, line in enumerate(lines) if j not in numbers)
        kept.append(text)
    return [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]


_KEPT = "doc_id long, n_lines long, n_dropped long, text string"


def _drop_by_lookup(docs: DataFrame, confirmed: DataFrame, how: LineDedup) -> DataFrame:
    """Texts without the confirmed lines, which are few enough to be broadcast."""
    found = confirmed.select("key", "first.doc_id", "first.content", "first.line").toArrow()
    keys = np.array(found["key"].to_pylist(), "S16")
    order = np.argsort(keys)
    firsts = list(zip(*(found[c].to_pylist() for c in ("doc_id", "content", "line"))))
    held = docs.sparkSession.sparkContext.broadcast(
        (keys[order], [firsts[i] for i in order] if how.keep_first else None)
    )

    def work(batches):
        keys, firsts = held.value
        for batch in batches:
            start = 0
            for some in text_slices(batch["text"], SLICE_BYTES):
                in_doc, lines, hashes = _hashed(some, how.min_chars)
                gone = [set() for _ in range(len(some))]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    for i in np.flatnonzero(keys[at] == hashes):
                        gone[in_doc[i]].add(int(lines[i]))
                        if firsts:
                            row = start + int(in_doc[i])
                            own = batch["doc_id"][row].as_py(), batch["content"][row].as_py(), int(lines[i])
                            if firsts[at[i]] == own:
                                gone[in_doc[i]].discard(own[2])
                columns = _without(some.to_pylist(), gone)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, len(some)), *columns],
                    ["doc_id", "n_lines", "n_dropped", "text"],
                )
                start += len(some)

    return docs.mapInArrow(work, _KEPT)


def _drop_by_join(docs: DataFrame, suspects: DataFrame, confirmed: DataFrame, how: LineDedup) -> DataFrame:
    """The same where the confirmed lines are too many to be broadcast."""
    own = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.content") == F.col("content"))
    lists = (
        suspects.drop("line")
        .join(confirmed.select("key", "first"), "key")
        .select("doc_id", "content", "key", F.when(own, F.col("first.line")).alias("stays"))
        .groupBy("doc_id", "content")
        .agg(F.collect_set(F.struct("key", "stays")).alias("keys"))
    )
    same = docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["content"] == lists["content"])
    joined = docs.join(lists, same, "left").select(docs["doc_id"], "text", "keys")

    def work(batches):
        for batch in batches:
            start = 0
            for some in text_slices(batch["text"], SLICE_BYTES):
                wanted = [
                    {k["key"]: k["stays"] for k in keys or ()}
                    for keys in batch["keys"].slice(start, len(some)).to_pylist()
                ]
                in_doc, lines, hashes = _hashed(some, how.min_chars)
                gone = [set() for _ in range(len(some))]
                raw = hashes.tobytes()
                for i, (doc, line) in enumerate(zip(in_doc, lines)):
                    key = raw[16 * i : 16 * i + 16]
                    if key in wanted[doc] and wanted[doc][key] != line:
                        gone[doc].add(int(line))
                columns = _without(some.to_pylist(), gone)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, len(some)), *columns],
                    ["doc_id", "n_lines", "n_dropped", "text"],
                )
                start += len(some)

    return joined.mapInArrow(work, _KEPT)


def dedup_lines(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of each row, without the lines that others share.

    A text is cut at line feeds; a null or empty text is one empty line. A line's key is the
    line without white space at its ends, A-Z in lower case; keys of fewer than `min_chars`
    code points always stay. Every row is a document of its own, also one that repeats a
    doc_id or has none, so copies count; a key counts once a document. With `keep_first`,
    rows alike in doc_id and text all keep their first line. A text whose lines all go is
    empty. Other columns are left out; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bits = filter_size(own, how)
    twice = docs.sparkSession.sparkContext.broadcast(seen_twice(own, bits, how))
    own = own.withColumn("content", F.unhex(F.md5("text")))
    suspects = keep(_suspects(own, bits, twice, how), "suspects")
    confirmed = keep(_confirmed(suspects, how), "confirmed")
    if confirmed.count() <= how.broadcast_lines:
        return _drop_by_lookup(own, confirmed, how)
    return _drop_by_join(own, suspects, confirmed, how)
