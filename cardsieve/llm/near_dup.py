"""MinHash near-duplicates by an inverted join on signature coordinates.

Each document posts itself under its (coordinate, value) pairs. Two documents whose word
shingles overlap enough agree in at least `matches` coordinates, so they meet under at least
one of the `coordinates - matches + 1` rarest pairs of either one (prefix); the long lists of
common pairs are skipped and only looked up when a met pair's agreements are counted. Counted
pairs are then confirmed on the full shingle sets.

No list is expanded into all its pairs. Equal sets are one node from the start. In each list
the nodes are first compared with two central members; confirmed links form components, and
only lists that still hold several components are compared further, in blocks, and only
across components. So links inside a component may go unlisted; no two components are joined
by a link that was not looked at.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import (
    SLICE_BYTES,
    by_value,
    dictionary_hashes,
    input_parts,
    keep,
    mix,
    releasing,
    shingle_hashes,
    sorted_groups,
    split_words,
    text_slices,
)
from cardsieve.llm.components import component_labels

by_value(__name__)

# Rows of 64 bits in the table that tells wanted documents from most others.
FILTER_BITS = 18
FILTER_WORDS = 1 << FILTER_BITS


@dataclass(frozen=True)
class NearDup:
    """Settings: words per shingle, similarity as `part / whole`, and the signature.

    At a similarity of 0.8, 64 coordinates agree in 51 places on average, and in fewer than
    36 with a chance of about two in a million.
    """

    width: int = 5
    part: int = 80
    whole: int = 100
    coordinates: int = 64
    matches: int = 36
    block: int = 512


def _signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each seeded hash over a set, 32 bits each."""
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64))
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        some = shingles[start : start + 512, None] ^ seeds[None, :]
        some = some * np.uint64(0x9E3779B97F4A7C15)
        some = (some ^ (some >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, some.min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted set of shingle hashes of each text in turn."""
    for some in text_slices(texts, SLICE_BYTES):
        words, starts = split_words(some, lower=True)
        hashes = dictionary_hashes(words)
        for start, end in zip(starts[:-1], starts[1:]):
            yield np.unique(shingle_hashes(hashes[start:end], width))


def signatures(docs: DataFrame, how: NearDup) -> DataFrame:
    """Per document: size of its shingle set, a 128-bit digest of the set, the signature."""

    @releasing
    def work(batches):
        import xxhash

        for batch in batches:
            rows = []
            for found in shingle_sets(batch["text"], how.width):
                full = len(found) > 0
                rows.append(
                    (
                        len(found),
                        xxhash.xxh3_128_digest(found.tobytes()) if full else None,
                        _signature(found, how.coordinates).tobytes() if full else None,
                    )
                )
            sizes, digests, signs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signs, pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_shingles long, digest binary, signature binary"
    )


def _postings(nodes: DataFrame) -> DataFrame:
    """(node, key) with one key for each coordinate and its value."""

    @releasing
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32)
            signs = signs.reshape(batch.num_rows, -1)
            k = signs.shape[1]
            keys = signs.astype(np.int64) | (np.arange(k, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch["node"].to_numpy(), k)), pa.array(keys.ravel())],
                ["node", "key"],
            )

    return nodes.select("node", "signature").mapInArrow(work, "node long, key long")


def _prefixes(nodes: DataFrame, how: NearDup) -> DataFrame:
    """(key, node, weight, mask): each node under its rarest keys, as far as others share them.

    A key that only one node has joins nothing, but takes a place in the node's prefix; a
    node with fewer than `matches` shared keys has no partner at all.
    """
    posted = keep(_postings(nodes), "postings")
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(sizes, "key").groupBy("node").agg(
        F.count("*").alias("n_shared"),
        F.sum(F.log2("n")).cast("long").alias("weight"),
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"),
    )
    first = F.slice("keys", F.lit(1), F.col("n_shared").cast("int") - how.matches + 1)
    prefix = shared.where(F.col("n_shared") >= how.matches).select(
        "node", "weight", first.getField("key").alias("prefix")
    )
    # A bit for each coordinate in the prefix.
    mask = "aggregate(prefix, 0L, (m, k) -> m | shiftleft(1L, CAST(shiftright(k, 32) AS INT)))"
    return prefix.select(
        "node", "weight", F.expr(mask).alias("mask"), F.explode("prefix").alias("key")
    )


def _mostly(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents whose node is wanted, and few others: a bit table of fixed size.

    It keeps most unwanted texts out of the shuffle of the exact join that follows. Its
    FILTER_WORDS rows are all that is broadcast, at any input size; a fuller table lets more
    documents through, never fewer.
    """
    place = F.xxhash64("node")
    word = F.pmod(place, F.lit(FILTER_WORDS)).alias("word")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(shiftright(xxhash64(node), {FILTER_BITS}), 64) AS INT))")
    bits = nodes.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return (
        docs.withColumn("word", word)
        .join(F.broadcast(bits), "word")
        .where(F.col("bits").bitwiseAND(bit) != 0)
        .drop("word", "bits")
    )


def _sets(docs: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame:
    """(node, shingles) with the full set, for the documents of the wanted nodes, each named
    once. Only texts that pass the bit table are shuffled."""

    @releasing
    def work(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch["text"], how.width)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])])
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch["node"], lists.cast(pa.list_(pa.int64()))], ["node", "shingles"]
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    # A semi join would be pushed below the bit table.
    return _mostly(wanted, nodes).join(nodes, "node").mapInArrow(
        work, "node long, shingles array<long>"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", shared.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
        .where(how.whole * F.col("both") >= how.part * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def _met(group: pa.Table, how: NearDup):
    """(i, places j) of each member's partners in another component, in a dealt group.

    Partners agree in enough coordinates and have sizes that allow the similarity. A pair
    that meets under several keys counts under that of its first common coordinate alone.
    """
    node, label, size, mask = (
        group[c].to_numpy() for c in ("node", "label", "n_shingles", "mask")
    )
    signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint32)
    signs = signs.reshape(len(node), -1)
    used = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    used = used[:, : signs.shape[1]].astype(bool)
    main = group["is_main"].to_numpy(zero_copy_only=False)
    crossing = bool(group["m"][0].as_py())
    coordinate = int(group["key"][0].as_py()) >> 32
    for i in range(len(node)):
        rest = (label != label[i]) & (node > node[i])
        if crossing:
            rest &= main != main[i]
        least, most = np.minimum(size, size[i]), np.maximum(size, size[i])
        rest &= how.whole * least >= how.part * most
        j = np.flatnonzero(rest)
        if not len(j):
            continue
        equal = signs[j] == signs[i]
        first = (equal & used[j] & used[i]).argmax(axis=1) == coordinate
        j = j[first & (equal.sum(axis=1) >= how.matches)]
        if len(j):
            yield i, j


def _across(lists: DataFrame, nodes: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Confirmed links (a, b) between different components that meet in some list.

    A list is dealt into blocks: members of its main component, and the others. Main blocks
    meet other blocks, other blocks meet each other; main blocks never meet one another. A
    first pass over signatures finds the members that have partners at all; only these bring
    their full sets to a second pass, which confirms pairs in place. It gives links that
    connect what is connected in a block, and so never more than the block has members.
    """
    sizes = (
        lists.groupBy("key")
        .agg(
            F.max_by("label", F.struct("weight", "label")).alias("main"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .where("low <> high")
        .select("key", "main")
    )
    known = lists.join(sizes, "key").withColumn("is_main", F.col("label") == F.col("main"))
    known = keep(known.drop("main", "weight"), "mixed")
    counts = known.groupBy("key").agg(
        F.ceil(F.count_if("is_main") / how.block).alias("mains"),
        F.ceil(F.count_if(~F.col("is_main")) / how.block).alias("others"),
    )
    meet = """
        CASE WHEN is_main THEN transform(sequence(0L, others - 1), j -> struct(true AS m, own AS i, j AS j))
        ELSE concat(
            CASE WHEN mains > 0 THEN transform(sequence(0L, mains - 1), i -> struct(true AS m, i AS i, own AS j))
                ELSE array() END,
            transform(sequence(0L, others - 1),
                j -> struct(false AS m, least(own, j) AS i, greatest(own, j) AS j)))
        END"""
    blocks = F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))
    dealt = known.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    dealt = dealt.select("*", F.inline(F.expr(meet))).drop("own", "mains", "others")
    group = ["key", "m", "i", "j"]
    parts = input_parts(lists.sparkSession)

    def side_by_side(rows: DataFrame) -> DataFrame:
        rows = rows.join(nodes.select("node", "signature", "n_shingles"), "node")
        return rows.repartition(parts, *group).sortWithinPartitions(*group)

    def find(batches):
        for rows in sorted_groups(batches, group):
            met = np.zeros(rows.num_rows, bool)
            for i, j in _met(rows, how):
                met[i] = True
                met[j] = True
            if met.any():
                yield from rows.select(
                    [*group, "node", "label", "mask", "is_main"]
                ).filter(pa.array(met)).to_batches()

    kinds = "key long, m boolean, i long, j long, node long, label long, mask long, is_main boolean"
    found = keep(side_by_side(dealt).mapInArrow(find, kinds), "met")

    def confirm(batches):
        for rows in sorted_groups(batches, group):
            node, label = rows["node"].to_pylist(), rows["label"].to_pylist()
            shingles = rows["shingles"].combine_chunks()
            one = [shingles[i].values.to_numpy() for i in range(len(node))]
            above = {x: x for x in label}

            def top(x):
                while above[x] != x:
                    above[x] = above[above[x]]
                    x = above[x]
                return x

            a, b = [], []
            for i, partners in _met(rows, how):
                for j in partners:
                    x, y = top(label[i]), top(label[j])
                    if x == y:
                        continue
                    both = len(np.intersect1d(one[i], one[j], assume_unique=True))
                    if how.whole * both >= how.part * (len(one[i]) + len(one[j]) - both):
                        above[max(x, y)] = min(x, y)
                        a.append(node[i])
                        b.append(node[j])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

    full = side_by_side(found.join(sets, "node"))
    return full.mapInArrow(confirm, "a long, b long").distinct()


def _same_id(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of rows that repeat a doc_id with different sets."""
    own = signed.join(nodes.select("digest", "node"), "digest").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    )
    several = own.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return own.join(several.where("low <> high").select("a"), "a")


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are taken from A-Z lower-cased text; a document's set holds its different runs of
    `width` words, or its whole word sequence if that is shorter. Documents are linked when
    whole * intersection >= part * union. component_id is the least doc_id reachable.

    Null and empty texts have no shingles and stand alone. Rows that repeat a doc_id count
    as one document: what one of them is linked with, all are. A null doc_id takes no part:
    its component_id is null and it is kept. Other columns are not looked at. An empty table
    gives an empty result.
    """
    signed = keep(signatures(docs, how), "signatures")
    classes = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"),
        F.first("signature").alias("signature"),
        F.first("n_shingles").alias("n_shingles"),
    )
    nodes = keep(classes.select("node", "signature", "n_shingles", "digest"), "nodes")
    prefixes = keep(_prefixes(nodes, how), "prefixes")
    # Two central members of each list: the one whose keys are most shared, and the first.
    centres = prefixes.groupBy("key").agg(
        F.count("*").alias("n"),
        F.max_by("node", F.struct("weight", -F.col("node"))).alias("c"),
        F.min("node").alias("d"),
    ).where("n > 1")
    stars = (
        prefixes.join(centres, "key")
        .select("node", F.explode(F.array_distinct(F.array("c", "d"))).alias("centre"))
        .where("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    stars = keep(stars, "stars")
    within = prefixes.select("node").distinct()
    sets = keep(_sets(docs, within, how), "sets")
    links = keep(_confirmed(stars, sets, how), "links")
    labels = component_labels(links)
    lists = prefixes.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    more = keep(_across(keep(lists, "lists"), nodes, sets, how), "links")
    final = component_labels(
        labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        .union(more)
        .union(_same_id(signed, nodes))
    )
    nodes = nodes.join(final, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("component_id")
    )
    joined = signed.join(nodes, "digest", "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")
    ).alias("component_id")
    return joined.select("doc_id", "n_shingles", component).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
