"""Benchmark decontamination by SimHash over item-sized windows, DataFrame functions only.

Documents and items are cut into five-word shingles. A window has as many shingles as the
item. It can only be similar enough if it holds one of the item's rarest shingles, of which
there are so many that the others alone would not do. Those place the windows: every window
that holds such a shingle gets a 64-bit SimHash, from sums of bits that follow the window as it
moves. Two fingerprints that differ in at most `radius` bits are equal in one of radius + 1
blocks, so an equi-join on (item, block, bits of the block) finds all of them. What it finds
is confirmed by the exact weighted Jaccard similarity of the shingles, weights being how often
each occurs.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.bit_table import with_flag
from cardsieve.llm.common import keep

_WIDTH = 5

# Windows that one fold makes; this bounds the array that it grows.
_FOLD = 256


@dataclass(frozen=True)
class Decontaminate:
    """Settings. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, and in
    more than 19 about three times in ten thousand.

    `most_broadcast` is the number of benchmark shingles up to which they are broadcast; a
    larger benchmark meets the documents in a shuffled join.
    """

    similarity: float = 0.8
    radius: int = 19
    most_broadcast: int = 1_000_000


def _with_shingles(df: DataFrame, name: str) -> DataFrame:
    """Adds n, the number of words, and the shingle hashes in place order.

    A text of fewer than five words is one shingle; one without words has none.
    """
    words = F.filter(
        F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""
    )
    # Single words are looked up by place as well.
    run = ", ".join(f"get(words, i + {k})" for k in range(_WIDTH))
    hashes = F.expr(
        f"CASE WHEN n >= {_WIDTH} THEN transform(sequence(0, n - {_WIDTH}), i -> xxhash64({run}))"
        " WHEN n > 0 THEN array(xxhash64(words)) ELSE CAST(array() AS array<bigint>) END"
    )
    return df.withColumn("words", words).withColumn("n", F.size("words")).withColumn(name, hashes).drop("words")


def _fingerprint(shingles: str) -> Column:
    """64-bit SimHash: each bit is the majority of that bit over all shingles."""
    # Bound by a lambda, the array is computed once and not once for each bit.
    return F.expr(
        f"element_at(transform(array({shingles}), t -> aggregate(sequence(0, 63), 0L, (f, b) -> f |"
        " shiftleft(CASE WHEN 2 * aggregate(t, 0L, (s, x) -> s + (shiftrightunsigned(x, b) & 1L))"
        " > size(t) THEN 1L ELSE 0L END, b))), 1)"
    )


def _edges(radius: int) -> list[tuple[int, int]]:
    """First bit and mask of each of the radius + 1 blocks of a fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """One row for each block of a fingerprint."""
    blocks = [
        F.struct(
            F.lit(i).alias("block"),
            F.expr(f"shiftrightunsigned(print, {low}) & {mask}L").alias("bits"),
        )
        for i, (low, mask) in enumerate(_edges(radius))
    ]
    return df.select("*", F.inline(F.array(*blocks)))


def _first_equal(radius: int) -> Column:
    """The first block in which two fingerprints are equal, so that a pair counts once."""
    cases = " ".join(
        f"WHEN shiftrightunsigned(print ^ item_print, {low}) & {mask}L = 0 THEN {i}"
        for i, (low, mask) in enumerate(_edges(radius))
    )
    return F.expr(f"CASE {cases} END")


# Places are looked up one by one: slice() would copy the whole array every time.
# Windows of one item in one document: p has the item's number of shingles m, how many of them
# a similar window holds at least, and the places of its rare shingles in order. Windows may
# hang over either end of the document as far as that number allows.
_WINDOWS = f"""
    flatten(transform(
        filter(zip_with(
            filter(p.places, (q, i) -> i = 0 OR q - p.places[i - 1] > p.m),
            filter(p.places, (q, i) -> i = size(p.places) - 1 OR p.places[i + 1] - q > p.m),
            (a, b) -> named_struct('lo', greatest(a - p.m + 1, p.need - p.m), 'hi', least(b, n_hashes - p.need))),
            r -> r.lo <= r.hi),
        r -> flatten(transform(sequence(r.lo, r.hi, {_FOLD}), c -> aggregate(
            sequence(c, least(c + {_FOLD - 1}, r.hi)),
            named_struct('sums', transform(sequence(0, 63), b -> 0),
                'out', CAST(array() AS array<struct<begin: int, stop: int, print: bigint>>)),
            (held, s) -> element_at(transform(
                array(CASE WHEN s = c
                    THEN transform(held.sums, (x, b) -> aggregate(
                        sequence(greatest(s, 0), least(s + p.m, n_hashes) - 1), 0,
                        (t, i) -> t + CAST(shiftrightunsigned(get(hashes, i), b) & 1L AS INT)))
                    ELSE transform(held.sums, (x, b) -> x
                        + coalesce(CAST(shiftrightunsigned(get(hashes, s + p.m - 1), b) & 1L AS INT), 0)
                        - coalesce(CAST(shiftrightunsigned(get(hashes, s - 1), b) & 1L AS INT), 0)) END),
                sums -> named_struct('sums', sums, 'out', concat(held.out, array(named_struct(
                    'begin', greatest(s, 0), 'stop', least(s + p.m, n_hashes),
                    'print', aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CASE
                        WHEN 2 * sums[b] > least(s + p.m, n_hashes) - greatest(s, 0) THEN 1L ELSE 0L END, b))))))), 1),
            held -> held.out)))))
"""


def _weighted_overlap() -> Column:
    """Sum of the lesser counts over the sum of the greater ones."""
    plain = "size(own) = size(array_distinct(own)) AND size(theirs) = size(array_distinct(theirs))"
    both = (
        f"CASE WHEN {plain} THEN size(array_intersect(own, theirs)) ELSE"
        " aggregate(array_intersect(own, theirs), 0, (s, x) -> s + least("
        "size(filter(own, y -> y = x)), size(filter(theirs, y -> y = x)))) END"
    )
    return F.expr(f"{both} / (size(own) + size(theirs) - {both})")


def _rare_shingles(items: DataFrame) -> DataFrame:
    """(item_id, item_key, n, m, need, shingle): the shingles of each item that fewest other
    items have, one more than a window that is similar enough can do without."""
    each = items.select("item_id", "item_key", "n", "m", "need", F.explode("theirs").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.count("*").alias("n_items"))
    ranked = each.join(spread, "shingle").groupBy("item_id", "item_key", "n", "m", "need").agg(
        F.sort_array(F.collect_list(F.struct("n_items", "shingle"))).alias("ranked")
    )
    rare = F.expr("array_distinct(slice(ranked, 1, m - need + 1).shingle)")
    return ranked.select("item_id", "item_key", "n", "m", "need", F.explode(rare).alias("shingle"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, how: Decontaminate = Decontaminate()
) -> DataFrame:
    """Per document and item: doc_id, text_key, item_id, similarity, begin_word, end_word.

    The most similar window stands for the pair; of equally similar ones the first. Windows
    at the ends of a document are cut off there. text_key tells rows apart that share a
    doc_id or have none. An item of fewer than five words is found only in documents that are
    nothing but its words; null and empty texts have no words and are never found. Rows that
    repeat count once; texts that share an item_id are items of one name. Extra columns of
    either table are not looked at. An empty table on either side gives an empty result.
    """
    items = _with_shingles(
        benchmark.where("item_id IS NOT NULL")
        .select("item_id", F.xxhash64("text").alias("item_key"), "text")
        .dropDuplicates(["item_id", "item_key"]),
        "theirs",
    ).where("n > 0")
    items = items.drop("text").withColumn("m", F.size("theirs")).withColumn(
        "need", F.ceil(F.col("m") * F.lit(how.similarity) - 1e-9).cast("int")
    )
    marks = _rare_shingles(items)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )
    shingles = _with_shingles(own, "hashes").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_doc"),
        # The plain form adds a filter on the array below, which would compute it twice over.
        F.posexplode_outer("hashes").alias("pos", "shingle"),
    )
    known = _blocks(
        items.select("item_id", "item_key", "theirs", _fingerprint("theirs").alias("print")),
        how.radius,
    ).withColumnRenamed("print", "item_print")
    if marks.count() <= how.most_broadcast:
        marks, known = F.broadcast(marks), F.broadcast(known)
    # Both or neither are shorter than a shingle: a short item is met by a whole text only.
    fits = f"(n_doc < {_WIDTH}) = (n < {_WIDTH})"
    pairs = (
        shingles.join(marks, "shingle")
        .where(fits)
        .groupBy("doc_id", "text_key", "item_id", "item_key", "m", "need")
        .agg(F.sort_array(F.collect_set("pos")).alias("places"))
    )
    placed = keep(
        pairs.groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("item_id", "item_key", "m", "need", "places")).alias("pairs")
        ),
        "placed",
    )
    # The documents with windows are read again; hardly any other text is shuffled.
    key = F.xxhash64("doc_id", "text_key")
    again = with_flag(own, key, placed.select(key.alias("key")), "may_be").where("may_be")
    wanted = placed.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "pairs"
    )
    met = again.drop("may_be").join(
        wanted,
        F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")),
    ).dropDuplicates(["doc_id", "text_key"])
    each = f"flatten(transform(pairs, p -> transform({_WINDOWS}, w -> named_struct('item_id', p.item_id, 'item_key', p.item_key, 'w', w, 'own', transform(sequence(w.begin, w.stop - 1), i -> get(hashes, i))))))"
    windows = (
        _with_shingles(met, "hashes")
        .select("doc_id", "text_key", "n", "pairs", "hashes", F.size("hashes").alias("n_hashes"))
        .select("doc_id", "text_key", "n", F.inline(F.expr(each)))
        .select("doc_id", "text_key", "n", "item_id", "item_key", "w.*", "own")
    )
    near = (
        _blocks(windows, how.radius)
        .join(known, ["item_id", "item_key", "block", "bits"])
        .where(
            (F.col("block") == _first_equal(how.radius))
            & (F.bit_count(F.expr("print ^ item_print")) <= how.radius)
        )
    )
    # What the item lacks altogether bounds the similarity and is quickly counted.
    most = "(size(own) - size(array_except(own, theirs)))"
    near = near.where(f"{most} >= {how.similarity} * (size(own) + size(theirs) - {most}) - 1e-9")
    return (
        near.withColumn("similarity", _weighted_overlap())
        .where(F.col("similarity") >= how.similarity)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(
            F.max_by(
                F.struct("similarity", "begin", "stop", "n"),
                F.struct("similarity", -F.col("begin"), -F.col("stop")),
            ).alias("best")
        )
        .select(
            "doc_id",
            "text_key",
            "item_id",
            F.round("best.similarity", 6).alias("similarity"),
            F.col("best.begin").cast("long").alias("begin_word"),
            F.expr(
                f"CASE WHEN best.n < {_WIDTH} THEN best.n ELSE best.stop + {_WIDTH - 1} END"
            ).cast("long").alias("end_word"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, how: Decontaminate = Decontaminate()
) -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    found = find_contamination(docs, benchmark, how)
    found = found.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text")
    ).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(
        found,
        docs["doc_id"].cast("long").eqNullSafe(found["of_doc"]) & (key == found["of_text"]),
        "left_anti",
    )
