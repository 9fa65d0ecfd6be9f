"""Collocations: phrases that occur far more often than their parts would together.

Counts are made order by order. A phrase can only be frequent if the two phrases of one word
less inside it are, so those are looked up in a bit table of fixed size, and what passes is
counted exactly. Frequent phrases, of which there are few, form two streams of counts. One
is in prefix order: every phrase beside the phrase without its last word. One is in suffix
order: every phrase beside the phrase without its first word. Merge joins read the streams
in step, order by order, and collect the counts of all left parts, all right parts, and the
counts of the extensions of each phrase. No part of it holds a table of counts in memory.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsieve.llm.bit_table import collect_bits, may_hold, places
from cardsieve.llm.common import by_value, keep, mix, text_slices

by_value(__name__)

# What cuts texts into pieces, and the letters that become lower case.
_CUTS = b".,;:!?\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes.maketrans(_CUTS + b"\t" + _UPPER, b"\n" * len(_CUTS) + b" " + _UPPER.lower())

SLICE_BYTES = 8_000_000


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 to `longest` words that occur `least` times or more, the first `top` of
    each language. A phrase goes if one that holds it has `share` percent of its count.

    The bit table's size decides how many rare phrases are counted, not the result.
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    share: int = 100
    table_bits: int = 1 << 27


def _tokens(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.Array, int]:
    """Numbers of all words in place order, the words by number, and the number that stands
    between pieces."""
    raw = b"\n".join(texts.cast(pa.large_binary()).to_pylist()) + b"\n"
    raw = raw.translate(_TABLE).replace(b"\n", b" \n ")
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)]
    )
    found = pc.split_pattern(whole.cast(pa.large_string(), safe=False), " ").flatten()
    cut = found.filter(pc.greater(pc.binary_length(found), 0)).dictionary_encode()
    return cut.indices.to_numpy(), cut.dictionary, pc.index(cut.dictionary, "\n").as_py()


def _fold(first: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """One hash for the words of each phrase, from the hash of its language."""
    for column in columns:
        first = mix(first * np.uint64(0x9E3779B97F4A7C15) + column)
    return first


def _word_hashes(words: pa.Array) -> np.ndarray:
    raw = words.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))


def _starts(ids, words, stop, order: int, lang: str, table) -> np.ndarray:
    """Where phrases of `order` words begin that lie in one piece and may be frequent."""
    n = len(ids) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = ids != stop
    ok = np.logical_and.reduce([inside[i : n + i] for i in range(order)])
    if order > 1:
        own = _word_hashes(words)[ids]
        seed = np.full(n + 1, xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
        shorter = may_hold(table, _fold(seed, [own[i : n + 1 + i] for i in range(order - 1)]))
        ok &= shorter[:-1] & shorter[1:]
    return np.flatnonzero(ok)


def _count(ids: np.ndarray, at: np.ndarray, order: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different phrase, and how often it occurs. Words are put together
    to one number as long as it fits 63 bits; before it would not, numbers are dealt anew."""
    code, span = ids[at].astype(np.int64), n_words
    for i in range(1, order):
        if span * n_words >= 1 << 63:
            known, code = np.unique(code, return_inverse=True)
            span = len(known)
        code, span = code * n_words + ids[at + i], span * n_words
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return at[first], counts


def count_phrases(docs: DataFrame, order: int, table) -> DataFrame:
    """(lang, phrase, n) of (lang, text): how often each phrase of `order` words occurs.

    `table` is a broadcast bit table with all frequent phrases of one word less; phrases
    that cannot be frequent may be left out. It is not asked for single words.
    """

    def work(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for lang in pc.unique(batch["lang"]).to_pylist():
                own = rows.filter(pc.equal(rows["lang"], lang))["text"].combine_chunks()
                for some in text_slices(own, SLICE_BYTES):
                    ids, words, stop = _tokens(some)
                    at = _starts(ids, words, stop, order, lang, table.value if table else None)
                    at, counts = _count(ids, at, order, len(words))
                    parts = [words.take(pa.array(ids[at + i])) for i in range(order)]
                    phrases = pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(at), pa.string()),
                            phrases.cast(pa.string()),
                            pa.array(counts, pa.int64()),
                        ],
                        ["lang", "phrase", "n"],
                    )

    found = docs.mapInArrow(work, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_table(frequent: DataFrame, order: int, bits: int) -> np.ndarray:
    """A bit table of (lang, phrase) with phrases of `order` words."""

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = pc.split_pattern(batch["phrase"], " ").flatten().dictionary_encode()
            own = _word_hashes(words.dictionary)[words.indices.to_numpy()].reshape(-1, order)
            langs = batch["lang"].dictionary_encode()
            seed = _word_hashes(langs.dictionary)[langs.indices.to_numpy()]
            taken = np.concatenate(places(_fold(seed, list(own.T)), bits))
            yield pa.RecordBatch.from_arrays([pa.array(taken)], ["place"])

    return collect_bits(frequent.select("lang", "phrase").mapInArrow(work, "place long"), bits)


def frequent_counts(docs: DataFrame, how: Phrases) -> tuple[DataFrame, list[DataFrame]]:
    """All words of (lang, text) by language, (lang, n), and the frequent phrases of each
    order, (lang, phrase, n), shortest first."""
    context = docs.sparkSession.sparkContext
    words = keep(count_phrases(docs, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    streams = [words.where(F.col("n") >= how.least)]
    for order in range(2, how.longest + 1):
        table = context.broadcast(frequent_table(streams[-1], order - 1, how.table_bits))
        counted = count_phrases(docs, order, table).where(F.col("n") >= how.least)
        streams.append(keep(counted, f"phrases-{order}"))
    return totals, streams


def _but_last(order: int) -> Column:
    return F.substring_index("phrase", " ", order - 1)


def _but_first(order: int) -> Column:
    return F.substring_index("phrase", " ", 1 - order)


def merge_streams(streams: list[DataFrame]) -> DataFrame:
    """(lang, phrase, n, lefts, rights, extended) of all phrases of two words and more.

    lefts are the counts of the phrase's first 1, 2, ... words, rights those of what follows
    them, and extended is the greatest count of a phrase with one word more at either end.
    Every part of a frequent phrase is frequent, so the inner joins lose none.
    """
    none = F.array().cast("array<long>")
    below = streams[0].select("lang", "phrase", "n", none.alias("lefts"), none.alias("rights"))
    merged = []
    for order, stream in enumerate(streams[1:], 2):
        in_prefix_order = stream.withColumn("part", _but_last(order))
        shorter = below.hint("merge")
        with_lefts = in_prefix_order.join(
            shorter.select(
                "lang",
                F.col("phrase").alias("part"),
                F.concat("lefts", F.array("n")).alias("lefts"),
            ),
            ["lang", "part"],
        ).drop("part")
        in_suffix_order = with_lefts.withColumn("part", _but_first(order))
        own = in_suffix_order.join(
            shorter.select(
                "lang",
                F.col("phrase").alias("part"),
                F.concat(F.array("n"), "rights").alias("rights"),
            ),
            ["lang", "part"],
        ).drop("part")
        below = keep(own, f"merged-{order}")
        merged.append(below)
    extensions = [
        longer.select("lang", cut(order).alias("phrase"), "n")
        for order, longer in enumerate(merged[1:], 3)
        for cut in (_but_last, _but_first)
    ]
    out = merged[0]
    for more in merged[1:]:
        out = out.union(more)
    if not extensions:
        return out.withColumn("extended", F.lit(None).cast("long"))
    stream = extensions[0]
    for more in extensions[1:]:
        stream = stream.union(more)
    extended = stream.groupBy("lang", "phrase").agg(F.max("n").alias("extended"))
    return out.join(extended.hint("merge"), ["lang", "phrase"], "left")


def rank_phrases(merged: DataFrame, totals: DataFrame, how: Phrases) -> DataFrame:
    """The best phrases of each language, from merged streams and all words (lang, n)."""
    exact = "1000 * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))"
    parts = "CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0))"
    cuts = "transform(lefts, (l, i) -> struct(l, rights[i] AS r, i))"
    found = merged.where("extended IS NULL OR extended < n").withColumnRenamed("n", "a")
    # Of equal scores the first cut is the least struct.
    best = f"array_min(transform({cuts}, c -> struct({exact} div ({parts}) AS score, c.i, c.l, c.r)))"
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        found.join(totals, "lang")
        .selectExpr("lang", "phrase", "a", "n", f"{best} AS best")
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= how.top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def collocations(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and
    tabs, A-Z in lower case. Null texts have no words; a null lang is `und`. A phrase's
    score is 1000 * a * n / (l * r), rounded down, at the cut where that is least, the first
    of such: a is its count, l and r are those of its parts, n counts the words of the
    language. Equal scores are ordered by count, then by the bytes of the phrase. Rows count
    as they come, repeated ones too; other columns are left out, and an empty table gives an
    empty result.

    A phrase whose words stand in a longer one with `share` percent of its count is left
    out. The longer one's count is never the greater, and at a share of 100 no less either,
    so one word more at either end tells; a smaller share would need longer steps and is
    refused.
    """
    if how.share != 100:
        raise ValueError("only a share of 100 percent is told by one word more")
    own = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"
    )
    totals, streams = frequent_counts(own, how)
    return rank_phrases(merge_streams(streams), totals, how)
