"""Quality rules: a base of counted rules, and hashed n-gram log-likelihood ratios.

Each ratio compares trusted documents with all documents. Over hash buckets of byte n-grams,
a document's score is the mean of the log ratio, so its length does not matter; this finds
junk. A few insults among hundreds of ordinary n-grams vanish in that mean. So hashed words,
and the starts of longer words, are counted too, by the number of documents they stand in:
a word is avoided if trusted documents have it far less often than their share of all
documents would let expect, and a document is held against the share of avoided words among
its words. All thresholds are fixed.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import (
    SLICE_BYTES,
    by_value,
    dictionary_hashes,
    keep,
    releasing,
    shingle_hashes,
    split_words,
    text_slices,
)

by_value(__name__)

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Quality:
    """Settings. `trusted_rows` bounds the labelled sample that the target is counted on.

    A word is avoided if its log ratio, with `word_prior` documents added on both sides, is
    under `avoided`; of a text's words, `most_avoided` may be. Both were set from labelled
    clean and toxic documents (see the README).
    """

    trusted_rows: int = 200_000
    n: int = 3
    bucket_bits: int = 16
    threshold: float = -0.6
    word_bits: int = 24
    word_start: int = 8
    word_prior: float = 2.0
    avoided: float = -1.0
    most_avoided: float = 0.01
    least_words: int = 10
    window: int = 5
    most_repeated_percent: int = 20


def ngram_buckets(text: bytes, n: int, bits: int) -> np.ndarray:
    """Hash buckets of all byte n-grams; a shorter text is one n-gram, padded with zeros."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text.ljust(n, b"\0"), np.uint8).astype(np.uint32)
    size = len(data) - n + 1
    out = np.zeros(size, np.uint32)
    for i in range(n):
        out = (out ^ data[i : i + size]) * np.uint32(0x01000193)
    out ^= out >> np.uint32(15)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def word_buckets(texts: pa.LargeStringArray, how: Quality) -> list[np.ndarray]:
    """For each text a row for each of its words: buckets of the word and of its start.

    A word without a longer form than its start has its own bucket in both columns.
    """
    words, starts = split_words(texts, lower=True, bare=True)
    different = words.dictionary.cast(pa.large_binary()).to_pylist()
    shift = 64 - how.word_bits
    found = np.empty((len(different), 2), np.int64)
    for i, word in enumerate(different):
        found[i] = xxhash.xxh3_64_intdigest(word) >> shift
        if len(word) > how.word_start:
            found[i, 1] = xxhash.xxh3_64_intdigest(b"\0" + word[: how.word_start]) >> shift
    rows = found[words.indices.to_numpy()]
    return [rows[starts[i] : starts[i + 1]] for i in range(len(texts))]


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words that lie in some run of `window` words found at least twice in the text."""
    if len(hashes) < window:
        return 0
    _, which, times = np.unique(
        shingle_hashes(hashes, window), return_inverse=True, return_counts=True
    )
    again = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def base_counts(texts: pa.LargeStringArray, window: int) -> list[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text."""
    words, starts = split_words(texts, lower=False)
    hashes = dictionary_hashes(words)
    out = []
    for i, text in enumerate(texts.to_pylist()):
        own = hashes[starts[i] : starts[i + 1]]
        out.append(
            (
                len(own),
                len(text) - sum(map(text.count, _SPACES)),
                sum(map(text.count, SYMBOLS)),
                duplicate_lines(text),
                repeated_words(own, window),
            )
        )
    return out


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """doc_ids whose labels all say good quality and not toxic: at most `rows`, by hash."""
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where("quality = 1 AND coalesce(toxic, 0) = 0")
        .select("doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def count_buckets(docs: DataFrame, labels: DataFrame, how: Quality) -> DataFrame:
    """(bucket, raw, target): counts of all documents and of the trusted ones.

    First come the buckets of byte n-grams, then those of words, which count documents, and
    last one that counts the documents themselves. A task sends the buckets it met, so at most
    as many as its texts have different words.
    """
    size, words = 1 << how.bucket_bits, 1 << how.word_bits

    @releasing
    def work(batches):
        raw, target = (np.zeros(size, np.int64) for _ in range(2))
        # A task has fewer than 2^32 documents.
        raw_in, target_in = (np.zeros(words + 1, np.uint32) for _ in range(2))
        for batch in batches:
            trusted = iter(batch["trusted"].to_pylist())
            for some in text_slices(batch["text"], SLICE_BYTES):
                own = word_buckets(some, how)
                for text, word, good in zip(some.cast(pa.large_binary()), own, trusted):
                    found = ngram_buckets(text.as_py(), how.n, how.bucket_bits)
                    large = len(found) > size // 8
                    counts = np.bincount(found, minlength=size) if large else None
                    once = np.append(np.unique(word), words)
                    for total in (raw, target) if good else (raw,):
                        if counts is None:
                            np.add.at(total, found, 1)
                        else:
                            total += counts
                    for total in (raw_in, target_in) if good else (raw_in,):
                        total[once] += 1
        for first, one, two in ((0, raw, target), (size, raw_in, target_in)):
            seen = np.flatnonzero(one)
            for start in range(0, len(seen), 1 << 16):
                some = seen[start : start + (1 << 16)]
                counted = [pa.array(total[some].astype(np.int64)) for total in (one, two)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some + first, pa.int32()), *counted], ["bucket", "raw", "target"]
                )

    # At most `trusted_rows` ids, so the broadcast has a bound that does not grow.
    good = F.broadcast(trusted_ids(labels, how.trusted_rows).withColumn("trusted", F.lit(True)))
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(good, "doc_id", "left")
    return (
        marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(work, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: DataFrame, how: Quality) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log ratio for each bucket of byte n-grams, and which words are avoided.

    Of the words' counts only the avoided buckets come to the driver, at most 2^word_bits.
    """
    size, words = 1 << how.bucket_bits, 1 << how.word_bits
    counts = keep(counts, "quality-counts")
    found = counts.where((F.col("bucket") < size) | (F.col("bucket") == size + words)).toPandas()
    raw, target = (np.zeros(size, np.int64) for _ in range(2))
    share = 0.0
    for bucket, n_raw, n_target in zip(found["bucket"], found["raw"], found["target"]):
        if bucket < size:
            raw[bucket], target[bucket] = n_raw, n_target
        else:
            share = n_target / n_raw
    ratios, avoided = np.zeros(size, np.float32), np.zeros(words, bool)
    if target.any():
        raw, target = raw + 1, target + 1
        ratios = (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)
    if share:
        ratio = F.log(
            (F.col("target") + how.word_prior) / (F.col("raw") * share + how.word_prior)
        )
        rare = counts.where(
            (F.col("bucket") >= size) & (F.col("bucket") < size + words) & (ratio < how.avoided)
        )
        avoided[rare.select("bucket").toPandas()["bucket"].to_numpy(np.int64) - size] = True
    return ratios, avoided


def quality(docs: DataFrame, labels: DataFrame, how: Quality = Quality()) -> DataFrame:
    """Every column of `docs`, then n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, avoided_share and kept; a column of `docs` with one
    of these names is replaced.

    Null and empty texts have no words, so they fail the base. Rows that repeat a doc_id are
    judged each for itself; a null doc_id is judged like any other. Without trusted
    documents all scores and shares are 0 and the base alone decides. Extra columns of `labels` are not
    looked at. An empty table gives an empty result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios, avoided = log_ratios(count_buckets(docs, labels, how), how)
    packed = np.packbits(avoided)

    @releasing
    def work(batches):
        avoided = np.unpackbits(packed).view(bool)
        for batch in batches:
            found, scores, shares = [], [], []
            for some in text_slices(batch["text"], SLICE_BYTES):
                found.extend(base_counts(some, how.window))
                for text in some.cast(pa.large_binary()):
                    buckets = ngram_buckets(text.as_py(), how.n, how.bucket_bits)
                    total = ratios[buckets].sum(dtype=np.float64) if len(buckets) else 0.0
                    scores.append(round(total / max(len(buckets), 1), 6))
                for word in word_buckets(some, how):
                    share = avoided[word].any(axis=1).sum() / max(len(word), 1)
                    shares.append(round(float(share), 6))
            numbers = zip(*found) if found else [()] * len(added)
            columns = [pa.array(c, pa.int64()) for c in numbers]
            columns += [pa.array(scores, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *added, "score", "avoided_share"]
            )

    own = docs.drop(*added, "score", "avoided_share", "base_failed", "kept")
    schema = own
    for name in added:
        schema = schema.withColumn(name, F.lit(0).cast("long"))
    schema = schema.withColumn("score", F.lit(0.0)).withColumn("avoided_share", F.lit(0.0))
    judged = own.mapInArrow(work, schema.schema)
    failed = (F.col("n_words") < how.least_words) | (
        100 * F.col("n_repeat_words") > how.most_repeated_percent * F.col("n_words")
    )
    good = (F.col("score") >= how.threshold) & (F.col("avoided_share") <= how.most_avoided)
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & good
    )
