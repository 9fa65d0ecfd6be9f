"""The corpus pipeline: five stages from raw documents to packed training sequences."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cardsieve.llm import decontaminate, near_dup, packing, quality, secret_scan  # noqa: E402
from cardsieve.llm.bit_table import with_flag  # noqa: E402
from cardsieve.llm.common import keep, table  # noqa: E402
from cardsieve.llm.tokens import vocabulary_path  # noqa: E402


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """The rows with all but doc_id and text renamed, so that a stage's own columns clash with
    none, and the columns that name them back."""
    own = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select([F.col(c).alias(n) for c, n in own.items()]), [
        F.col(n).alias(c) for c, n in own.items()
    ]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio.

    Each row is judged for itself, so repeated rows fare alike; null and empty texts have no
    words and go. Labels without a document count for nothing. An empty table stays empty.
    """
    rows, own = _apart(docs)
    judged = quality.quality(rows, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least doc_id, of several the one
    stored first; a row without doc_id stays only if no row of its group has one.

    Rows are told apart by their place, not by doc_id, so unlike texts under one id both
    stay, and copies without an id are copies. Texts without words are alike to none and all
    stay. Only rows that may have to go are shuffled. An empty table stays empty.
    """
    place = "_near_dedup_place"
    placed = keep(docs.withColumn(place, F.monotonically_increasing_id()), "placed")
    found = near_dup.near_duplicates(placed.select(F.col(place).alias("doc_id"), "text"))
    ids = placed.select(place, F.col("doc_id").cast("long").alias("own_id"))
    grouped = keep(
        found.select(F.col("doc_id").alias(place), "component_id").join(ids, place), "grouped"
    )
    rank = F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", place)
    first = grouped.groupBy("component_id").agg(
        F.min(rank).getField(place).alias("first"), F.count("*").alias("n")
    )
    several = first.where("n > 1").select("component_id", "first")
    gone = grouped.join(several, "component_id").where(F.col(place) != F.col("first"))
    gone = keep(gone.select(place), "gone")
    flagged = with_flag(
        placed, F.xxhash64(place), gone.select(F.xxhash64(place).alias("key")), "_near_dedup_flag"
    )
    suspects = flagged.where("_near_dedup_flag").join(gone, place, "left_anti")
    return (
        flagged.where("NOT _near_dedup_flag").unionByName(suspects).select(*docs.columns)
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item stands.

    Rows are told apart by doc_id, null too, and text, so repeated rows fare alike; texts
    without words hold no item. Without items, or rows, nothing changes.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any secret span. Each is scanned for itself; null and empty texts, and an
    empty table, have none."""
    rows, own = _apart(docs)
    return secret_scan.scan_secrets(rows).where(F.size("secret_spans") == 0).select(own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their token ids and places in the sequences.

    Repeated rows are packed each for itself, a null doc_id stays null, null and empty texts
    hold the end id alone. An empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("secrets", secret_scans),
    ("packing", pack_sequences),
]

# SQL has no tokenizer and no hashed likelihood ratio; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
