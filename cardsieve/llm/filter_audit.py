"""What each filter removes under every order in which the filters could run.

Each document fails some of the filters. Documents that fail the same ones form a cell of
their part, and only the cells' weights are carried on. Every cell is folded over the
broadcast array of all orders: a filter removes the cell if no filter before it has. That
gives a struct of weights for each order and step; the structs of a part's cells, of which
there are at most two to the number of filters, are merged by sums, element by element.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import keep

# The filters of the contract and their characters.
FILTERS = "ABCDE"
_SYMBOLS = "[#$%&*|]"
_WHITE = "\t\n\x0b\x0c\r"

_SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_FOLD = """
flatten(transform(orders, o -> aggregate(
    o,
    named_struct('alive', true, 'steps', CAST(array() AS ARRAY<STRUCT<
        filter: INT, kept: BIGINT, removed: BIGINT, redundant: BIGINT,
        unique_fails: BIGINT, good_lost: BIGINT, toxic_lost: BIGINT>>)),
    (held, f) -> named_struct(
        'alive', held.alive AND NOT fails[f],
        'steps', concat(held.steps, array(named_struct(
            'filter', f,
            'kept', IF(held.alive AND NOT fails[f], n, 0L),
            'removed', IF(held.alive AND fails[f], n, 0L),
            'redundant', IF(NOT held.alive AND fails[f], n, 0L),
            'unique_fails', IF(fails[f] AND n_fails = 1, n, 0L),
            'good_lost', IF(held.alive AND fails[f], n_good, 0L),
            'toxic_lost', IF(held.alive AND fails[f], n_toxic, 0L))))),
    held -> held.steps)))
"""
_PLUS = ", ".join(f"'{c}', x.{c} + y.{c}" for c in _SUMS)
_MERGE = f"""
aggregate(slice(folded, 2, size(folded)), folded[0],
    (sums, cell) -> zip_with(sums, cell, (x, y) -> named_struct('filter', x.filter, {_PLUS})))
"""
_SHAPLEY = """
transform(sequence(0, size(orders[0]) - 1), f -> aggregate(
    filter(sums, s -> s.filter = f), 0L, (total, s) -> total + s.removed))
"""


def text_failures(text: Column) -> list[Column]:
    """Whether a text that is not null fails A, B, C and D."""
    words = F.array_remove(F.split(F.translate(text, _WHITE, " " * len(_WHITE)), " "), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        text.rlike(_SYMBOLS),
    ]


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails) of each row: which of A, B, C, D and E its text fails.

    E fails where the text is that of a row with a smaller doc_id, told by SHA-256. Null
    texts are empty ones, a null lang is the empty part. A null doc_id is smaller than none
    and none is smaller than it; rows that repeat a doc_id do not fail E by each other.
    """
    text = F.coalesce("text", F.lit(""))
    marks = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    ).select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.array(*text_failures(F.col("text"))).alias("fails"),
    )
    # Texts are read once; what follows works on these small rows.
    marks = keep(marks, "marks")
    firsts = marks.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return marks.join(firsts.select("digest", "first"), "digest", "left").select(
        "doc_id", "part", F.concat("fails", F.array(later)).alias("fails")
    )


def order_table(spark, n_filters: int) -> DataFrame:
    """One row: the number of filters and all orders of them."""
    orders = [list(order) for order in permutations(range(n_filters))]
    return spark.createDataFrame(
        [(n_filters, orders)], "n_filters int, orders array<array<int>>"
    )


def audit_orders(failed: DataFrame, labels: DataFrame, names: str = FILTERS) -> DataFrame:
    """Per part, filter order and step: what that step's filter keeps, removes and loses.

    `failed` has doc_id, part and fails, an array with a boolean for each filter of `names`;
    the number of orders grows with its factorial, so it suits up to six filters. `labels`
    has doc_id, quality and toxic; a document counts as good or toxic if any label row of
    its doc_id says 1. Labels without doc_id, and those of unknown documents, count for
    nothing. An empty table has no parts and gives no rows.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    ).where("good OR toxic")
    cells = failed.join(marked, "doc_id", "left").groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    orders = order_table(failed.sparkSession, len(names))
    folded = (
        cells.withColumn("n_filters", F.size("fails"))
        .withColumn("n_fails", F.expr("size(filter(fails, f -> f))"))
        .join(F.broadcast(orders), "n_filters")
        .select("part", "n_filters", F.expr(_FOLD).alias("folded"))
    )
    # At most 2 ** filters arrays of one part meet here.
    sums = folded.groupBy("part", "n_filters").agg(F.collect_list("folded").alias("folded"))
    merged = sums.select("part", "n_filters", F.expr(_MERGE).alias("sums")).join(
        F.broadcast(orders), "n_filters"
    )
    letters = F.array(*[F.lit(name) for name in names])
    place, width = F.col("place"), len(names)
    return (
        merged.withColumn("shapley", F.expr(_SHAPLEY))
        .select("part", "orders", "shapley", F.posexplode("sums").alias("place", "sum"))
        .select(
            "part",
            F.array_join(
                F.transform(
                    F.get("orders", F.floor(place / width).cast("int")), lambda f: F.get(letters, f)
                ),
                "",
            ).alias("filter_order"),
            (place % width + 1).cast("int").alias("step"),
            *[F.col(f"sum.{c}").alias(c) for c in _SUMS],
            F.get("shapley", F.col("sum.filter")).alias("shapley"),
        )
    )
