"""Train / test splits: by hash, at random, of exact size, or only estimated.

The hash split is the one to use at scale: it decides each row on its own, needs no
shuffle, and gives the same answer on every run and partitioning.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardsieve.functions.hashing import hash_bucket, hash_key
from cardsieve.operators.copies import content_hash, content_key, key_marks, repeat_rows
from cardsieve.operators.packed import pack_texts, unpack_texts
from cardsieve.operators.ranged import deal_by_range, is_plain
from cardsieve.schema import ID_COLUMN
from cardsieve.scratch import store

SPLIT_COLUMN = "split"
SEED = 42
TRAIN_PERCENT = 75

# Hex digits of the hash told apart in one histogram: 16**3 = 4096 counts at most, few
# enough for each task to combine its rows into and for the driver to read.
_DIGITS = 3

# Ranks use one digit more, so that one prefix of a very large table still fits a task.
_RANK_DIGITS = 4

# Spark numbers the rows of a task in the lower 33 bits of its row ids.
_ROWS_PER_TASK = 1 << 33

# Ids up to which a join with them needs no bit maps: so few are broadcast, or shuffled cheaply.
_FEW_IDS = 1 << 16

_PLACE = "_place"
_CONTENT = "_content"


def _label(is_train: Column) -> Column:
    return F.when(is_train, "train").otherwise("test").alias(SPLIT_COLUMN)


# --- by hash -------------------------------------------------------------------------


def is_train(
    id_column: str = ID_COLUMN, train_percent: int = TRAIN_PERCENT, seed: int = SEED
) -> Column:
    """Whether the id falls on the train side. Never null; equal ids fall on one side."""
    return hash_bucket(id_column, 100, seed) < train_percent


def with_split(
    df: DataFrame,
    id_column: str = ID_COLUMN,
    train_percent: int = TRAIN_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Add the split label. Do this before the id is dropped."""
    return df.withColumn(SPLIT_COLUMN, _label(is_train(id_column, train_percent, seed)))


def hash_split(
    df: DataFrame,
    id_column: str = ID_COLUMN,
    train_percent: int = TRAIN_PERCENT,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) as two filters that exclude each other."""
    mask = is_train(id_column, train_percent, seed)
    return df.where(mask), df.where(~mask)


def _outside(df: DataFrame, taken: DataFrame, id_column: str, how: str) -> DataFrame:
    """Rows whose id is not taken; null is compared as a value. `taken` holds an id once."""
    ids = taken.select(F.col(id_column).alias("_taken"), F.lit(True).alias("_found"))
    joined = df.join(ids, df[id_column].eqNullSafe(ids["_taken"]), how)
    return joined if how == "left_anti" else joined.where("_found IS NULL").drop("_taken", "_found")


def without_ids(df: DataFrame, part: DataFrame, id_column: str = ID_COLUMN) -> DataFrame:
    """Rows of `df` whose id is not in `part`, for tables where an id is one row.

    The comparison treats null as a value: a null id in `part` removes the null ids. Of both
    sides only the ids are shuffled, and each is stored once, so a frequent id is one row. Bit
    maps of the ids then say of most rows that they stay or go; only rows whose id shares a
    bit with one that fares otherwise are joined with the ids taken. Where ids are few, or of
    another type in `part`, all rows are. `df` is read for the ids and again for its rows, so
    it must hold the same rows each time.
    """
    ids = part.select(F.col(id_column))
    if ids.schema[0].dataType != df.select(F.col(id_column)).schema[0].dataType:
        return _outside(df, ids.distinct(), id_column, "left_anti")
    known = store(
        df.select(F.col(id_column), F.lit(False).alias("_gone"))
        .unionByName(ids.withColumn("_gone", F.lit(True)))
        .groupBy(id_column)
        .agg(F.bool_or("_gone").alias("_gone"), F.bool_and("_gone").alias("_alien"))
        .where("NOT _alien")
        .drop("_alien"),
        "known-ids",
    )
    gone = known.where("_gone").select(F.col(id_column))
    if known.count() <= _FEW_IDS:
        return _outside(df, gone, id_column, "left_anti")
    marked = key_marks(known, id_column, {"_stays": ~F.col("_gone"), "_goes": F.col("_gone")})
    rows, named = marked(df), [F.col(f"`{c}`") for c in df.columns]
    unsure = rows.where("_stays AND _goes").select(*named)
    rivals = marked(gone).where("_stays AND _goes")
    # Catalyst would move an anti join below the marks, and shuffle all rows again.
    return rows.where("NOT _goes").select(*named).unionByName(
        _outside(unsure, rivals, id_column, "left")
    )


def complement(df: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of `df` that `part` did not take: copies count, and no id is needed.

    `part` holds rows of `df`, so together they are `df` again, each row as often as before.
    Rows are told apart by all their content; rows of `part` that `df` lacks count for
    nothing. Both sides are counted by a hash of the content, so no row is moved for that.
    Bit maps of the hashes then say of nearly every row that all its copies stay or none do;
    only the others are brought together with their counts. `df` is read for the counts and
    again for its rows, so it must hold the same rows each time.
    """
    columns = df.columns
    named = [F.col(f"`{c}`") for c in columns]
    key = content_key(columns).alias("_key")
    taken = part.select(*named).select(key, F.lit(-1).alias("_n"))
    counted = store(
        df.select(key, F.lit(1).alias("_n"))
        .unionByName(taken)
        .groupBy("_key")
        .agg(F.sum("_n").alias("_n"), F.count_if(F.col("_n") > 0).alias("_copies"))
        .where("_copies > 0"),
        "complement-keys",
    )
    stays, goes = F.col("_n") > 0, F.col("_n") < F.col("_copies")
    marked = key_marks(counted, "_key", {"_stays": stays, "_goes": goes})

    rows = marked(df.select(key, F.struct(*named).alias("_row")))
    all_stay = rows.where("_stays AND NOT _goes").select("_row.*")
    unsure = (
        marked(counted.where(stays).select("_key", "_n"))
        .where("_stays AND _goes")
        .unionByName(rows.where("_stays AND _goes"), allowMissingColumns=True)
        .groupBy("_key")
        .agg(F.sum("_n").alias("_n"), F.first("_row", ignorenulls=True).alias("_row"))
        .where("_n > 0")
    )
    return all_stay.unionByName(repeat_rows(unsure.select("_n", "_row"), "_n").select("_row.*"))


# --- at random -----------------------------------------------------------------------


def placed_rows(df: DataFrame, name: str = "placed") -> DataFrame:
    """The rows stored once, with the place in which they were stored.

    The place is the task's number and the row's number in it. What is drawn from it stays
    the same for a row, whatever becomes of the stored frame's partitions.
    """
    return store(df.withColumn(_PLACE, F.monotonically_increasing_id()), name)


def random_side(weights: tuple[float, ...], seed: int = SEED) -> Column:
    """Which side the row of a place falls on, from 0: a draw from a counter, the place."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("side"), F.col(_PLACE)), 11)
    draw, upto = bits / float(1 << 53), 0.0
    side = F.lit(len(weights) - 1)
    for place in range(len(weights) - 2, -1, -1):
        upto = sum(weights[: place + 1]) / sum(weights)
        side = F.when(draw < upto, place).otherwise(side)
    return side


def random_split(
    df: DataFrame, weights: tuple[float, ...] = (0.75, 0.25), seed: int = SEED
) -> list[DataFrame]:
    """Sides drawn at random in the ratio of the weights; each row falls on exactly one.

    The rows are stored once and then labelled by their place, without a sort or a shuffle.
    Every side is a filter over the same stored rows, so they exclude each other and are
    complete. Another run draws alike if its rows come in the same order; prefer `hash_split`
    where the result must repeat on any partitioning.
    """
    if not weights or min(weights) < 0 or not sum(weights):
        raise ValueError("weights are not negative and not all zero")
    placed = placed_rows(df, "random-split")
    side, columns = random_side(weights, seed), [F.col(f"`{c}`") for c in df.columns]
    return [placed.where(side == i).select(*columns) for i in range(len(weights))]


def random_filter(df: DataFrame, fraction: float = 0.75, seed: int = SEED) -> DataFrame:
    """Keep each row with the given chance."""
    return df.where(F.rand(seed) < fraction)


# --- of exact size -------------------------------------------------------------------


def _nth_smallest(
    texts: DataFrame, nth: Callable[[int], int]
) -> tuple[str, int, int] | None:
    """(value, rows of it to take, rows equal to it) for the nth smallest text of a column.

    `nth` gives the wanted place from the number of rows; None when that is no place.
    Selection by prefix counts instead of a sort: each step counts rows per next three hex
    digits, at most 4096 counts, and goes on inside the one prefix that holds the nth row.
    After the first step only that prefix is left, with its repeats already combined.
    """

    def counts(df: DataFrame, rows: Column, length: int) -> list:
        found = (
            df.groupBy(F.substring("text", 1, length).alias("prefix"))
            .agg(rows.alias("n"), F.min("text").alias("low"), F.max("text").alias("high"))
            .collect()
        )
        return sorted(found, key=lambda step: step.prefix)

    texts = texts.toDF("text")
    length, found = _DIGITS, counts(texts, F.count("*"), _DIGITS)
    wanted = nth(sum(step.n for step in found))
    if wanted < 1:
        return None
    kept = None
    try:
        while True:
            for step in found:
                if wanted <= step.n:
                    break
                wanted -= step.n
            if step.low == step.high:
                return step.low, wanted, step.n
            inside = F.col("text").startswith(step.prefix)
            if kept is None:
                texts = texts.where(inside).groupBy("text").agg(F.count("*").alias("n"))
                kept = store(texts, "split-keys")
            length += _DIGITS
            found = counts(kept.where(inside), F.sum("n"), length)
    finally:
        if kept is not None:
            kept.unpersist()


def exact_split(
    df: DataFrame, id_column: str = ID_COLUMN, fraction: float = 0.75, seed: int = SEED
) -> DataFrame:
    """Add a split label so that exactly int(rows * fraction) rows are train.

    Rows are taken in the order of their hashed id, then of their hashed content. The last
    train row is found by selection and every other row only compares itself with it: no
    sort and no row number over the whole table. Only where whole-row copies straddle the
    cut are those copies numbered.
    """
    key = hash_key(id_column, seed)
    found = _nth_smallest(df.select(key), lambda rows: int(rows * fraction))
    if found is None:
        return df.withColumn(SPLIT_COLUMN, F.lit("test"))
    cut, wanted, equal = found
    if wanted == equal:
        return df.withColumn(SPLIT_COLUMN, _label(key <= cut))

    # The cut is inside one id: order its rows by content.
    content = F.hex(content_key(df.columns))
    last, wanted, equal = _nth_smallest(df.where(key == cut).select(content), lambda _: wanted)
    at_cut = (key == cut) & (content == last)
    before = (key < cut) | ((key == cut) & (content < last))
    if wanted == equal:
        return df.withColumn(SPLIT_COLUMN, _label(before | at_cut))

    copies = with_row_index(df.where(at_cut), "_copy")
    return (
        df.where(~at_cut)
        .withColumn(SPLIT_COLUMN, _label(before))
        .unionByName(
            copies.withColumn(SPLIT_COLUMN, _label(F.col("_copy") < wanted)).drop("_copy")
        )
    )


def split_parts(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) of a labelled frame, without the label."""
    return tuple(
        labelled.where(F.col(SPLIT_COLUMN) == side).drop(SPLIT_COLUMN)
        for side in ("train", "test")
    )


# --- row index and shuffled order ------------------------------------------------------------------


def with_row_index(df: DataFrame, name: str = "_idx") -> DataFrame:
    """Add a dense number 0, 1, 2 and so on in the order the frame has.

    Each row is stored with its task and its place there, once, so that both stay as they are;
    the rows of all tasks before are then added, from a table of one row per task. Nothing is
    shuffled beyond what the frame itself needs.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_PER_TASK - 1))
    placed = store(
        df.withColumn("_task", F.spark_partition_id()).withColumn("_place", place), "row-index"
    )
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before")
    )
    return placed.join(F.broadcast(before), "_task").select(
        *df.columns, (F.col("_before") + F.col("_place")).alias(name)
    )


def shuffle_rank(df: DataFrame, id_column: str = ID_COLUMN, seed: int = SEED) -> DataFrame:
    """(id, copies, first_rank): the places each id takes in the seeded shuffle of all rows.

    Ids are counted first, so a frequent one is a single row. Ranks are dense over the whole
    table, yet no task sees more than one hash prefix: it adds the running count inside its
    prefix to the count of all prefixes before, a table of at most 65536 rows.
    """
    ids = (
        df.groupBy(id_column)
        .agg(F.count("*").alias("copies"))
        .withColumn("_key", hash_key(id_column, seed))
        .withColumn("_prefix", F.substring("_key", 1, _RANK_DIGITS))
    )
    sizes = ids.groupBy("_prefix").agg(F.sum("copies").alias("_n"))
    before = sizes.select(
        "_prefix",
        (F.sum("_n").over(Window.orderBy("_prefix")) - F.col("_n")).alias("_before"),
    )
    inside = Window.partitionBy("_prefix").orderBy("_key", id_column)
    upto = F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return ids.join(F.broadcast(before), "_prefix").select(
        id_column, "copies", (F.col("_before") + upto - F.col("copies") + 1).alias("first_rank")
    )


def seeded_shuffle(
    df: DataFrame,
    id_column: str = ID_COLUMN,
    seed: int = SEED,
    columns: Sequence[str] | None = None,
    stored: bool = True,
) -> DataFrame:
    """All rows in an order that looks random and is the same on every run.

    A range-partitioned sort on the hashed id, then on content; it is the only shuffle of the
    rows, for which they are packed column by column, or only their texts where a column is
    nested. They are stored first, and their places come last in the order: whole-row copies
    are told apart by them, so that the sort can cut between any two rows. Which of two copies
    comes first does not show. Values come back as they were, -0.0 and NaN too.

    Frames read from files need not be `stored`: they are read again instead, and the sort
    can cut between copies of different tasks. A task's number stays with its rows when it is
    run again, in whatever order they come then.

    Of the order of whole rows, `columns` names those to return. Only these, the id and a
    hash of the content are then stored and shuffled.
    """
    returned, keep = list(df.columns if columns is None else columns), (id_column,)
    whole = pack_texts(df.schema, keep)
    content = content_hash(whole)
    if columns is not None:
        kept = [F.col(f"`{c}`") for c in dict.fromkeys([*columns, id_column])]
        df = df.select(*kept, content.alias(_CONTENT))
        content = F.col(_CONTENT)
    if stored:
        placed = placed_rows(df, "shuffle")
    else:
        placed = df.withColumn(_PLACE, F.spark_partition_id())
    hashed = hash_key(id_column, seed)
    if is_plain(placed.schema):
        # A null id and an empty one have one hash.
        tail = F.concat(
            F.unhex(F.when(F.col(id_column).isNull(), "00").otherwise("01")),
            content,
            F.unhex(F.lpad(F.hex(F.col(_PLACE).cast("long")), 16, "0")),
        )
        dealt = deal_by_range(placed, F.unhex(hashed), tail)
        ordered = dealt.sortWithinPartitions(hashed, id_column, content, _PLACE)
    else:
        if columns is None:
            content = content_key(df.select(*whole).columns)
        packed = placed.select(*pack_texts(placed.schema, keep))
        ordered = unpack_texts(
            packed.orderBy(hashed, id_column, content, _PLACE), placed.schema, keep
        )
    return ordered.select(*[F.col(f"`{c}`") for c in returned])


# --- sizes ---------------------------------------------------------------------------


def split_report(labelled: DataFrame) -> DataFrame:
    """Rows and share of the total, in percent to one decimal, of each side."""
    train = F.count_if(F.col(SPLIT_COLUMN) == "train")
    sides = labelled.agg(train.alias("train"), (F.count("*") - train).alias("test"))
    total = F.col("train") + F.col("test")
    return sides.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(side).alias(SPLIT_COLUMN),
                        F.col(side).alias("n_rows"),
                        F.round(F.try_divide(F.col(side), total) * 100, 1).alias("share_pct"),
                    )
                    for side in ("train", "test")
                ]
            )
        )
    )


def split_estimate(df: DataFrame, fraction: float = 0.75) -> DataFrame:
    """Split sizes to expect, from one row count; nothing is split."""
    return estimate_from(df.agg(F.count("*").alias("total_rows")), fraction)


def estimate_from(total: DataFrame, fraction: float = 0.75) -> DataFrame:
    """Split sizes to expect from a known number of rows, such as `stored_rows` gives."""
    train = F.floor(F.col("total_rows") * fraction)
    return total.select(
        "total_rows",
        train.alias("train_estimate"),
        (F.col("total_rows") - train).alias("test_estimate"),
    )
