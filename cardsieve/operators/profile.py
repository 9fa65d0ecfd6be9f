"""Data quality: nulls per column, schema listing, columns kept and dropped."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardsieve.functions.velocity import velocity_columns, velocity_struct
from cardsieve.schema import VELOCITY_COLUMN


def _nulls(name: str) -> Column:
    return F.count("*") - F.count(F.col(f"`{name}`"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count) for every column, from one pass over the rows."""
    counted = df.agg(*[_nulls(name).alias(name) for name in df.columns])
    return counted.unpivot([], list(df.columns), "column_name", "null_count")


def schema_profile(
    before: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per column: place, type, nullability, nulls, and what became of it.

    With `change`, the audit says which columns it keeps, drops or adds; an added one is
    listed after the others. `change` works row by row and leaves columns alone that it does
    not know: the rows go through it beside a copy of themselves, so that one pass counts
    the nulls on both sides.
    """
    copies = {f"_raw_{name}": F.col(f"`{name}`") for name in before.columns}
    both = before.withColumns(copies)
    if change is not None:
        both = change(both)
    kept = [name for name in both.columns if name not in copies]
    added = [name for name in kept if name not in before.columns]
    fields = [
        (field, "kept" if field.name in kept else "dropped") for field in before.schema.fields
    ] + [(both.schema[name], "added") for name in added]
    listing = before.sparkSession.createDataFrame(
        [
            (place, field.name, field.dataType.simpleString(), field.nullable, status)
            for place, (field, status) in enumerate(fields, 1)
        ],
        "position INT, column_name STRING, data_type STRING, nullable BOOLEAN, status STRING",
    )
    nulls = null_counts(
        both.select(
            *[F.col(f"`_raw_{name}`").alias(name) for name in before.columns],
            *[F.col(f"`{name}`") for name in added],
        )
    )
    # The listing has one row per column, so it is always small enough to broadcast.
    return nulls.join(F.broadcast(listing), "column_name").select(
        "position", "column_name", "data_type", "nullable", "null_count", "status"
    )


def velocity_quality(df: DataFrame, requote: bool = True) -> DataFrame:
    """How many velocity texts are missing, and how many yield none of the known numbers."""
    numbers = velocity_columns(F.col("_velocity"), VELOCITY_COLUMN, requote)
    found = F.coalesce(*[number.cast("double") for number in numbers.values()])
    return df.withColumn("_velocity", velocity_struct(VELOCITY_COLUMN, requote)).agg(
        F.count("*").alias("total_rows"),
        (F.count("*") - F.count(VELOCITY_COLUMN)).alias("missing"),
        (F.count(VELOCITY_COLUMN) - F.count(found)).alias("unreadable"),
    )
