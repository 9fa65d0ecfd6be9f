"""From the raw record to model features, as one projection."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cardsieve.functions.parsing import parse_bool_strict
from cardsieve.functions.velocity import velocity_columns, velocity_struct
from cardsieve.schema import FLAG_COLUMNS, IDENTIFIER_COLUMNS, VELOCITY_COLUMN

_STRUCT = "_velocity"


def _flag(df: DataFrame, name: str) -> Column:
    """0/1 from a boolean, or from text by way of a boolean."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, StringType):
        column = parse_bool_strict(column)
    return column.cast("int").alias(name)


def drop_identifiers(df: DataFrame, names: Iterable[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """Remove the identifying columns that are there; absent names do not matter."""
    return df.drop(*names)


def cast_flags(df: DataFrame, names: Iterable[str] = FLAG_COLUMNS) -> DataFrame:
    """Turn the flags that are there into 0/1 integers, in place."""
    return df.withColumns({name: _flag(df, name) for name in names if name in df.columns})


def extract_velocity(df: DataFrame, requote: bool = True) -> DataFrame:
    """Replace the velocity text by its five numbers, appended on the right."""
    return (
        df.withColumn(_STRUCT, velocity_struct(VELOCITY_COLUMN, requote))
        .withColumns(velocity_columns(F.col(_STRUCT), VELOCITY_COLUMN, requote))
        .drop(VELOCITY_COLUMN, _STRUCT)
    )


def engineer_features(df: DataFrame, requote: bool = True) -> DataFrame:
    """Raw record to features: velocity unpacked, identifiers dropped, flags as integers.

    Columns that the raw record does not have, such as a split label, stay as they are.
    """
    return cast_flags(drop_identifiers(extract_velocity(df, requote)))
