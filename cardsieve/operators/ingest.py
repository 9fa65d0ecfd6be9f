"""Typing of text columns, as column expressions on the executors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

from cardsieve.functions.parsing import (
    parse_bool_lenient,
    parse_bool_strict,
    parse_float,
    parse_int,
)
from cardsieve.schema import RAW_SCHEMA


def type_columns(
    df: DataFrame,
    schema: StructType = RAW_SCHEMA,
    lenient: bool = True,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Give each text column the type the schema names; cells that do not parse are null.
    Columns named by `keep` come first, as they are.

    `lenient` reads any non-empty text as a boolean (false unless it says true); otherwise
    only the closed word list counts and other text is null.
    """
    to_bool = parse_bool_lenient if lenient else parse_bool_strict

    def typed(name: str) -> Column:
        kind, text = schema[name].dataType, F.col(name)
        if isinstance(kind, BooleanType):
            return to_bool(text)
        if isinstance(kind, IntegerType):
            return parse_int(text)
        if isinstance(kind, DoubleType):
            return parse_float(text)
        return text

    return df.select(*keep, *[typed(name).alias(name) for name in schema.names])


def typed_ingest(
    df: DataFrame, schema: StructType = RAW_SCHEMA, on_garbage: str = "false"
) -> DataFrame:
    """All-text rows to the typed record. Empty text is null throughout.

    `on_garbage` says what a flag that is neither true nor false becomes: "false" or "null".
    """
    if on_garbage not in ("false", "null"):
        raise ValueError('on_garbage is "false" or "null"')
    return type_columns(df, schema, lenient=on_garbage == "false")
