"""Unpacks the velocity text, a dict printed with single quotes, into numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardsieve.schema import VELOCITY_COLUMN, VELOCITY_TYPES

_AS_NUMBERS = ", ".join(f"{key} DOUBLE" for key in VELOCITY_TYPES)


def _json(text: Column | str, requote: bool) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.replace(text, F.lit("'"), F.lit('"')) if requote else text


def velocity_struct(text: Column | str = VELOCITY_COLUMN, requote: bool = True) -> Column:
    """The five keys as doubles, from one parse per row.

    `from_json` reads the text once for all keys, and Catalyst narrows its schema to the
    keys a query uses; five separate path lookups would parse it five times.
    With `requote` every single quote is made a double quote first, so an apostrophe
    inside a value spoils the whole text. Without it the parser takes the single-quoted
    form as it is, and a double-quoted value may hold an apostrophe.
    """
    return F.from_json(_json(text, requote), _AS_NUMBERS, {"allowNonNumericNumbers": "false"})


def velocity_columns(
    struct: Column, text: Column | str = VELOCITY_COLUMN, requote: bool = True
) -> dict[str, Column]:
    """Output name to typed expression, over the struct made by `velocity_struct`.

    A number printed as a string is no double to the parser. Where a key came out null it is
    looked up once more as text, which costs nothing for the rows that have all their keys.
    Whole numbers go through double: "3.0" is 3 and "3.7" is cut to 3.
    """
    columns = {}
    for key, to in VELOCITY_TYPES.items():
        as_text = F.get_json_object(_json(text, requote), f"$.{key}")
        number = F.coalesce(struct.getField(key), as_text.try_cast("double"))
        columns[f"velocity_{key}"] = number if to == "double" else number.try_cast(to)
    return columns
