"""Packs the texts of a row into one, as a shuffle moves them in fewer bytes then."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_TEXTS, _LOOSE, _CELLS = "_texts", "_loose", "_cells"

# Bytes from which on a text is not packed: JSON readers refuse very long ones.
_LONG = 1 << 20


def _texts(schema: StructType, keep: Sequence[str]) -> list[str]:
    """The columns to pack; one alone gains nothing."""
    names = [f.name for f in schema if f.dataType == StringType() and f.name not in keep]
    return names if len(names) > 1 else []


def pack_texts(schema: StructType, keep: Sequence[str] = ()) -> list[Column]:
    """The columns of a frame with its texts as one JSON array, but for those to keep.

    A row with a long text, or with bytes that JSON would not give back, has its texts loose.
    """
    names = _texts(schema, keep)
    others = [F.col(f"`{f.name}`") for f in schema if f.name not in names]
    if not names:
        return others
    texts = [F.col(f"`{c}`") for c in names]
    fits = reduce(
        Column.__and__,
        [F.coalesce(F.is_valid_utf8(c) & (F.octet_length(c) < _LONG), F.lit(True)) for c in texts],
    )
    return [
        *others,
        F.when(fits, F.to_json(F.array(*texts))).alias(_TEXTS),
        F.when(~fits, F.struct(*texts)).alias(_LOOSE),
    ]


def unpack_texts(df: DataFrame, schema: StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of `schema` again, from a frame of what `pack_texts` made of them."""
    names = _texts(schema, keep)
    if not names:
        return df.select(*[F.col(f"`{c}`") for c in schema.names])
    cells = F.from_json(_TEXTS, "array<string>", {"mode": "FAILFAST"})
    found = {
        c: F.coalesce(F.get(F.col(_CELLS), F.lit(i)), F.col(f"{_LOOSE}.`{c}`")).alias(c)
        for i, c in enumerate(names)
    }
    return df.withColumn(_CELLS, cells).select(
        *[found.get(c, F.col(f"`{c}`")) for c in schema.names]
    )
