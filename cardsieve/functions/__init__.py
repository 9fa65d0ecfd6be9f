"""Column expressions: text parsing, velocity unpacking, stable hashing."""

from cardsieve.functions.hashing import hash_bucket, hash_key
from cardsieve.functions.parsing import (
    parse_bool_lenient,
    parse_bool_strict,
    parse_float,
    parse_int,
)
from cardsieve.functions.velocity import velocity_columns, velocity_struct

__all__ = [
    "hash_bucket",
    "hash_key",
    "parse_bool_lenient",
    "parse_bool_strict",
    "parse_float",
    "parse_int",
    "velocity_columns",
    "velocity_struct",
]
