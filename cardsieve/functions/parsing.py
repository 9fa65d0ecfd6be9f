"""Text cells to typed values. A cell that does not parse becomes null, never an error.

Everything is a built-in Spark expression, so the work stays on the executors and
inside generated code; `try_cast` keeps it safe under ANSI mode.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only spellings the strict reading accepts.
TRUE_WORDS = ("true", "True")
FALSE_WORDS = ("false", "False")

_SPACES = " \t\n\r\f\v"
_PAD = r"[ \t\n\r\f\x0B]*"

# Text that counts as a number: decimal digits with optional sign, point and exponent, or
# one of the special float words. Keeps out forms only Java reads, such as "1.5d".
_WHOLE = rf"^{_PAD}[+-]?[0-9]+{_PAD}$"
_DECIMAL = rf"^{_PAD}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{_PAD}$"
_SPECIAL = rf"(?i)^{_PAD}[+-]?(nan|inf|infinity){_PAD}$"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _number(text: Column, pattern: str, to: str) -> Column:
    """A cast for text of the given form; a lone underscore between digits is skipped.

    The test comes first because a failing cast is far dearer than the test, and plain
    numbers are through after it.
    """
    ungrouped = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(text.rlike(pattern), _stripped(text).try_cast(to)).when(
        F.contains(text, F.lit("_")),
        F.when(ungrouped.rlike(pattern), _stripped(ungrouped).try_cast(to)),
    )


def parse_bool_strict(text: Column) -> Column:
    """Boolean from the closed word list; anything else is null."""
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def parse_bool_lenient(text: Column) -> Column:
    """Boolean where "true" in any case and padding is true, empty is null, the rest false."""
    return F.when(text != "", F.lower(_stripped(text)) == "true")


def parse_int(text: Column, to: str = "int") -> Column:
    """Whole number from text; "5.0", words and values out of range are null."""
    return _number(text, _WHOLE, to)


def parse_float(text: Column) -> Column:
    """Double from text, exponents and nan / inf included."""
    special = F.when(text.rlike(_SPECIAL), _stripped(text).try_cast("double"))
    return F.coalesce(_number(text, _DECIMAL, "double"), special)
