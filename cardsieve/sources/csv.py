"""CSV scans. Each one stays splittable, so a large file is read by many tasks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cardsieve.operators.ingest import type_columns
from cardsieve.schema import RAW_SCHEMA, as_text

# One dialect for reading and writing: header row, comma, optional double quotes, and a
# doubled quote inside a quoted field.
DIALECT = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    # Spark's writer trims cells unless told not to.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# An empty cell is null and a pair of quotes is empty text. The reader takes both for null
# unless its word for null is one that no cell holds.
READ_DIALECT = DIALECT | {"nullValue": "\0"}


def scan_typed(
    spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Scan with a fixed schema. Bad cells become null.

    Spark matches columns by position; `enforceSchema` off makes it also compare the header
    of every file with the schema and fail on a mismatch instead of mixing up columns.
    `multi_line` is for texts with line breaks: a task then reads whole files, so write them
    with `max_records_per_file`.
    """
    reader = spark.read.options(**READ_DIALECT).option("enforceSchema", False)
    return reader.option("multiLine", multi_line).schema(schema).csv(path)


def scan_text(
    spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Scan with every column as text, header checked."""
    return scan_typed(spark, path, as_text(schema), multi_line)


def scan_overrides(
    spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA
) -> DataFrame:
    """Scan as text, then type each column; booleans only from the closed word list."""
    return type_columns(scan_text(spark, path, schema), schema, lenient=False)


def scan_inferred(
    spark: SparkSession, path: str, sampling_ratio: float | None = None
) -> DataFrame:
    """Scan with types found from the data.

    Costs one more pass over the whole input; `sampling_ratio` shortens that pass at the
    risk of a type that later rows do not fit. No row is left out of the result either way.
    """
    reader = spark.read.options(**READ_DIALECT).option("inferSchema", True)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.csv(path)


def scan_positional(
    spark: SparkSession, path: str, names: list[str] | None = None
) -> DataFrame:
    """Skip the header whatever it says and name the text columns by position."""
    names = list(names or RAW_SCHEMA.names)
    positions = ", ".join(f"_{place} STRING" for place in range(1, len(names) + 1))
    return spark.read.options(**READ_DIALECT).schema(positions).csv(path).toDF(*names)
