"""The ledger of rejected cells: text that a typed scan or a typing step could not read."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cardsieve.operators.ingest import type_columns
from cardsieve.schema import RAW_SCHEMA, as_text
from cardsieve.sources.csv import READ_DIALECT

_RECORD, _UNEVEN = "_record", "_uneven"


def _cells(schema: StructType, typed: str, text: str) -> Column:
    """One struct for each cell of a typed column that is null although its text is not."""
    found = [
        F.when(
            F.col(f"{typed}`{field.name}`").isNull(),
            F.struct(
                F.lit(field.name).alias("column_name"), F.col(f"{text}`{field.name}`").alias("cell")
            ),
        )
        for field in schema
        if not isinstance(field.dataType, StringType)
    ]
    return F.filter(F.array(*found), lambda c: c.cell.isNotNull() & (c.cell != ""))


def rejected_cells(
    spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """(file, record, column_name, cell) for what `scan_typed` makes null or leaves out.

    Spark hands over the text of each record that it could not read whole; that text is cut
    into cells again, and those that hold text where the typed value is null are listed. A
    record with too many or too few cells is listed once more, with neither column nor cell.
    One scan, no shuffle, and good records are dropped as soon as they are read.
    """
    wide = StructType([*schema.fields]).add(_RECORD, "string")
    rows = (
        spark.read.options(**READ_DIALECT)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", _RECORD)
        # A cell counts even if no column of it is asked for.
        .option("columnPruning", False)
        .schema(wide)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
        .where(F.col(_RECORD).isNotNull())
    )
    again = READ_DIALECT | {"header": "false", "columnNameOfCorruptRecord": _UNEVEN}
    text = ", ".join(f"`{name}` STRING" for name in [*schema.names, _UNEVEN])
    # Text columns take any cell, so only the number of cells can be wrong here.
    cut = rows.withColumn("_text", F.from_csv(_RECORD, text, again))
    uneven = F.when(
        F.col(f"_text.{_UNEVEN}").isNotNull(),
        F.array(
            F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("cell"))
        ),
    ).otherwise(F.array().cast("array<struct<column_name: string, cell: string>>"))
    found = F.concat(_cells(schema, "", "_text."), uneven)
    return cut.select(
        F.col("_file").alias("file"), F.col(_RECORD).alias("record"), F.inline(found)
    )


def rejected_by_typing(
    df: DataFrame,
    schema: StructType = RAW_SCHEMA,
    lenient: bool = False,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """(*keys, column_name, cell) for the text cells that `type_columns` makes null.

    A lenient boolean takes any text, so it rejects none. Empty text is no rejected cell.
    """
    text = df.select(F.struct(*as_text(schema).names).alias("_text"))
    both = type_columns(text.select("_text", "_text.*"), schema, lenient, keep=("_text",))
    key_columns = [F.col(f"_text.`{key}`").alias(key) for key in keys]
    return both.select(*key_columns, F.inline(_cells(schema, "", "_text.")))
