"""Named data sets: a size tier stands for a file or a catalog table."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cardsieve.schema import RAW_SCHEMA, as_text
from cardsieve.sources.csv import READ_DIALECT, scan_typed
from cardsieve.sources.tables import scan_table

# The size tiers and the one taken when none is named.
TIERS = ("small", "500k", "1mio", "medium", "big")
DEFAULT_TIER = "small"


@dataclass(frozen=True)
class CsvSource:
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return scan_typed(spark, self.path)

    def columns(self, spark: SparkSession) -> StructType:
        """Names from the header line; a file gives no types."""
        return spark.read.options(**READ_DIALECT).csv(self.path).schema


@dataclass(frozen=True)
class TableSource:
    name: str

    def read(self, spark: SparkSession) -> DataFrame:
        return scan_table(spark, self.name)

    def columns(self, spark: SparkSession) -> StructType:
        return scan_table(spark, self.name).schema


Registry = Mapping[str, CsvSource | TableSource]


def csv_registry(folder: str, file_names: Mapping[str, str]) -> Registry:
    """Tier to CSV file under one folder."""
    return {tier: CsvSource(f"{folder}/{name}") for tier, name in file_names.items()}


def table_registry(schema: str, table_names: Mapping[str, str]) -> Registry:
    """Tier to table in one schema."""
    return {tier: TableSource(f"{schema}.{name}") for tier, name in table_names.items()}


def check_registry(
    spark: SparkSession,
    registry: Registry,
    schema: StructType = RAW_SCHEMA,
    tiers: tuple[str, ...] = TIERS,
) -> Registry:
    """The registry, if every tier is there and has the record's columns; no row is read.

    A file must have the names in its header, in order, a table the names and types in any
    order. What is missing, unknown, unreadable or unlike is named, all of it at once.
    """
    faults = [f"{tier}: not registered" for tier in tiers if tier not in registry]
    for tier, source in registry.items():
        if tier not in tiers:
            faults.append(f"{tier}: unknown, expected one of {list(tiers)}")
            continue
        try:
            found = source.columns(spark)
        except AnalysisException as missing:
            faults.append(f"{tier}: cannot be read, {missing.getCondition()}")
            continue
        if isinstance(source, CsvSource):
            found, wanted = found.names, as_text(schema).names
            differ = [f"{a} for {b}" for a, b in zip(found, wanted) if a != b]
            if len(found) != len(wanted):
                differ.append(f"{len(found)} columns for {len(wanted)}")
        else:
            own = {f.name: f.dataType.simpleString() for f in found}
            differ = [
                f"{f.name} {own.get(f.name, 'missing')} for {f.dataType.simpleString()}"
                for f in schema
                if own.get(f.name) != f.dataType.simpleString()
            ]
        if differ:
            faults.append(f"{tier}: {', '.join(differ)}")
    if faults:
        raise ValueError("; ".join(faults))
    return registry


def read_dataset(spark: SparkSession, registry: Registry, tier: str | None = None) -> DataFrame:
    """Read the tier, in any letter case; an unknown one is an error."""
    tier = (tier or DEFAULT_TIER).lower()
    if tier not in registry:
        raise KeyError(f"unknown data size {tier!r}, expected one of {sorted(registry)}")
    return registry[tier].read(spark)
