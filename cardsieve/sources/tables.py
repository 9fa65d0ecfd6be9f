"""Catalog tables as sources, and the namespaces they live in."""

from pyspark.sql import DataFrame, SparkSession


def normalize_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[name.lower() for name in df.columns])


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table with its column names lowered."""
    return normalize_names(spark.read.table(name))


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Create the schema if it is missing; its tables are stored under `location`."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{place}")
    return name


def use_schema(spark: SparkSession, name: str) -> None:
    """Make it the schema that unqualified table names refer to."""
    spark.catalog.setCurrentDatabase(name)


def register_table(spark: SparkSession, name: str, path: str, source: str = "parquet") -> str:
    """Enter files that already exist into the catalog, without rewriting them."""
    spark.catalog.createTable(name, path=path, source=source)
    return name
