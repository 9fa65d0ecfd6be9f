"""Catalog tables, replaced in one step.

A table's rows are written to a new table of their own, a version. The name that readers use
is a view of the current version, and one statement points it at the next. Until then, and
if the write fails, readers see the old rows; a job may replace a table that it reads.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from cardsieve.operators.split import SPLIT_COLUMN

# Property of the view that lists the versions, current one first.
_VERSIONS = "cardsieve.versions"


def _named(columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}`" for c in columns)


def _beside(name: str, short: str) -> str:
    """A name in the schema of another."""
    schema, dot, _ = name.rpartition(".")
    return f"{schema}{dot}{short}"


def _short(name: str) -> str:
    return name.rpartition(".")[2]


def table_versions(spark: SparkSession, name: str) -> list[str]:
    """The tables that hold the rows of `name` now and held them before, current one first."""
    if not spark.catalog.tableExists(name):
        return []
    found = dict(spark.sql(f"SHOW TBLPROPERTIES {name}").collect()).get(_VERSIONS)
    return [_beside(name, short) for short in found.split(",")] if found else []


def _make_way(spark: SparkSession, name: str) -> str | None:
    """Rename a plain table of that name to a version, and return it."""
    if not spark.catalog.tableExists(name) or table_versions(spark, name):
        return None
    if spark.catalog.getTable(name).tableType == "VIEW":
        raise ValueError(f"{name} is a view that write_table did not make")
    version = _beside(name, f"{_short(name)}__{uuid4().hex}")
    spark.sql(f"ALTER TABLE {name} RENAME TO {version}")
    return version


def write_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    source: str = "parquet",
    partition_by: tuple[str, ...] = (),
    keep_versions: int = 1,
) -> str:
    """Create or replace the table from the rows, and return its name.

    With `path` the files go to a folder below it and outlive the catalog entry. As many
    replaced versions as `keep_versions` stay, for queries that still read them; older ones
    are dropped. Of two writers at one time the later switch wins whole, and the other's
    version may be left for `drop_table`'s caller to find. A plain table of the name, made by
    other means, becomes the first version; the name is gone for that moment only.
    """
    spark = df.sparkSession
    version = _beside(name, f"{_short(name)}__{uuid4().hex}")
    writer = df.write.format(source)
    if source == "parquet":
        writer = writer.option("compression", "zstd")
    if path is not None:
        writer = writer.option("path", f"{path.rstrip('/')}/{_short(version)}")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(version)
        columns = _named(spark.table(version).columns)
        plain = _make_way(spark, name)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    before = [plain] if plain else table_versions(spark, name)
    listed = ",".join(_short(v) for v in [version, *before[:keep_versions]])
    try:
        spark.sql(
            f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{_VERSIONS}' = '{listed}')"
            f" AS SELECT {columns} FROM {version}"
        )
    except Exception:
        if plain:
            spark.sql(f"ALTER TABLE {plain} RENAME TO {name}")
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    for old in before[keep_versions:]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return name


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a table that `write_table` made, with all its versions."""
    versions = table_versions(spark, name)
    if versions:
        spark.sql(f"DROP VIEW IF EXISTS {name}")
    for version in versions:
        spark.sql(f"DROP TABLE IF EXISTS {version}")


def write_split_tables(labelled: DataFrame, name: str, path: str | None = None) -> tuple[str, str]:
    """Write labelled features once, partitioned by label, with a view per side.

    Returns the view names; reading one only touches its own partition. The views stand in
    the catalog beside the table and read it by name, so one step replaces all three.
    """
    write_table(labelled, name, path, partition_by=(SPLIT_COLUMN,))
    columns = _named([c for c in labelled.columns if c != SPLIT_COLUMN])
    for side in ("train", "test"):
        labelled.sparkSession.sql(
            f"CREATE OR REPLACE VIEW {name}_{side} AS"
            f" SELECT {columns} FROM {name} WHERE {SPLIT_COLUMN} = '{side}'"
        )
    return f"{name}_train", f"{name}_test"
