"""CSV and JSON files, overwriting what was there."""

from pyspark.sql import DataFrame

from cardsieve.sources.csv import DIALECT


def write_csv(
    df: DataFrame,
    path: str,
    files: int | None = None,
    max_records_per_file: int | None = None,
    compression: str | None = None,
) -> str:
    """Write CSV with a header, and return the path.

    Without `files` every task writes its own part and nothing is shuffled; this is the form
    for tables of any size. `max_records_per_file` cuts the parts of a task. With `files` the
    rows are dealt out evenly to exactly that many tasks, so ask for it where the result is
    known to be small, such as a report; the work before stays parallel even for one file.
    `compression` names a codec, such as gzip; a task reads such a file whole, so bound the
    files with `max_records_per_file`.
    """
    if files is not None:
        df = df.repartition(files)
    writer = df.write.mode("overwrite").options(**DIALECT)
    if max_records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Write one JSON object per line, nulls included, and return the path."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
