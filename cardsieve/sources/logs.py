"""Run logs as a source: text files, one per run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark numbers the rows of a task in the lower 33 bits of its row ids.
_ROWS_PER_TASK = 1 << 33


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, line_no, value) for every line of the files in a folder and the folders below.

    The run is the file's path below that folder without its ending, so equal file names in
    two folders are two runs; for a single file or a pattern it is the whole path. Files stay
    splittable. A line's place is the start of its block, then its place in the
    task that reads the block, so `line_no` sorts within a run even where one log spans many
    tasks. It is one decimal number, which Spark can aggregate in place.
    """
    block = F.col("_metadata.file_block_start").cast("decimal(20,0)")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_PER_TASK - 1))
    below = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/") + "/", -1)
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.regexp_replace(below, r"\.[^./]*$", "").alias("run"),
        (block * _ROWS_PER_TASK + row).cast("decimal(32,0)").alias("line_no"),
        "value",
    )
