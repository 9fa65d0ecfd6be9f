"""Hashes of an id that come out the same on any engine, partitioning and run."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(id_column: Column | str, seed: int = 42) -> Column:
    """md5 hex text of "seed:id". A null id counts as empty text, so no row is lost."""
    id_column = F.col(id_column) if isinstance(id_column, str) else id_column
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def hash_bucket(id_column: Column | str, buckets: int = 100, seed: int = 42) -> Column:
    """Bucket number 0..buckets-1 from the first 32 bits of the hash."""
    head = F.substring(hash_key(id_column, seed), 1, 8)
    return F.conv(head, 16, 10).cast("long") % buckets
