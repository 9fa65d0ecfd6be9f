"""Where intermediate tables go: a folder every executor can reach."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# A Spark setting: whether a job's shuffle files go as soon as it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_made: dict[tuple[str, ...], str] = {}
_handed_out: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str | None:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a folder in its warehouse; a
    cluster without it gets None, as no machine's own disk is visible to the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.sparkContext.getCheckpointDir()
    if shared is not None:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _local_roots[app] = f"{warehouse}/cardsieve-{app}"
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never one that was handed out before."""
    root = scratch_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    _handed_out.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete every file this session put under the shared folder; frames over them end too."""
    app = spark.sparkContext.applicationId
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for text in _handed_out.pop(app, []):
        path = hadoop.Path(text)
        path.getFileSystem(settings).delete(path, True)
    for key in [key for key in _made if key[0] == app]:
        del _made[key]


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; otherwise they stay on the
    executors' disks, beside the files they were shuffled for, until the driver's memory is
    collected."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Compute once and read the outcome from the shared folder, or from cache without one.

    A stored table outlives lost executors, and AQE merges its small partitions, which a
    cached frame keeps: an aggregate of a few rows would stay in hundreds of them. Its shuffle
    files go as soon as it is written.
    """
    spark = df.sparkSession
    if scratch_root(spark) is None:
        return df.persist()
    path = scratch_path(spark, name)
    with releasing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("value STRING").text(path)
    except AnalysisException:
        return False
    return True


def made_once(spark: SparkSession, name: str, origin: str, write: Callable[[str], object]) -> str:
    """Path of files that `write` makes, once per session and origin while they are there.
    Its shuffle files go as soon as it has ended."""
    key = (spark.sparkContext.applicationId, name, origin)
    if key not in _made or not _exists(spark, _made[key]):
        path = scratch_path(spark, name)
        with releasing_shuffles(spark):
            write(path)
        _made[key] = path
    return _made[key]
