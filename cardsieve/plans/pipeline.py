"""Load, engineer, split, report and write back, as one job."""

from collections.abc import Callable
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cardsieve.operators.features import engineer_features
from cardsieve.operators.split import SEED, SPLIT_COLUMN, TRAIN_PERCENT, with_split
from cardsieve.plans.report import RiskReport, risk_report
from cardsieve.schema import ID_COLUMN
from cardsieve.sinks.tables import write_table


@dataclass
class PipelineResult:
    """What a run leaves behind: the stored features' reports, sizes, and step times.

    null_counts, by column, comes with `run_to_table`, whose write counts them.
    """

    report: RiskReport
    split_rows: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    null_counts: dict[str, int] = field(default_factory=dict)

    @property
    def total_rows(self) -> int:
        return sum(self.split_rows.values())


class _Clock:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._last = monotonic()

    def lap(self, step: str) -> None:
        now = monotonic()
        self.seconds[step] = now - self._last
        self._last = now


def _labelled_features(raw: DataFrame, id_column: str, train_percent: int, seed: int) -> DataFrame:
    # The label is taken from the id, so it has to come before the id is dropped.
    features = engineer_features(with_split(raw, id_column, train_percent, seed))
    return features.select(*[c for c in features.columns if c != SPLIT_COLUMN], SPLIT_COLUMN)


def _counted(labelled: DataFrame, seen: Observation) -> DataFrame:
    """The same rows; whatever writes them leaves their counts in `seen`."""
    train = F.count_if(F.col(SPLIT_COLUMN) == "train")
    nulls = [
        F.count_if(F.col(f"`{name}`").isNull()).alias(f"nulls_{place}")
        for place, name in enumerate(labelled.columns)
    ]
    return labelled.observe(
        seen, train.alias("train"), (F.count("*") - train).alias("test"), *nulls
    )


def run_cached(
    raw: DataFrame,
    write: Callable[[DataFrame, int], object],
    id_column: str = ID_COLUMN,
    train_percent: int = TRAIN_PERCENT,
    seed: int = SEED,
) -> PipelineResult:
    """For sinks that are slow to read back, such as CSV: keep the features while they are used.

    The pass that makes the partial sums fills the cache and yields the split sizes as well.
    The cache is released after the write, which reads from it too. `write` gets the features
    without the split label, and their row count.
    """
    clock = _Clock()
    features = _labelled_features(raw, id_column, train_percent, seed).persist()
    clock.lap("feature_eng")
    try:
        report = risk_report(features)
        sizes = report.split_rows()
        clock.lap("aggregations")
        write(features.drop(SPLIT_COLUMN), sum(sizes.values()))
        clock.lap("write_back")
    finally:
        features.unpersist()
    return PipelineResult(report, sizes, clock.seconds)


def run_to_table(
    raw: DataFrame,
    table: str,
    path: str | None = None,
    export: Callable[[DataFrame, int], object] | None = None,
    id_column: str = ID_COLUMN,
    train_percent: int = TRAIN_PERCENT,
    seed: int = SEED,
) -> PipelineResult:
    """For large data: write the labelled features as a table first, work on from the table.

    The raw input is read once, nothing is held in executor memory, and the reports only
    touch the columns they need. The write itself counts the rows of either side and the
    nulls of every column, so no job is run for them. `export`, if given, gets the stored features without the
    split label, and their row count, to write them elsewhere too.
    """
    clock = _Clock()
    features = _labelled_features(raw, id_column, train_percent, seed)
    clock.lap("feature_eng")
    seen = Observation()
    write_table(_counted(features, seen), table, path)
    found = seen.get
    sizes = {side: found[side] for side in ("train", "test")}
    nulls = {name: found[f"nulls_{place}"] for place, name in enumerate(features.columns)}
    clock.lap("write_back")
    stored = raw.sparkSession.table(table)
    report = risk_report(stored)
    clock.lap("aggregations")
    if export is not None:
        export(stored.drop(SPLIT_COLUMN), sum(sizes.values()))
        clock.lap("export")
    return PipelineResult(report, sizes, clock.seconds, nulls)
