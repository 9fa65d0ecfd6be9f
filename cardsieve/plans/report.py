"""All four risk reports and the split sizes, from one pass over the feature rows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.operators.stats import (
    cells,
    rate_by_category,
    rate_by_channel_device,
    rate_by_country,
    velocity_by_label,
)
from cardsieve.scratch import store


@dataclass(frozen=True)
class RiskReport:
    """The reports as DataFrames over a small stored table of partial sums."""

    partial_sums: DataFrame
    by_category: DataFrame
    by_country: DataFrame
    by_channel_device: DataFrame
    velocity: DataFrame

    def combined(self) -> DataFrame:
        """The four reports in one frame, told apart by the `report` column."""
        parts = {
            "merchant_category": self.by_category,
            "country": self.by_country,
            "channel_device": self.by_channel_device,
            "velocity": self.velocity,
        }
        combined = None
        for name, part in parts.items():
            part = part.withColumn("report", F.lit(name))
            combined = (
                part if combined is None else combined.unionByName(part, allowMissingColumns=True)
            )
        return combined

    def split_rows(self) -> dict[str, int]:
        """Rows on either side of the split, for features that were labelled."""
        sums = self.partial_sums.agg(
            F.sum("n_train").alias("train"), F.sum(F.col("n_rows") - F.col("n_train")).alias("test")
        ).first()
        return {"train": sums.train or 0, "test": sums.test or 0}

    def release(self) -> None:
        """Free the partial sums where they had to be cached."""
        self.partial_sums.unpersist()


def risk_report(features: DataFrame) -> RiskReport:
    """Make the partial sums, in one pass, and set up the reports over them."""
    sums = store(cells(features), "partial-sums")
    return RiskReport(
        sums,
        rate_by_category(sums),
        rate_by_country(sums),
        rate_by_channel_device(sums),
        velocity_by_label(sums),
    )
