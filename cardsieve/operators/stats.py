"""Label rates and velocity averages by group.

Every statistic is a ratio of sums, so it can be taken from the rows or from cells that
hold partial sums. Both ways only shuffle one small row per group and task, however
unevenly the groups are filled.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsieve.operators.split import SPLIT_COLUMN
from cardsieve.schema import LABEL_COLUMN

CELL_KEYS = ("merchant_category", "country", "channel", "device", LABEL_COLUMN)

# Column to average and the name the average goes by.
VELOCITY_AVERAGES = {
    "velocity_num_transactions": "avg_velocity_txns",
    "velocity_total_amount": "avg_velocity_amount",
    "velocity_unique_merchants": "avg_velocity_merchants",
    "velocity_max_single_amount": "avg_velocity_max_amount",
}

AGGREGATE_INPUTS = (
    "merchant_category",
    "country",
    "channel",
    "device",
    "amount",
    LABEL_COLUMN,
    *VELOCITY_AVERAGES,
)

SUM_NAMES = ("n_rows", "n_label", "sum_label", "n_amount", "sum_amount") + tuple(
    f"{kind}_{name}" for name in VELOCITY_AVERAGES for kind in ("n", "sum")
)


def _row_sums() -> dict[str, Column]:
    inputs = {"label": LABEL_COLUMN, "amount": "amount"} | {v: v for v in VELOCITY_AVERAGES}
    sums = {"n_rows": F.count("*")}
    for name, column in inputs.items():
        sums |= {f"n_{name}": F.count(column), f"sum_{name}": F.sum(column)}
    return sums


def cells(df: DataFrame) -> DataFrame:
    """Partial sums per category, country, channel, device and label.

    One pass over the rows yields this small table, and all four reports follow from it; so
    do the split sizes where the rows have a split label.
    """
    sums = _row_sums()
    if SPLIT_COLUMN in df.columns:
        sums["n_train"] = F.count_if(F.col(SPLIT_COLUMN) == "train")
    return df.groupBy(*CELL_KEYS).agg(*[c.alias(name) for name, c in sums.items()])


def _sums(df: DataFrame) -> dict[str, Column]:
    if "n_rows" in df.columns:
        return {name: F.sum(name) for name in SUM_NAMES}
    return _row_sums()


def _mean(sums: dict[str, Column], name: str) -> Column:
    return F.try_divide(sums[f"sum_{name}"].cast("double"), sums[f"n_{name}"])


def project_aggregate_inputs(df: DataFrame) -> DataFrame:
    """The ten columns that the reports read."""
    return df.select(*AGGREGATE_INPUTS)


def label_rate(
    df: DataFrame,
    *keys: str,
    average: bool = False,
    total: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Rows, positives and their percentage per group, highest rate first.

    `df` is the feature rows or their `cells`. Rows without a label count as rows but not
    towards the rate; a null key is a group of its own. Ties are broken by the keys, so the
    groups a limit keeps do not vary from run to run.
    """
    sums = _sums(df)
    columns = [
        sums["n_rows"].alias("total_txns"),
        sums["sum_label"].alias("fraud_count"),
        F.round(_mean(sums, "label") * 100, 2).alias("fraud_rate_pct"),
    ]
    if average:
        columns.append(F.round(_mean(sums, "amount"), 2).alias("avg_amount"))
    if total:
        columns.append(F.round(sums["sum_amount"], 2).alias("total_amount"))
    ranked = df.groupBy(*keys).agg(*columns).orderBy(
        F.desc_nulls_last("fraud_rate_pct"), *[F.asc_nulls_last(key) for key in keys]
    )
    return ranked if limit is None else ranked.limit(limit)


def rate_by_category(df: DataFrame, limit: int | None = None) -> DataFrame:
    return label_rate(df, "merchant_category", average=True, total=True, limit=limit)


def rate_by_country(df: DataFrame, limit: int | None = None) -> DataFrame:
    return label_rate(df, "country", average=True, limit=limit)


def rate_by_channel_device(df: DataFrame, limit: int | None = None) -> DataFrame:
    return label_rate(df, "channel", "device", limit=limit)


def velocity_by_label(df: DataFrame) -> DataFrame:
    """Average velocity numbers for each label value."""
    sums = _sums(df)
    return df.groupBy(LABEL_COLUMN).agg(
        *[F.round(_mean(sums, name), 2).alias(out) for name, out in VELOCITY_AVERAGES.items()]
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows"))


def count_present(df: DataFrame, *keys: str, **columns: str) -> DataFrame:
    """Rows per group, and for each `column="name"` the rows where that column has a value."""
    present = [F.count(column).alias(name) for column, name in columns.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("total_txns"), *present)


def label_rate_sql(
    *keys: str, average: bool = False, total: bool = False, limit: int | None = None
) -> str:
    """`label_rate` as SQL text; `{features}` stands for the DataFrame or view to query."""
    names = ", ".join(keys)
    ties = ", ".join(f"{key} ASC NULLS LAST" for key in keys)
    columns = ["count(*) AS total_txns", f"sum({LABEL_COLUMN}) AS fraud_count"]
    columns.append(f"round(avg({LABEL_COLUMN}) * 100, 2) AS fraud_rate_pct")
    columns += ["round(avg(amount), 2) AS avg_amount"] * average
    columns += ["round(sum(amount), 2) AS total_amount"] * total
    return (
        f"SELECT {names}, {', '.join(columns)} FROM {{features}} GROUP BY {names}"
        f" ORDER BY fraud_rate_pct DESC NULLS LAST, {ties}"
        + ("" if limit is None else f" LIMIT {limit}")
    )


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL text over DataFrames: each `{name}` in the text is the frame of that name."""
    return spark.sql(text, **frames)
