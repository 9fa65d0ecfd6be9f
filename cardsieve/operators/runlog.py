"""Run logs: text lines to step timings, and comparisons of runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of the summary lines, and words that mark harmless messages.
STEP_PATTERN = r"^\s+(\w+)\s*:\s+([\d.]+)s\s"
DURATION_PATTERN = r"^\s+Total duration\s*:\s+([\d.]+)s$"
ROWS_PATTERN = r"^\s+Total rows\s*:\s+([\d,]+)$"
QUIET_WORDS = ("WARN", "WARNING", "INFO")

TOTAL_STEP = "TOTAL"
OTHER_LABEL = "other"


def parse_run_log(lines: DataFrame) -> DataFrame:
    """(run, step, seconds, total_duration, total_rows) from (run, line_no, value).

    A run has one row per step, and one without a step for its totals. The sum line is no
    step. Where a run prints a value twice the later line counts. Lines are combined per
    run and step before they are shuffled, so a very long log is no burden.
    """
    # Every form has a colon; the test spares most other lines the patterns.
    captured = lines.where(F.contains("value", F.lit(":"))).select(
        "run",
        "line_no",
        F.regexp_extract("value", STEP_PATTERN, 1).alias("step"),
        F.regexp_extract("value", STEP_PATTERN, 2).alias("seconds"),
        F.regexp_extract("value", DURATION_PATTERN, 1).alias("duration"),
        F.regexp_extract("value", ROWS_PATTERN, 1).alias("total"),
    )

    def number(text: Column | str, to: str) -> Column:
        # No match is empty text: skip it, as a failing cast is far dearer than this test.
        return F.nullif(text, F.lit("")).try_cast(to)

    fields = captured.select(
        "run",
        "line_no",
        "step",
        number("seconds", "double").alias("seconds"),
        number("duration", "double").alias("duration"),
        number(F.replace("total", F.lit(","), F.lit("")), "long").alias("total"),
    )

    def latest(name: str) -> Column:
        # max_by passes over rows whose order is null.
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no")))

    # Lines of no known form are in the group without a step and add nothing to it. The
    # filter comes after the grouping, so that the patterns are not evaluated for it again.
    return (
        fields.groupBy("run", "step")
        .agg(
            latest("seconds").alias("seconds"),
            latest("duration").alias("total_duration"),
            latest("total").alias("total_rows"),
        )
        .where(F.col("step") != TOTAL_STEP)
        .where(F.coalesce("seconds", "total_duration", "total_rows").isNotNull())
        .withColumn("step", F.nullif("step", F.lit("")))
    )


def step_times(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("step").isNotNull()).select("run", "step", "seconds")


def run_totals(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("step").isNull()).select("run", "total_duration", "total_rows")


def error_lines(lines: DataFrame, last: int | None = None) -> DataFrame:
    """Lines that are no warning or information; only the `last` ones of each run if asked for.

    The per-run limit is applied in the map tasks already, so no task collects a whole log.
    """
    quiet = F.lit(False)
    for word in QUIET_WORDS:
        quiet = quiet | F.contains(F.col("value"), F.lit(word))
    loud = lines.where(~quiet)
    if last is None:
        return loud
    newest = Window.partitionBy("run").orderBy(F.desc("line_no"), F.desc("value"))
    return loud.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")


def step_share(parsed: DataFrame) -> DataFrame:
    """Each step's percentage of its run's total duration.

    An equi-join with the run's own totals row, so a run with very many steps can be split.
    """
    totals = run_totals(parsed).where(F.col("total_duration").isNotNull())
    share = F.try_divide(F.col("seconds"), F.col("total_duration")) * 100
    return (
        step_times(parsed)
        .join(totals, "run")
        .select("run", "step", "seconds", F.round(share, 1).alias("share_pct"))
    )


def comparable_runs(runs: DataFrame) -> DataFrame:
    """Successful runs (run, comparison, label, success, wall_time), unless failures leave
    fewer than two of them in a comparison."""
    done = F.col("success")
    counts = runs.groupBy("comparison").agg(
        F.count_if(done).alias("_ok"), F.count_if(~done).alias("_failed")
    )
    enough = counts.where((F.col("_failed") == 0) | (F.col("_ok") >= 2)).select("comparison")
    return runs.where(done).join(enough, "comparison", "left_semi")


def _durations(runs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Comparable runs with their duration, the wall time where the log does not tell."""
    return (
        comparable_runs(runs)
        .join(run_totals(parsed), "run", "left")
        .withColumn("duration", F.coalesce("total_duration", "wall_time"))
    )


def compare_runs(
    runs: DataFrame, parsed: DataFrame, labels: list[str] | tuple[str, ...]
) -> DataFrame:
    """One row per comparison and step, one column of seconds per label; null where a run
    lacks the step. The TOTAL row holds the durations, the last column the most seconds of
    any label that is not listed."""
    # Each run asks for its steps and for its totals, so that the log is parsed and joined
    # once, and a run without totals still has a row that takes the wall time.
    asked = comparable_runs(runs).withColumn(
        "is_total", F.explode(F.array(F.lit(False), F.lit(True)))
    )
    found = asked.join(
        parsed.withColumn("is_total", F.col("step").isNull()), ["run", "is_total"], "left"
    ).where(F.col("is_total") | F.col("step").isNotNull())
    named = F.when(F.col("label").isin(*labels), F.col("label")).otherwise(OTHER_LABEL)
    shown = found.select(
        "comparison",
        F.when(F.col("is_total"), TOTAL_STEP).otherwise(F.col("step")).alias("step"),
        named.alias("label"),
        F.when(F.col("is_total"), F.coalesce("total_duration", "wall_time"))
        .otherwise(F.col("seconds"))
        .alias("seconds"),
    )
    return shown.groupBy("comparison", "step").agg(
        *[
            F.max(F.when(F.col("label") == label, F.col("seconds"))).alias(label)
            for label in dict.fromkeys([*labels, OTHER_LABEL])
        ]
    )


def speedup(runs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Fastest and slowest label of each comparison, their ratio and the seconds between."""
    # Equal durations go to the first label on both ends.
    found = (
        _durations(runs, parsed)
        .groupBy("comparison")
        .agg(
            F.min(F.struct(F.col("duration").alias("by"), "label")).alias("low"),
            F.min(F.struct((-F.col("duration")).alias("by"), "label")).alias("high"),
        )
    )
    low, high = F.col("low.by"), -F.col("high.by")
    return found.where(low > 0).select(
        "comparison",
        F.col("low.label").alias("fastest"),
        F.col("high.label").alias("slowest"),
        F.round(high / low, 1).alias("ratio"),
        F.round(high - low, 2).alias("seconds_saved"),
    )
