"""Entry point: the flagship query, every registered query, and its SQL counterpart."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle  # noqa: E402
from cardsieve.functions import (  # noqa: E402
    parse_bool_lenient,
    parse_bool_strict,
    parse_float,
    parse_int,
)
from cardsieve.operators import features, ingest, profile, runlog, split, stats  # noqa: E402
from cardsieve.plans import risk_report, run_cached, run_to_table  # noqa: E402
from cardsieve.schema import ENGINEERED_SCHEMA, VELOCITY_TYPES  # noqa: E402
from cardsieve.scratch import made_once, scratch_path  # noqa: E402
from cardsieve.sinks import write_csv, write_json, write_split_tables, write_table  # noqa: E402
from cardsieve.sources import (  # noqa: E402
    CsvSource,
    TableSource,
    check_registry,
    ensure_schema,
    land_files,
    normalize_names,
    read_dataset,
    read_run_logs,
    register_table,
    rejected_by_typing,
    rejected_cells,
    scan_inferred,
    scan_overrides,
    scan_positional,
    scan_table,
    scan_text,
    scan_typed,
    stored_rows,
)
from cardsieve.sources import driver_tables as tables  # noqa: E402
from cardsieve.sources.registry import TIERS  # noqa: E402

try:
    import corpus_pipeline
    from cardsieve.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    # Only the subpackage itself may be absent; what it needs must be there.
    if missing.name not in ("corpus_pipeline", "cardsieve.llm"):
        raise
    corpus_pipeline = llm_queries = None


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer_features(tables.transactions(spark, sf_dir))


def _bounded_csv(df: DataFrame, path: str) -> str:
    """All rows as gzipped CSV, in files short enough for one task each."""
    return write_csv(df, path, max_records_per_file=500_000, compression="gzip")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    """The transactions as CSV files, written once per session for all CSV queries."""
    return made_once(
        spark,
        "transactions-csv",
        tables.content_key(spark, sf_dir),
        lambda path: _bounded_csv(tables.transactions(spark, sf_dir), path),
    )


def _dirty_csv(spark: SparkSession, sf_dir: str) -> str:
    return made_once(
        spark,
        "dirty-csv",
        tables.content_key(spark, sf_dir),
        lambda path: _bounded_csv(tables.dirty_cells(spark, sf_dir), path),
    )


_schemas: dict[str, str] = {}


def _table_name(spark: SparkSession, name: str) -> str:
    """A new table name in the session's own schema, stored under the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _schemas:
        location = scratch_path(spark, "schema")
        _schemas[app] = ensure_schema(spark, f"cardsieve_{uuid4().hex}", location)
    return f"{_schemas[app]}.{name}_{uuid4().hex}"


# --- reports --------------------------------------------------------------------------


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = stats.label_rate_sql("merchant_category", average=True, total=True)
    return stats.run_sql(spark, text, features=_features(spark, sf_dir))


def count_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_present(
        _features(spark, sf_dir), "country", velocity_num_transactions="with_velocity"
    )


# --- features -------------------------------------------------------------------------


def velocity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpacked = features.extract_velocity(tables.transactions(spark, sf_dir))
    return unpacked.select("transaction_id", *[f"velocity_{key}" for key in VELOCITY_TYPES])


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.transactions(spark, sf_dir)
    return normalize_names(raw.toDF(*[name.upper() for name in raw.columns]))


# --- splits ---------------------------------------------------------------------------


def split_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.transactions(spark, sf_dir)
    return split.complement(raw, split.hash_split(raw)[0])


def split_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.transactions(spark, sf_dir)
    return split.without_ids(raw, split.hash_split(raw)[0])


def random_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part drawn at random and the rows it left: together they are all rows again."""
    raw = tables.transactions(spark, sf_dir)
    train = split.random_split(raw)[0]
    return train.unionByName(split.complement(raw, train))


def split_estimate_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.estimate_from(stored_rows(spark, tables.landed_path(spark, sf_dir)))


def _sized(part: Column, rows: Column) -> Column:
    """Whether a part chosen at random holds three quarters, within far more than chance."""
    return (F.abs(part - rows * 0.75) <= 6 * F.sqrt(rows)).alias("sized")


def random_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both parts together are all rows, each as often as before, and of fair sizes."""
    raw = tables.transactions(spark, sf_dir)
    train, test = split.random_split(raw)
    marked = [
        part.select(F.lit(name).alias("part"), F.xxhash64(*raw.columns).alias("mark"))
        for name, part in (("all", raw), ("train", train), ("test", test))
    ]
    rows, taken = F.count_if(F.col("part") == "all"), F.count_if(F.col("part") == "train")
    sign = F.when(F.col("part") == "all", 1).otherwise(-1)
    balance = F.sum(sign) == 0
    content = F.sum(sign * F.col("mark").cast("decimal(28,0)")) == 0
    return marked[0].union(marked[1]).union(marked[2]).agg(
        rows.alias("n_rows"), (balance & content).alias("complete"), _sized(taken, rows)
    )


def random_filter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the filter keeps a fair number of rows."""
    raw = tables.transactions(spark, sf_dir)
    rows = raw.select(F.lit(False).alias("kept"))
    kept = split.random_filter(raw).select(F.lit(True).alias("kept"))
    n_rows = F.count_if(~F.col("kept"))
    return rows.union(kept).agg(n_rows.alias("n_rows"), _sized(F.count_if("kept"), n_rows))


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the seeded shuffle."""
    raw = tables.transactions(spark, sf_dir)
    shuffled = split.seeded_shuffle(raw, columns=["transaction_id"], stored=False)
    return split.with_row_index(shuffled).select("transaction_id", "_idx")


# --- sources --------------------------------------------------------------------------


def csv_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_inferred(spark, _csv(spark, sf_dir))
    return found.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm"))


def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("quoted"),
        F.concat("p_name", F.lit("\n"), "p_brand", F.lit("\r\n"), "p_type").alias("broken"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_type"))
        .when(F.col("p_size") % 4 == 1, F.lit(""))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit(" "), "p_type", F.lit("  ")))
        .alias("sometimes_empty"),
    )
    path = write_csv(part, scratch_path(spark, "dialect"), max_records_per_file=100_000)
    return scan_typed(spark, path, part.schema, multi_line=True)


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _table_name(spark, "raw_transactions")
    return scan_table(spark, register_table(spark, name, tables.landed_path(spark, sf_dir)))


def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and frauds of five tiers, each of the hours before its own: two in files, three
    in tables."""
    raw, registry = tables.transactions(spark, sf_dir), {}
    for place, tier in enumerate(TIERS):
        rows = raw.where(F.col("transaction_hour") < tables.TIER_HOURS[tier])
        if place < 2:
            registry[tier] = CsvSource(_bounded_csv(rows, scratch_path(spark, "tier")))
        else:
            registry[tier] = TableSource(write_table(rows, _table_name(spark, "tier")))
    check_registry(spark, registry)
    counts = [
        read_dataset(spark, registry, tier.upper())
        .agg(F.count("*").alias("n_rows"), F.count_if("is_fraud").alias("fraud_count"))
        .select(F.lit(tier).alias("tier"), "n_rows", "fraud_count")
        for tier in TIERS
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV files landed as Parquet, and once more, which reads none of them again."""
    pattern, target = f"{_csv(spark, sf_dir)}/*.csv.gz", scratch_path(spark, "landing")
    for _ in range(2):
        found = land_files(spark, pattern, target, scan_typed)
    return found


# --- cells that cannot be read ----------------------------------------------------------


def rejected_cells_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the careless export that a typed scan cannot read."""
    return rejected_cells(spark, _dirty_csv(spark, sf_dir)).select(
        F.substring_index("record", ",", 1).alias("transaction_id"), "column_name", "cell"
    )


def rejected_cells_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for text columns that are typed afterwards."""
    cells = scan_text(spark, _dirty_csv(spark, sf_dir))
    return rejected_by_typing(cells, keys=("transaction_id",))


def dirty_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four reports over null keys, labels and amounts."""
    cells = scan_typed(spark, _dirty_csv(spark, sf_dir))
    return risk_report(features.engineer_features(cells)).combined()


def ctas_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = write_table(
        scan_typed(spark, _csv(spark, sf_dir)), _table_name(spark, "raw_transactions")
    )
    return spark.table(name)


def ctas_engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = features.engineer_features(split.with_split(tables.transactions(spark, sf_dir)))
    name = _table_name(spark, "engineered")
    train, test = write_split_tables(labelled, name)
    return spark.table(train).withColumn("split", F.lit("train")).unionByName(
        spark.table(test).withColumn("split", F.lit("test"))
    )


# --- sinks ----------------------------------------------------------------------------


def sink_csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, each task's part in files of bounded length."""
    path = scratch_path(spark, "engineered")
    write_csv(_features(spark, sf_dir), path, max_records_per_file=1_000_000)
    return scan_typed(spark, path, ENGINEERED_SCHEMA)


def _report_csv(report: Callable, files: int) -> Callable[[SparkSession, str], DataFrame]:
    """A report, which has few rows at any scale, dealt to a number of files."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = report(_features(spark, sf_dir))
        return scan_typed(
            spark, write_csv(found, scratch_path(spark, "report"), files), found.schema
        )

    return query


def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(write_table(_features(spark, sf_dir), _table_name(spark, "engineered")))


def sink_table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is replaced from its own rows, twice."""
    name = write_table(tables.transactions(spark, sf_dir), _table_name(spark, "raw"))
    for hour in (20, 10):
        write_table(spark.table(name).where(F.col("transaction_hour") < hour), name)
    return spark.table(name)


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = risk_report(_features(spark, sf_dir))
    combined = reports.combined()
    path = write_json(combined, scratch_path(spark, "reports"))
    reports.release()
    return spark.read.schema(combined.schema).json(path)


# --- text cells -----------------------------------------------------------------------


def _flags(parse: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = tables.text_cells(spark, sf_dir)
        return cells.select("cell", "flag_text", parse(F.col("flag_text")).alias("flag"))

    return query


def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("number_text")
    return tables.text_cells(spark, sf_dir).select(
        "cell", text, parse_int(text).alias("whole"), parse_float(text).alias("decimal")
    )


# --- run logs -------------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.parse_run_log(tables.run_log_lines(spark, sf_dir))


def run_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step times from text files; each folder's file holds the runs of a thousand orders."""
    number = F.substring_index("run", "_", -1).cast("long")
    path = scratch_path(spark, "run-logs")
    (
        tables.run_log_lines(spark, sf_dir)
        .select(F.floor(number / 1000).alias("batch"), number.alias("n"), "line_no", "value")
        .repartition("batch")
        .sortWithinPartitions("batch", "n", "line_no", "value")
        .select("batch", "value")
        .write.partitionBy("batch")
        .text(path)
    )
    parsed = runlog.parse_run_log(read_run_logs(spark, path))
    batch = F.regexp_extract("run", r"^batch=(\d+)/", 1).cast("long")
    return parsed.select(
        batch.alias("batch"), "step", "seconds", "total_duration", "total_rows"
    )


# --- whole jobs -----------------------------------------------------------------------


def pipeline_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "engineered")
    result = run_cached(
        scan_typed(spark, _csv(spark, sf_dir)),
        lambda df, rows: write_csv(df, path),
    )
    return result.report.combined()


def pipeline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = run_to_table(
        tables.transactions(spark, sf_dir), _table_name(spark, "engineered")
    )
    return result.report.combined()


def entry(spark: SparkSession) -> DataFrame:
    """Fraud rate by merchant category, from the raw record to the ranked report."""
    return stats.rate_by_category(_features(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    raw = tables.transactions
    found = {
        # Reports
        "fraud_rate_by_category": lambda s, d: stats.rate_by_category(_features(s, d)),
        "fraud_rate_by_country": lambda s, d: stats.rate_by_country(_features(s, d)),
        "fraud_rate_by_channel_device": lambda s, d: stats.rate_by_channel_device(
            _features(s, d)
        ),
        "fraud_rate_top_countries": lambda s, d: stats.rate_by_country(_features(s, d), limit=10),
        "velocity_by_label": lambda s, d: stats.velocity_by_label(_features(s, d)),
        "sql_surface": sql_surface,
        "risk_report": lambda s, d: risk_report(_features(s, d)).combined(),
        "row_count": lambda s, d: stats.row_count(raw(s, d)),
        "count_nonnull": count_nonnull,
        # Features
        "engineer_features": _features,
        "velocity_extract": velocity_extract,
        "cast_flags": lambda s, d: features.cast_flags(raw(s, d)),
        "cast_flags_text": lambda s, d: features.cast_flags(scan_positional(s, _csv(s, d))),
        "drop_pii": lambda s, d: features.drop_identifiers(raw(s, d)),
        "project_columns": lambda s, d: stats.project_aggregate_inputs(_features(s, d)),
        "normalize_names": normalized,
        # Splits
        "hash_split": lambda s, d: split.with_split(raw(s, d)).select("transaction_id", "split"),
        "hash_split_train": lambda s, d: split.hash_split(raw(s, d))[0],
        "hash_split_test": lambda s, d: split.hash_split(raw(s, d))[1],
        "split_complement": split_complement,
        "split_without_ids": split_without_ids,
        "random_complement": random_complement,
        "split_report": lambda s, d: split.split_report(split.with_split(raw(s, d))),
        "split_estimate": lambda s, d: split.split_estimate(raw(s, d)),
        "split_estimate_stored": split_estimate_stored,
        "exact_split": lambda s, d: split.exact_split(raw(s, d)).select(
            "transaction_id", "split"
        ),
        "shuffle_rank": lambda s, d: split.shuffle_rank(raw(s, d)),
        "seeded_shuffle": lambda s, d: split.seeded_shuffle(raw(s, d), stored=False),
        "random_split": random_split_check,
        "random_filter": random_filter_check,
        "row_index": row_index,
        # Profile
        "profile_nulls": lambda s, d: profile.null_counts(raw(s, d)),
        "profile_schema": lambda s, d: profile.schema_profile(
            raw(s, d), features.engineer_features
        ),
        "velocity_quality": lambda s, d: profile.velocity_quality(raw(s, d)),
        # Sources
        "csv_scan_typed": lambda s, d: scan_typed(s, _csv(s, d)),
        "csv_scan_overrides": lambda s, d: scan_overrides(s, _csv(s, d)),
        "csv_scan_inferred": csv_scan_inferred,
        "csv_dialect": csv_dialect,
        "stage_positional_scan": lambda s, d: scan_positional(s, _csv(s, d)),
        "typed_ingest": lambda s, d: ingest.typed_ingest(scan_text(s, _csv(s, d))),
        "table_scan": table_scan,
        "dataset_registry": dataset_registry,
        "landed_files": landed_files,
        "ctas_raw": ctas_raw,
        "ctas_engineered": ctas_engineered,
        # Sinks
        "sink_csv_single": _report_csv(stats.rate_by_country, 1),
        "sink_csv_dealt": _report_csv(stats.rate_by_category, 4),
        "sink_csv_parts": sink_csv_parts,
        "sink_table": sink_table,
        "sink_table_replaced": sink_table_replaced,
        "sink_json": sink_json,
        # Cells that cannot be read
        "rejected_cells": rejected_cells_csv,
        "rejected_cells_text": rejected_cells_text,
        "dirty_csv_scan": lambda s, d: scan_typed(s, _dirty_csv(s, d)),
        "dirty_csv_overrides": lambda s, d: scan_overrides(s, _dirty_csv(s, d)),
        "dirty_typed_ingest": lambda s, d: ingest.typed_ingest(scan_text(s, _dirty_csv(s, d))),
        "dirty_risk_report": dirty_report,
        "dirty_velocity_quality": lambda s, d: profile.velocity_quality(
            scan_typed(s, _dirty_csv(s, d))
        ),
        "unmatched_rows": lambda s, d: tables.unmatched(s, d),
        # Text cells
        "parse_bool_strict": _flags(parse_bool_strict),
        "parse_bool_lenient": _flags(parse_bool_lenient),
        "parse_number": parse_number,
        # Run logs
        "run_log_parse": _parsed,
        "run_log_text": run_log_text,
        "log_error_lines": lambda s, d: runlog.error_lines(tables.run_log_lines(s, d), last=5),
        "run_compare": lambda s, d: runlog.compare_runs(
            tables.runs(s, d), _parsed(s, d), tables.RUN_LABELS
        ),
        "run_speedup": lambda s, d: runlog.speedup(tables.runs(s, d), _parsed(s, d)),
        "run_step_share": lambda s, d: runlog.step_share(_parsed(s, d)),
        # Whole jobs
        "pipeline_cached": pipeline_cached,
        "pipeline_table": pipeline_table,
    }
    if llm_queries is not None:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """SQL for the same results on the same tables, by query name."""
    found = oracle.oracle_sql()
    if llm_queries is not None:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
