"""The queries of `__spark_entry__.py` as SQL for another engine, over the same tables."""

from cardsieve.schema import (
    ENGINEERED_SCHEMA,
    FLAG_COLUMNS,
    IDENTIFIER_COLUMNS,
    RAW_SCHEMA,
    VELOCITY_COLUMN,
    VELOCITY_TYPES,
)
from cardsieve.sources.driver_tables import (
    CELL_COLUMNS,
    DIRTY_CELLS,
    RUN_COLUMNS,
    RUN_LABELS,
    STEP_LINE_COLUMNS,
    SUMMARY_LINES,
    TIER_HOURS,
    TRANSACTION_COLUMNS,
    UNREADABLE,
)


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in columns.items())


_TRANSACTIONS = (
    f"transactions AS (SELECT {_list(TRANSACTION_COLUMNS)} FROM lineitem"
    " JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
)


def _velocity(key: str, to: str) -> str:
    number = f"TRY_CAST(json_extract_string(velocity_json, '$.{key}') AS DOUBLE)"
    return number if to == "double" else f"TRY_CAST(trunc({number}) AS INTEGER)"


_VELOCITY = {f"velocity_{key}": _velocity(key, to) for key, to in VELOCITY_TYPES.items()}

_WITH_JSON = (
    "with_json AS (SELECT *, CASE WHEN json_valid(replace(velocity_last_hour, '''', '\"'))"
    " THEN replace(velocity_last_hour, '''', '\"') END AS velocity_json FROM transactions)"
)


def _feature(name: str) -> str:
    if name in _VELOCITY:
        return _VELOCITY[name]
    return f"CAST({name} AS INTEGER)" if name in FLAG_COLUMNS else name


_IN_TRAIN = (
    "CAST('0x' || substr(md5('42:' || transaction_id), 1, 8) AS BIGINT) % 100 < 75"
)
_SPLIT = f"CASE WHEN {_IN_TRAIN} THEN 'train' ELSE 'test' END"

_FEATURES = (
    f"features AS (SELECT {_list({n: _feature(n) for n in ENGINEERED_SCHEMA.names})},"
    f" {_SPLIT} AS split, transaction_id FROM with_json)"
)
_FEATURE_NAMES = ", ".join(ENGINEERED_SCHEMA.names)


def _dirty(flag: str = "NULL") -> str:
    """The record as typed scans see the careless export; `flag` is what a word that is no
    flag becomes."""
    seen = dict.fromkeys(UNREADABLE, "NULL") | {"is_fraud": flag}
    cells = ", ".join(
        f"CASE WHEN {when} THEN {seen.get(name, text)} ELSE {name} END AS {name}"
        for name, (when, text) in DIRTY_CELLS.items()
    )
    clean = _TRANSACTIONS.replace("transactions AS", "clean AS", 1)
    return f"WITH {clean}, transactions AS (SELECT * REPLACE ({cells}) FROM clean)"


_REJECTED = " UNION ALL ".join(
    f"SELECT transaction_id, '{name}' AS column_name, {DIRTY_CELLS[name][1]} AS cell FROM clean"
    f" WHERE {DIRTY_CELLS[name][0]}"
    for name in UNREADABLE
)

_VELOCITY_QUALITY = (
    "SELECT count(*) AS total_rows,"
    " count(*) FILTER (WHERE velocity_last_hour IS NULL) AS missing,"
    " count(*) FILTER (WHERE velocity_last_hour IS NOT NULL AND"
    f" coalesce({', '.join(f'CAST({number} AS DOUBLE)' for number in _VELOCITY.values())})"
    " IS NULL) AS unreadable FROM with_json"
)

_UNMATCHED = (
    "SELECT v.partner, count(g.partner) AS n_rows FROM"
    " (VALUES ('part'), ('orders'), ('customer'), ('nation')) v(partner) LEFT JOIN"
    " (SELECT CASE WHEN p_partkey IS NULL THEN 'part' WHEN o_orderkey IS NULL THEN 'orders'"
    " WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' END AS partner"
    " FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey ="
    " o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey ="
    " n_nationkey) g ON g.partner = v.partner GROUP BY v.partner"
)

_RAW = f"WITH {_TRANSACTIONS} "
_ENGINEERED = f"WITH {_TRANSACTIONS}, {_WITH_JSON}, {_FEATURES} "


def _rates(*keys: str, average: bool = False, total: bool = False) -> str:
    names = ", ".join(keys)
    extra = ", round(avg(amount), 2) AS avg_amount" if average else ""
    extra += ", round(sum(amount), 2) AS total_amount" if total else ""
    ties = ", ".join(f"{key} NULLS LAST" for key in keys)
    return (
        f"SELECT {names}, count(*) AS total_txns, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,"
        f" round(avg(CAST(is_fraud AS DOUBLE)) * 100, 2) AS fraud_rate_pct{extra} FROM features"
        f" GROUP BY {names} ORDER BY fraud_rate_pct DESC NULLS LAST, {ties}"
    )


_BY_CATEGORY = _rates("merchant_category", average=True, total=True)
_BY_COUNTRY = _rates("country", average=True)
_BY_CHANNEL_DEVICE = _rates("channel", "device")
_BY_LABEL = (
    "SELECT is_fraud, round(avg(velocity_num_transactions), 2) AS avg_velocity_txns,"
    " round(avg(velocity_total_amount), 2) AS avg_velocity_amount,"
    " round(avg(velocity_unique_merchants), 2) AS avg_velocity_merchants,"
    " round(avg(velocity_max_single_amount), 2) AS avg_velocity_max_amount"
    " FROM features GROUP BY is_fraud"
)

_COMBINED = " UNION ALL BY NAME ".join(
    f"SELECT *, '{name}' AS report FROM ({text})"
    for name, text in {
        "merchant_category": _BY_CATEGORY,
        "country": _BY_COUNTRY,
        "channel_device": _BY_CHANNEL_DEVICE,
        "velocity": _BY_LABEL,
    }.items()
)

_TYPE_NAMES = {field.name: field.dataType.simpleString() for field in RAW_SCHEMA} | {
    field.name: field.dataType.simpleString()
    for field in ENGINEERED_SCHEMA
    if field.name not in RAW_SCHEMA.names
}


def _null_counts(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count(*) - count({name}) AS null_count FROM {source}"
        for name in names
    )


def _profile() -> str:
    gone = {*IDENTIFIER_COLUMNS, VELOCITY_COLUMN}
    rows = []
    for place, name in enumerate(RAW_SCHEMA.names + list(_VELOCITY), 1):
        status = "added" if name in _VELOCITY else "dropped" if name in gone else "kept"
        source = "features" if name in _VELOCITY else "transactions"
        rows.append(
            f"SELECT CAST({place} AS INTEGER) AS position, '{name}' AS column_name,"
            f" '{_TYPE_NAMES[name]}' AS data_type, true AS nullable,"
            f" count(*) - count({name}) AS null_count, '{status}' AS status FROM {source}"
        )
    return " UNION ALL ".join(rows)


_LINES = "lines AS (" + " UNION ALL ".join(
    [f"SELECT {_list(STEP_LINE_COLUMNS)} FROM lineitem"]
    + [
        f"SELECT {RUN_COLUMNS['run']} AS run, {number} AS line_no, {text} AS value FROM orders"
        for number, text in SUMMARY_LINES
    ]
) + ")"

_PARSED = (
    r"fields AS (SELECT run, line_no, NULLIF(regexp_extract(value, '^\s+(\w+)\s*:\s+([\d.]+)s\s', 1), '') AS step,"
    r" TRY_CAST(regexp_extract(value, '^\s+(\w+)\s*:\s+([\d.]+)s\s', 2) AS DOUBLE) AS seconds,"
    r" TRY_CAST(regexp_extract(value, '^\s+Total duration\s*:\s+([\d.]+)s$', 1) AS DOUBLE) AS duration,"
    r" TRY_CAST(replace(regexp_extract(value, '^\s+Total rows\s*:\s+([\d,]+)$', 1), ',', '') AS BIGINT) AS total"
    " FROM lines),"
    " steps AS (SELECT run, step, arg_max(seconds, line_no) AS seconds FROM fields"
    " WHERE step IS NOT NULL AND step <> 'TOTAL' GROUP BY run, step),"
    " totals AS (SELECT run, arg_max(duration, line_no) AS total_duration,"
    " arg_max(total, line_no) AS total_rows FROM fields WHERE step IS NULL"
    " AND (duration IS NOT NULL OR total IS NOT NULL) GROUP BY run)"
)

_RUNS = (
    f"all_runs AS (SELECT {_list(RUN_COLUMNS)} FROM orders),"
    " comparable AS (SELECT r.* FROM all_runs r JOIN (SELECT comparison,"
    " count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS failed"
    " FROM all_runs GROUP BY comparison) c ON r.comparison = c.comparison"
    " WHERE r.success AND (c.failed = 0 OR c.ok >= 2)),"
    " durations AS (SELECT c.*, coalesce(t.total_duration, c.wall_time) AS duration"
    " FROM comparable c LEFT JOIN totals t ON c.run = t.run)"
)

_LOGS = f"WITH {_LINES}, {_PARSED}, {_RUNS} "

_MATRIX = ", ".join(
    f"max(seconds) FILTER (WHERE label = '{label}') AS {label}" for label in RUN_LABELS
) + f", max(seconds) FILTER (WHERE label NOT IN {RUN_LABELS}) AS other"

_CELLS = f"WITH cells AS (SELECT {_list(CELL_COLUMNS)} FROM lineitem) "

_STORED_FLAGS = ", ".join(
    f"CAST({name} AS INTEGER) AS {name}" if name in FLAG_COLUMNS else name
    for name in RAW_SCHEMA.names
)


def oracle_sql() -> dict[str, str]:
    all_raw = _RAW + "SELECT * FROM transactions"
    all_features = _ENGINEERED + f"SELECT {_FEATURE_NAMES} FROM features"
    by_category = _ENGINEERED + _BY_CATEGORY
    tiers = ", ".join(f"('{tier}', {before})" for tier, before in TIER_HOURS.items())
    not_in_train = (
        "SELECT * FROM transactions WHERE transaction_id NOT IN"
        f" (SELECT transaction_id FROM transactions WHERE {_IN_TRAIN})"
    )
    estimate = (
        "SELECT count(*) AS total_rows, CAST(floor(count(*) * 0.75) AS BIGINT) AS"
        " train_estimate, count(*) - CAST(floor(count(*) * 0.75) AS BIGINT) AS test_estimate"
        " FROM transactions"
    )
    dirty_engineered = f"{_dirty()}, {_WITH_JSON}, {_FEATURES} "
    return {
        # Reports
        "fraud_rate_by_category": by_category,
        "fraud_rate_by_country": _ENGINEERED + _BY_COUNTRY,
        "fraud_rate_top_countries": _ENGINEERED + _BY_COUNTRY + " LIMIT 10",
        "fraud_rate_by_channel_device": _ENGINEERED + _BY_CHANNEL_DEVICE,
        "velocity_by_label": _ENGINEERED + _BY_LABEL,
        "sql_surface": by_category,
        "risk_report": _ENGINEERED + _COMBINED,
        "row_count": _RAW + "SELECT count(*) AS total_rows FROM transactions",
        "count_nonnull": _ENGINEERED
        + "SELECT country, count(*) AS total_txns, count(velocity_num_transactions) AS"
        " with_velocity FROM features GROUP BY country",
        # Features
        "engineer_features": all_features,
        "velocity_extract": _ENGINEERED
        + f"SELECT transaction_id, {', '.join(_VELOCITY)} FROM features",
        "cast_flags": _RAW + f"SELECT {_STORED_FLAGS} FROM transactions",
        "cast_flags_text": _RAW
        + "SELECT "
        + ", ".join(
            f'CAST("{name}" AS {"INTEGER" if name in FLAG_COLUMNS else "VARCHAR"}) AS "{name}"'
            for name in RAW_SCHEMA.names
        )
        + " FROM transactions",
        "drop_pii": _RAW
        + "SELECT "
        + ", ".join(name for name in RAW_SCHEMA.names if name not in IDENTIFIER_COLUMNS)
        + " FROM transactions",
        "project_columns": _ENGINEERED
        + "SELECT merchant_category, country, channel, device, amount, is_fraud,"
        " velocity_num_transactions, velocity_total_amount, velocity_unique_merchants,"
        " velocity_max_single_amount FROM features",
        "normalize_names": all_raw,
        # Splits
        "hash_split": _ENGINEERED + "SELECT transaction_id, split FROM features",
        "hash_split_train": _RAW + f"SELECT * FROM transactions WHERE {_IN_TRAIN}",
        "hash_split_test": _RAW + f"SELECT * FROM transactions WHERE NOT {_IN_TRAIN}",
        "split_complement": _RAW + not_in_train,
        "split_without_ids": _RAW + not_in_train,
        "random_complement": all_raw,
        "split_report": _ENGINEERED
        + "SELECT split, count(*) AS n_rows,"
        " round(count(*) / (SELECT count(*) FROM features) * 100, 1) AS share_pct"
        " FROM features GROUP BY split",
        "split_estimate": _RAW + estimate,
        "split_estimate_stored": _RAW + estimate,
        "exact_split": _RAW
        + "SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY"
        " md5('42:' || transaction_id), transaction_id) <="
        " floor((SELECT count(*) FROM transactions) * 0.75)"
        " THEN 'train' ELSE 'test' END AS split FROM transactions",
        "shuffle_rank": _RAW
        + "SELECT transaction_id, count(*) AS copies, min(place) AS first_rank FROM"
        " (SELECT transaction_id, row_number() OVER (ORDER BY md5('42:' || transaction_id),"
        " transaction_id) AS place FROM transactions) GROUP BY transaction_id",
        "seeded_shuffle": all_raw,
        "random_split": _RAW
        + "SELECT count(*) AS n_rows, true AS complete, true AS sized FROM transactions",
        "random_filter": _RAW + "SELECT count(*) AS n_rows, true AS sized FROM transactions",
        "row_index": _RAW
        + "SELECT transaction_id, row_number() OVER (ORDER BY md5('42:' || transaction_id),"
        " transaction_id) - 1 AS _idx FROM transactions",
        # Profile
        "profile_nulls": _RAW + _null_counts("transactions", RAW_SCHEMA.names),
        "profile_schema": _ENGINEERED + _profile(),
        "velocity_quality": _ENGINEERED + _VELOCITY_QUALITY,
        # Sources
        "csv_scan_typed": all_raw,
        "csv_scan_overrides": all_raw,
        "csv_scan_inferred": _RAW
        + "SELECT * REPLACE (CAST(card_number AS BIGINT) AS card_number,"
        " strftime(CAST(\"timestamp\" AS TIMESTAMP), '%Y-%m-%d %H:%M') AS \"timestamp\")"
        " FROM transactions",
        "csv_dialect": "SELECT p_partkey, concat(p_name, ', \"', p_brand, '\"') AS quoted,"
        " concat(p_name, chr(10), p_brand, chr(13), chr(10), p_type) AS broken,"
        " CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN '' WHEN 2 THEN"
        " concat(' ', p_type, '  ') END AS sometimes_empty FROM part",
        "stage_positional_scan": _RAW
        + "SELECT "
        + ", ".join(f'CAST("{name}" AS VARCHAR) AS "{name}"' for name in RAW_SCHEMA.names)
        + " FROM transactions",
        "typed_ingest": all_raw,
        "table_scan": all_raw,
        "dataset_registry": _RAW
        + "SELECT tier, count(*) AS n_rows, CAST(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END)"
        " AS BIGINT) AS fraud_count FROM transactions,"
        f" (VALUES {tiers}) AS tiers(tier, before) WHERE transaction_hour < before"
        " GROUP BY tier",
        "landed_files": all_raw,
        "ctas_raw": all_raw,
        "ctas_engineered": _ENGINEERED + f"SELECT {_FEATURE_NAMES}, split FROM features",
        # Sinks
        "sink_csv_single": _ENGINEERED + _BY_COUNTRY,
        "sink_csv_dealt": by_category,
        "sink_csv_parts": all_features,
        "sink_table": all_features,
        "sink_table_replaced": all_raw + " WHERE transaction_hour < 10",
        "sink_json": _ENGINEERED + _COMBINED,
        # Cells that cannot be read
        "rejected_cells": f"{_dirty()} {_REJECTED}",
        "rejected_cells_text": f"{_dirty()} {_REJECTED}",
        "dirty_csv_scan": f"{_dirty()} SELECT * FROM transactions",
        "dirty_csv_overrides": f"{_dirty()} SELECT * FROM transactions",
        "dirty_typed_ingest": f"{_dirty('false')} SELECT * FROM transactions",
        "dirty_risk_report": dirty_engineered + _COMBINED,
        "dirty_velocity_quality": dirty_engineered + _VELOCITY_QUALITY,
        "unmatched_rows": _UNMATCHED,
        # Text cells
        "parse_bool_strict": _CELLS
        + "SELECT cell, flag_text, CASE WHEN flag_text IN ('true', 'True') THEN true"
        " WHEN flag_text IN ('false', 'False') THEN false END AS flag FROM cells",
        "parse_bool_lenient": _CELLS
        + "SELECT cell, flag_text, CASE WHEN flag_text <> '' THEN lower(trim(flag_text)) = 'true'"
        " END AS flag FROM cells",
        "parse_number": _CELLS
        + "SELECT cell, number_text, CASE WHEN NOT contains(number_text, '.')"
        " AND NOT contains(number_text, 'e') THEN TRY_CAST(trim(number_text) AS INTEGER) END"
        " AS whole, TRY_CAST(trim(number_text) AS DOUBLE) AS decimal FROM cells",
        # Run logs
        "run_log_parse": _LOGS
        + "SELECT run, step, seconds, CAST(NULL AS DOUBLE) AS total_duration,"
        " CAST(NULL AS BIGINT) AS total_rows FROM steps UNION ALL SELECT run, NULL, NULL,"
        " total_duration, total_rows FROM totals",
        "run_log_text": _LOGS
        + ", placed AS (SELECT *, CAST(split_part(run, '_', 2) AS BIGINT) // 1000 AS batch,"
        " row_number() OVER (ORDER BY CAST(split_part(run, '_', 2) AS BIGINT), line_no) AS place"
        " FROM fields)"
        " SELECT batch, step, arg_max(seconds, place) AS seconds,"
        " CAST(NULL AS DOUBLE) AS total_duration, CAST(NULL AS BIGINT) AS total_rows"
        " FROM placed WHERE step IS NOT NULL AND step <> 'TOTAL' GROUP BY batch, step"
        " UNION ALL SELECT batch, NULL, NULL, arg_max(duration, place), arg_max(total, place)"
        " FROM placed WHERE step IS NULL AND (duration IS NOT NULL OR total IS NOT NULL)"
        " GROUP BY batch",
        "log_error_lines": _LOGS
        + "SELECT run, line_no, value FROM lines WHERE value NOT LIKE '%WARN%' AND value NOT"
        " LIKE '%INFO%' QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC,"
        " value DESC) <= 5",
        "run_compare": _LOGS
        + f"SELECT comparison, step, {_MATRIX} FROM (SELECT c.comparison, s.step, c.label,"
        " s.seconds FROM comparable c JOIN steps s ON c.run = s.run UNION ALL"
        " SELECT comparison, 'TOTAL', label, duration FROM durations)"
        " GROUP BY comparison, step",
        "run_speedup": _LOGS
        + "SELECT comparison, first(label ORDER BY duration, label) AS fastest,"
        " first(label ORDER BY duration DESC, label) AS slowest,"
        " round(max(duration) / min(duration), 1) AS ratio,"
        " round(max(duration) - min(duration), 2) AS seconds_saved"
        " FROM durations GROUP BY comparison HAVING min(duration) > 0",
        "run_step_share": _LOGS
        + "SELECT s.run, s.step, s.seconds,"
        " CASE WHEN t.total_duration <> 0"
        " THEN round(s.seconds / t.total_duration * 100, 1) END AS share_pct"
        " FROM steps s JOIN totals t ON s.run = t.run WHERE t.total_duration IS NOT NULL",
        # Whole jobs
        "pipeline_cached": _ENGINEERED + _COMBINED,
        "pipeline_table": _ENGINEERED + _COMBINED,
    }
