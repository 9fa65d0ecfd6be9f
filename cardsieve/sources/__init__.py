"""Where rows come from: CSV, catalog tables, named data sets, logs, derived tables."""

from cardsieve.sources.csv import (
    scan_inferred,
    scan_overrides,
    scan_positional,
    scan_text,
    scan_typed,
)
from cardsieve.sources.footers import stored_rows
from cardsieve.sources.landing import land_files, landed_rows, read_manifest
from cardsieve.sources.logs import read_run_logs
from cardsieve.sources.registry import (
    CsvSource,
    TableSource,
    check_registry,
    csv_registry,
    read_dataset,
    table_registry,
)
from cardsieve.sources.rejects import rejected_by_typing, rejected_cells
from cardsieve.sources.tables import (
    ensure_schema,
    normalize_names,
    register_table,
    scan_table,
    use_schema,
)

__all__ = [
    "CsvSource",
    "TableSource",
    "check_registry",
    "csv_registry",
    "ensure_schema",
    "land_files",
    "landed_rows",
    "normalize_names",
    "read_dataset",
    "read_manifest",
    "read_run_logs",
    "register_table",
    "rejected_by_typing",
    "rejected_cells",
    "scan_inferred",
    "scan_overrides",
    "scan_positional",
    "scan_table",
    "scan_text",
    "scan_typed",
    "stored_rows",
    "table_registry",
    "use_schema",
]
