"""Where results go: CSV and JSON files, catalog tables, named views."""

from cardsieve.sinks.files import write_csv, write_json
from cardsieve.sinks.tables import drop_table, table_versions, write_split_tables, write_table

__all__ = [
    "drop_table",
    "table_versions",
    "write_csv",
    "write_json",
    "write_split_tables",
    "write_table",
]
