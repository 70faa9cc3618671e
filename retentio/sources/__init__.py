"""Sources and sinks: driver tables, the subscriber view, CSV/Parquet scans, model storage."""

from retentio.sources.tables import read_table
from retentio.sources.subscribers import subscribers_raw, RAW_COLUMNS
from retentio.sources.io import (
    SUBSCRIBER_SCHEMA, scan_subscribers, load_or_build, table_available,
    save_table, load_table,
)

__all__ = [
    "read_table", "subscribers_raw", "RAW_COLUMNS", "SUBSCRIBER_SCHEMA",
    "scan_subscribers", "load_or_build", "table_available", "save_table", "load_table",
]
