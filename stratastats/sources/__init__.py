"""Readers with declared schemas, and tables parked in the cluster's shared folder."""

from .layout import PUBLISHED, Layout, Table
from .readers import Sources, read_json_records, read_preamble_table, read_tsv
from .scratch import scratch_path, written

__all__ = [
    "Layout",
    "PUBLISHED",
    "Sources",
    "Table",
    "read_json_records",
    "read_preamble_table",
    "read_tsv",
    "scratch_path",
    "written",
]
