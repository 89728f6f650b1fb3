"""Sources and sinks: files, JDBC, landed pages / API payloads, the view registry."""

from sparkeda.sources.files import (read_csv, read_tsv, read_json, read_parquet, load, preview,
                                    read_pages, save, write_run_metadata, SUPPORTED_EXTENSIONS)
from sparkeda.sources.registry import Registry, make_key
from sparkeda.sources.jdbc import read_table, read_query, list_tables, table_schema, load_many
from sparkeda.sources.api import read_api_payloads

__all__ = ["read_csv", "read_tsv", "read_json", "read_parquet", "load", "preview", "read_pages",
           "save", "write_run_metadata", "SUPPORTED_EXTENSIONS", "Registry", "make_key",
           "read_table", "read_query", "list_tables", "table_schema", "load_many",
           "read_api_payloads"]
