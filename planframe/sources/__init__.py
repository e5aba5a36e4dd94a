"""Files: CSV and columnar (Parquet), read and written."""

from .columnar import read_columnar, read_columns, table_types, write_columnar
from .csv import read_csv, write_csv

__all__ = ["read_columnar", "read_columns", "read_csv", "table_types", "write_columnar", "write_csv"]
