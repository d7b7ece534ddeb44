"""Loaders for Parquet and delimited benchmark files, and the derived star schema."""

from tessera.sources.derive import Star
from tessera.sources.tables import Tables, cache_columnar, load_ssb, load_tpch, read_golden, read_tbl

__all__ = ["Star", "Tables", "cache_columnar", "load_ssb", "load_tpch", "read_golden", "read_tbl"]
