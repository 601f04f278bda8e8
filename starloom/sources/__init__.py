"""Raw tables: schemas, readers and the benchmark adapter."""

from starloom.sources.readers import load_counts, load_sources, scan_csv, scan_rejects
from starloom.sources.schemas import SOURCE_SCHEMAS, SOURCE_TABLES

__all__ = ["SOURCE_SCHEMAS", "SOURCE_TABLES", "load_counts", "load_sources", "scan_csv", "scan_rejects"]
