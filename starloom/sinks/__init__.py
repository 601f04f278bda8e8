"""Publishing the star."""

from starloom.sinks.files import (
    Published,
    clean_published,
    expire_published,
    export_csv,
    export_text,
    publish_parquet,
    publish_version,
    published_versions,
    read_published,
    read_version,
    verify_published,
)
from starloom.sinks.jdbc import jdbc_options, publish_jdbc

__all__ = [
    "Published",
    "clean_published",
    "expire_published",
    "export_csv",
    "export_text",
    "jdbc_options",
    "publish_jdbc",
    "publish_parquet",
    "publish_version",
    "published_versions",
    "read_published",
    "read_version",
    "verify_published",
]
