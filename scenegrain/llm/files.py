"""Parquet files of the shared folder, opened in tasks."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyarrow import fs


def parquet_file(path: str) -> pq.ParquetFile:
    """A file by path or address (``file:/x`` and ``file:///x`` alike)."""
    if path.startswith("file:"):
        return pq.ParquetFile("/" + path.removeprefix("file:").lstrip("/"))
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(at, filesystem=system)
