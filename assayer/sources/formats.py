"""Format by file name."""

from __future__ import annotations

from assayer.errors import UnknownFormat


def format_of(path: str) -> str:
    """"csv" or "parquet", from the last suffix of the path."""
    suffix = path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    if suffix not in ("csv", "parquet"):
        raise UnknownFormat(path)
    return suffix
