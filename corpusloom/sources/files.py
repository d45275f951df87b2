"""Files as Python tasks see them: any file system that pyarrow knows."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def hidden(path: str, base: str) -> bool:
    """Marker files and hidden folders below ``base``, as Spark's reader passes them over."""
    return any(part.startswith((".", "_")) for part in path.removeprefix(base).split("/"))
