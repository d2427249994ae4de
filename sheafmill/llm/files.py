"""Files of the shared folder, by the full URIs that `shared_dir` gives."""

from __future__ import annotations

import re

import pyarrow.fs as fs


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme would be another place on each machine, so it is refused."""
    if ":/" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if re.match("file:/(?!/)", uri) else uri)


def opened(uri: str, mode: str = "r"):
    """A seekable input ("r") or a sequential output ("w", with the folders above it)."""
    system, path = _located(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None, buffer_size=1 << 20)
