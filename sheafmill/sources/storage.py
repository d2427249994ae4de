"""Whole files by path or URI, in whatever file system tasks share."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as fs


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def remove(folder: str) -> None:
    """A folder and all below it, if it is there."""
    system, name = _located(folder)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)


def read_bytes(path: str) -> bytes:
    system, name = _located(path)
    with system.open_input_stream(name, compression=None) as file:
        return file.read()


def write_bytes(path: str, data: bytes) -> None:
    """Whole or not at all: a task that is run again replaces its own file."""
    system, name = _located(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(part, compression=None) as file:
        file.write(data)
    system.move(part, name)
