"""Binary files in the shared folder, written and read by tasks themselves.

A file is written under a name of its attempt and then moved to its own name, so a task that is
run again replaces what it wrote, and a reader never sees half a file.
"""

from __future__ import annotations

import posixpath
import uuid
from typing import BinaryIO


def _open_root(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(path: str, parts: list[bytes]) -> int:
    system, name = _open_root(path)
    system.create_dir(posixpath.dirname(name), recursive=True)
    attempt = f"{name}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(attempt, compression=None) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    system.move(attempt, name)
    return size


def open_file(path: str) -> BinaryIO:
    system, name = _open_root(path)
    return system.open_input_stream(name, compression=None)  # bytes as they stand: by default a name in .gz would be inflated


def read_file(path: str) -> bytes:
    system, name = _open_root(path)
    with system.open_input_file(name) as f:
        return f.read()
