"""Binary files in the shared folder, written and read by executors through whatever store its URI names."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str, suffix: str) -> str:
    """A name that no other attempt of the task uses: a lost task leaves at worst a file that no manifest names."""
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}{suffix}"


def create(uri: str):
    at, path = store(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    return at.open_output_stream(path, compression=None)


def read(uri: str) -> bytes:
    at, path = store(uri)
    with at.open_input_stream(path, compression=None) as f:
        return f.read()


def read_at(uri: str, offset: int, size: int) -> bytes:
    at, path = store(uri)
    with at.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


def stream(uri: str):
    at, path = store(uri)
    return at.open_input_stream(path, compression=None)
