"""Binary files in the shared folder, on any store pyarrow can reach; local and mounted stores are memory-mapped."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        store, path = fs.FileSystem.from_uri(uri)
    else:
        store, path = fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(store, fs.LocalFileSystem) else store), path


class Writer:
    """Writes under a name of its own and takes the final name at the end, so that a repeated or late task does no harm."""

    def __init__(self, uri: str):
        self.fs, self.path = _at(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += memoryview(data).nbytes

    def close(self) -> int:
        self.out.close()
        self.fs.move(self.own, self.path)
        return self.size


def read_file(uri: str) -> pa.Buffer:
    """The whole file: pages of the map on a local or mounted store, else its bytes."""
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer(f.size())
