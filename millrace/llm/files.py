"""Open files of the shared folder from executors, by URI."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path: of file, HDFS and object store URIs, and of absolute local paths."""
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    where, path = locate(uri)
    where.create_dir(path, recursive=True)


def write_to(uri: str):
    where, path = locate(uri)
    return where.open_output_stream(path, compression=None)


def read_from(uri: str):
    """Seekable."""
    where, path = locate(uri)
    return where.open_input_file(path)
