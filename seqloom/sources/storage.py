"""Opening files by the URIs Spark lists, inside tasks."""

from __future__ import annotations

from pyarrow import fs


def filesystem(uri: str):
    """``(filesystem, path)`` for ``file:``, ``hdfs:``, ``s3:`` ... or a plain path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def open_random(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)


def open_sequential(uri: str):
    system, path = filesystem(uri)
    return system.open_input_stream(path, compression=None)


def write_bytes(uri: str, payload: bytes) -> None:
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(payload)
