"""Binary files in a store that every executor reaches: local or shared folders, HDFS and object stores by their URI."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(uri: str, parts, attempt: str) -> None:
    """Writes the byte parts under a name of the attempt's own, then moves it: a file is whole or absent, retries agree."""
    store, path = at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(own := f"{path}.{attempt}.partial") as out:
        for x in parts:
            out.write(x)
    store.move(own, path)


def read(uri: str):
    store, path = at(uri)
    return store.open_input_file(path)
