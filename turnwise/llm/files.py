"""Files that tasks write to and read from a shared folder, through pyarrow's file systems.

A file is written under a name of its own attempt and then moved, so a retried or speculative task leaves one whole file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:/"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A binary stream whose content appears at uri once the block ends well."""
    system, path = opened(uri)
    folder, _, name = path.rpartition("/")
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(own, compression=None) as out:
            yield out
        system.move(own, path)
    except BaseException:
        try:
            system.delete_file(own)
        except OSError:
            pass
        raise


def reading(uri: str, random: bool = False):
    system, path = opened(uri)
    return system.open_input_file(path) if random else system.open_input_stream(path, compression=None)
