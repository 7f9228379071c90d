"""Files in the shared folder, written and read by tasks.

Any file system that pyarrow knows by its URI will do.  A file appears under
its name only when it is whole, and a task that runs again writes the same
bytes under the same name."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def whole_file(uri: str, name: str) -> Iterator:
    """A new file for writing; it takes its name when the block ends well."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    early = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(early) as out:
            yield out
        if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
            system.delete_file(early)  # another attempt of the task was first, with the same bytes
        else:
            system.move(early, f"{folder}/{name}")
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(early)
        raise


def for_reading(uri: str):
    """A file for range reads."""
    system, path = open_folder(uri)
    return system.open_input_file(path)
