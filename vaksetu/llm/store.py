"""Files beside the rows: what a stage writes to the shared folder for the tasks of a later one."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from ..runtime import shared_dir


def file_system(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def remove(folder: str) -> None:
    files, path = file_system(folder)
    with contextlib.suppress(OSError):
        files.delete_dir(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder. It is removed when the driver ends: results are lazy, so what reads it may run until then."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, folder)
    return folder
