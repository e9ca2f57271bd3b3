"""Raw archives: a bz2 tar is unpacked once; Spark reads single ``.jsonl.bz2`` files as they are."""

from __future__ import annotations

import tarfile
from pathlib import Path

from .jsonl import FILES


def unpacked(archive: str, folder: str, marker: str = FILES["train"]) -> str:
    """The folder with the archive's members. Where the marker file is there already nothing is done; members that would leave the
    folder are refused."""
    target = Path(folder)
    if not (target / marker).exists():
        target.mkdir(parents=True, exist_ok=True)
        with tarfile.open(archive, "r:*") as tar:
            tar.extractall(target, filter="data")
    return folder
