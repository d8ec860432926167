"""Files that executors write to and read from the shared folder: any place that pyarrow's file systems reach.

Each task attempt writes files of its own names; the manifest, a Spark table, lists those of the attempts that counted, so a
lost executor or a second attempt leaves files that nobody reads, never half of one that somebody does.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def attempt_file(folder: str, suffix: str, n: int = 0) -> str:
    """A new path under folder for the n-th file of this task attempt."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/part-{part:06d}-{n:04d}-{uuid.uuid4().hex[:12]}{suffix}"


class Source:
    """Random access to a file by URI."""

    def __init__(self, uri: str) -> None:
        system, path = place(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()


def create(uri: str):
    system, path = place(uri)
    return system.open_output_stream(path, compression=None)  # by default the suffix would add another compression
