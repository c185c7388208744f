"""Binary files in the shared folder, written and range-read by tasks.

Paths are addresses as the cluster names them (file:, hdfs:, s3:, ...). A task writes under a name of its own
attempt and reports it in a row; only files in the written manifest count, so a lost or repeated
task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def attempt_name(prefix: str, suffix: str) -> tuple[int, str]:
    """The task's partition, and a file name that no other attempt has."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return part, f"{prefix}-{part:05d}-{uuid.uuid4().hex}{suffix}"


def read_range(system: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with system.open_input_file(path) as source:
        source.seek(start)
        return source.read(size)
