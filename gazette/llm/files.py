"""Binary files of tasks in the shared folder: whole or absent, whichever attempt wrote them."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from gazette.scale import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor reaches."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def write_whole(folder: str, name: str, chunks) -> tuple[str, int]:
    """Write byte chunks to folder/name under a name of the attempt, then rename; gives path and size."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    context = TaskContext.get()
    partial = f"{root}/.{name}.{context.taskAttemptId() if context else 0}"
    size = 0
    with fs.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(partial, f"{root}/{name}")
    return f"{folder}/{name}", size


class RangeReader:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def read(self, offset: int, size: int) -> bytes:
        return bytes(self.file.read_at(size, offset))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
