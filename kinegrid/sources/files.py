"""Files that tasks write and the job commits: they get their names when every task is done, or not at all.

A task writes under `_temporary`, in a folder of its own attempt, so that an attempt that is lost or repeated spoils nothing. The
commit moves the files of the attempts that count, writes their names and what the tasks note about them to `_committed.json`,
and deletes the rest. An abort deletes all. Paths are plain ones or of any file system that pyarrow opens (`file:`, `hdfs:`,
`s3:`, `gs:`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

TEMPORARY, COMMITTED = "_temporary", "_committed.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.rstrip("/"))


def open_stream(path: str) -> pa.NativeFile:
    """The bytes of a file as they are, read from the start on."""
    store, at = file_system(path)
    return store.open_input_stream(at, compression=None)


@dataclass
class Written(WriterCommitMessage):
    """What one task's attempt leaves: its folder, the names of its files, and its notes."""

    attempt: str
    names: list[str]
    notes: list[dict[str, Any]]


class TaskFiles:
    """The files of one attempt of a task."""

    def __init__(self, root: str):
        self.store, self.root = file_system(root)
        self.attempt, self.names = uuid.uuid4().hex, []
        self.folder = f"{self.root}/{TEMPORARY}/{self.attempt}"

    def create(self, name: str) -> pa.NativeFile:
        """A new file for the caller to write and close."""
        at = f"{self.folder}/{name}"
        self.store.create_dir(at.rpartition("/")[0], recursive=True)
        self.names.append(name)
        return self.store.open_output_stream(at, compression=None)

    def remove(self, name: str) -> None:
        """Deletes a file of this attempt: the commit will not know it."""
        self.names.remove(name)
        self.store.delete_file(f"{self.folder}/{name}")

    def remove_all(self) -> None:
        if self.store.get_file_info(self.folder).type == fs.FileType.Directory:
            self.store.delete_dir(self.folder)
        self.names.clear()


Task = Callable[[Iterator[pa.RecordBatch], TaskFiles], Iterable[dict[str, Any]]]


class CommittingWriter(DataSourceArrowWriter):
    """Runs `task` over the rows of each partition; it creates files and yields notes about them."""

    def __init__(self, path: str, task: Task):
        self.path, self.task = path, task

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files = TaskFiles(self.path)
        try:
            notes = list(self.task(iterator, files))
        except BaseException:
            files.remove_all()
            raise
        return Written(files.attempt, files.names, notes)

    def _clear(self) -> None:
        store, root = file_system(self.path)
        if store.get_file_info(f"{root}/{TEMPORARY}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{TEMPORARY}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if isinstance(m, Written)]
        names = [(m.attempt, n) for m in done for n in m.names]
        if len({n for _, n in names}) < len(names):
            raise ValueError("two tasks wrote a file of the same name")
        for folder in {n.rpartition("/")[0] for _, n in names} - {""}:
            store.create_dir(f"{root}/{folder}", recursive=True)
        for attempt, name in names:
            store.move(f"{root}/{TEMPORARY}/{attempt}/{name}", f"{root}/{name}")
        with store.open_output_stream(f"{root}/{COMMITTED}") as out:
            out.write(json.dumps({"files": sorted(n for _, n in names), "notes": [x for m in done for x in m.notes]}).encode())
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


def save(rows: DataFrame, path: str, task: Task) -> dict[str, list[Any]]:
    """Writes `rows` by `task` and returns what `committed` tells."""

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "committed_files"

        def writer(self, schema: StructType, overwrite: bool) -> CommittingWriter:
            return CommittingWriter(path, task)

    rows.sparkSession.dataSource.register(Sink)
    rows.write.format("committed_files").mode("append").save()
    return committed(path)


def committed(path: str) -> dict[str, list[Any]]:
    """`files` and `notes` of a committed job."""
    with open_stream(f"{path.rstrip('/')}/{COMMITTED}") as found:
        return json.loads(found.read())
