"""Named files as a sink with a commit: all files of a write appear, or none.

A task writes its files to a folder of its own attempt below ``.staged``; the files
of the attempts that count are moved to their places when all tasks are done, and
the rest goes. A failed, repeated or speculative task adds no file, and a write that
fails leaves the files as they were. Tasks that outlive a failed write may leave its
hidden folder of staged files, which ``clear_staged`` removes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from palimpsest.sources.sinks import _store

NAME = "palimpsest_files"


@dataclass
class _Attempt(WriterCommitMessage):
    """An attempt's folder; its files are listed there, so messages stay small."""

    folder: str


class _Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names.index("name"), schema.names.index("content"))


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, name: int, content: int):
        self.folder, self.name, self.content = folder.rstrip("/"), name, content
        self.staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Attempt:
        """Writes the files of one attempt of a task. A null name or content, or one name twice in a task, fails the write."""
        store, at = _store(f"{self.staged}/{uuid.uuid4().hex}")
        store.create_dir(at, recursive=True)
        names: set[str] = set()
        for row in rows:
            name, content = row[self.name], row[self.content]
            if name is None or content is None or "/" in name or name in ("", ".", "..") or name in names:
                raise ValueError(f"no file can be made of the name {name!r}")
            names.add(name)
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(bytes(content))
        return _Attempt(at)

    def _clear(self) -> None:
        store, at = _store(self.staged)
        if store.get_file_info(at).type.name == "Directory":
            store.delete_dir(at)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, at = _store(self.folder)
        found = [f for m in messages if m is not None for f in store.get_file_info(fs.FileSelector(m.folder))]
        if len({f.base_name for f in found}) < len(found):
            self._clear()
            raise ValueError("two files of one name in a write")
        for f in found:
            store.move(f.path, f"{at}/{f.base_name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


def clear_staged(folder: str, older: float = 86_400) -> int:
    """Removes what failed writes have left staged, where it is ``older`` seconds old; gives the number of folders removed."""
    from pyarrow import fs

    store, at = _store(folder.rstrip("/"))
    left = [f for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(".staged-") and f.mtime_ns / 1e9 < time.time() - older]
    for f in left:
        store.delete_dir(f.path)
    return len(left)


def write_committed(files: DataFrame, folder: str) -> None:
    """Writes each (name, content) as a file of its own below a folder that driver and executors share; older files of these names are replaced.

    The driver moves the files, so this is for thousands of files, not for millions (``sinks.write_files`` packs those).
    """
    spark = files.sparkSession
    spark.dataSource.register(_Files)
    files.select("name", "content").write.format(NAME).mode("append").option("path", folder).save()
