"""Where results go: named files from a binary column, JSON rows."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.batches import slices


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def stamped(kind: str, at: Column, name: Column | None = None) -> Column:
    """``template_<time>.docx``, ``filled_<time>.docx`` or ``uploaded_<time>_<name>``."""
    time = F.date_format(at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit(f"{kind}_"), time, F.lit(".docx") if name is None else F.concat(F.lit("_"), name))


def safe_name(name: Column) -> Column:
    """The last part of a name, with what a file name should not hold as underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/\\\\]*)$", 1), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+]*://", folder) or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, content: bytes) -> str:
    """Writes under a name of its own first, so a repeated or lost task leaves no half file."""
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{at}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def save_files(files: DataFrame, folder: str, fallback: str | None = None) -> DataFrame:
    """Writes each (name, content) as a file of its own below ``folder``, from the executors; an older one of the name is replaced.

    Gives name, path, size, warning, error. Where the folder can't be written, the file goes to ``fallback``, if
    given, with a warning; a file that is written nowhere has an error and no path. Both must be folders that all
    executors reach. A null content, as of a file that failed before, is an error. The writing happens when the result is read.
    """

    def run(batches):
        for b in slices(batches):
            rows = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                path = warning = error = None
                if name is None or content is None:
                    error = "no name or no content"
                else:
                    try:
                        path = _put(folder, name, content)
                    except Exception as e:  # noqa: BLE001 - told in the row
                        error = f"{type(e).__name__}: {e}"
                        if fallback is not None:
                            try:
                                path, warning, error = _put(fallback, name, content), f"not in {folder}: {error}", None
                            except Exception as e:  # noqa: BLE001
                                error = f"{error}; {type(e).__name__}: {e}"
                rows.append((name, path, None if content is None else len(content), warning, error))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["name", "path", "size", "warning", "error"])

    return files.select("name", "content").mapInArrow(run, "name string, path string, size long, warning string, error string")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, content) as Parquet below ``folder``: many small files in few large ones. Gives the names and sizes."""
    files.select("name", "content").write.mode("overwrite").parquet(folder)
    return files.sparkSession.read.parquet(folder).select("name", F.length("content").alias("size"))
