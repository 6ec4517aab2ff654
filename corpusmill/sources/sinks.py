"""Files that Spark's own writers cannot make: JSON array files, and documents of many parts.

Both are one batch sink on the Python Data Source API. Tasks write below a folder of the
job; commit moves what succeeded into place and abort drops the folder, so that a failed or
repeated task leaves nothing behind. Files are reached through ``pyarrow.fs`` (local, HDFS,
S3, GCS), by the tasks as by commit.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

COPY_BYTES = 4 << 20


def open_filesystem(uri: str):
    """(file system, path in it) of a path or URI as Spark writes it."""
    from pyarrow import fs

    if ":/" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """(document, partition, temporary file) of what a task has written."""

    files: list[tuple[str, int, str]]


class JsonFilesWriter(DataSourceWriter):
    def __init__(self, path: str, layout: str):
        self.path, self.layout, self.job = path.rstrip("/"), layout, uuid.uuid4().hex

    def _below(self) -> tuple:
        found, root = open_filesystem(self.path)
        return found, root, f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        found, _, temporary = self._below()
        context = TaskContext.get()
        folder = f"{temporary}/{context.partitionId()}-{context.taskAttemptId()}"
        files: list[tuple[str, int, str]] = []
        out, current = None, None
        arrays = self.layout == "arrays"
        try:
            for row in iterator:
                document = "" if arrays else row[0]
                if out is None or document != current:
                    if out is not None:
                        out.close()
                    found.create_dir(folder, recursive=True)
                    files.append((document, context.partitionId(), f"{folder}/{len(files)}"))
                    out, current = found.open_output_stream(files[-1][2]), document
                    out.write(b"[" if arrays else b"")
                    between = b"\n"
                if arrays:
                    out.write(between + row[0].encode())
                    between = b",\n"
                else:
                    out.write(row[1].encode())
            if out is not None and arrays:
                out.write(b"\n]\n")
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        found, root, temporary = self._below()
        found.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if self.layout == "arrays":
            for _, partition, file in files:
                found.move(file, f"{root}/part-{partition:05d}-{self.job}.json")
        else:
            self._join(found, root, temporary, files)
        if files:
            found.delete_dir(temporary)

    def _join(self, found, root: str, temporary: str, files: list[tuple[str, int, str]]) -> None:
        """Parts of each document one after the other, a few MB at a time; one move shows it whole."""
        parts: dict[str, list[tuple[int, str]]] = {}
        for document, partition, file in files:
            parts.setdefault(document, []).append((partition, file))
        for document, pieces in parts.items():
            whole = f"{temporary}/{uuid.uuid4().hex}"
            with found.open_output_stream(whole) as out:
                for _, file in sorted(pieces):
                    with found.open_input_stream(file) as piece:
                        while block := piece.read(COPY_BYTES):
                            out.write(block)
            found.move(whole, f"{root}/{document}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        found, _, temporary = self._below()
        if found.get_file_info(temporary).type.name == "Directory":
            found.delete_dir(temporary)


class JsonFiles(DataSource):
    """``layout`` ``arrays``: rows (value), an array file per task; ``documents``: rows (document, fragment)."""

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("give a new path: files in place are not replaced")
        return JsonFilesWriter(self.options["path"], self.options["layout"])


# Workers need not have the package to unpickle the sink.
register_pickle_by_value(sys.modules[__name__])


def _save(df: DataFrame, path: str, layout: str) -> None:
    df.sparkSession.dataSource.register(JsonFiles)
    df.write.format("json_files").option("layout", layout).mode("append").save(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One file per task, each a valid JSON array with a record a line; NULL fields are kept.

    A table without rows gives no file. The files are added to those in ``path``.
    """
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    _save(df.select(record.alias("value")), path, "arrays")


def write_documents(fragments: DataFrame, path: str, order: list[str], document: str = "document", fragment: str = "fragment") -> None:
    """One file per value of ``document``: its fragments in ``order``, one after the other.

    Fragments are sorted in ranges over all tasks; a document may span any number of them.
    A document of the same name is replaced.
    """
    keys = [F.col(document), *[F.col(c) for c in order]]
    ranged = fragments.repartitionByRange(*keys).sortWithinPartitions(*keys)
    _save(ranged.select(F.col(document).cast("string"), F.col(fragment).cast("string")), path, "documents")
