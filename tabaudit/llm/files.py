"""Files that executors write to and read from the shared folder: any store
that Arrow's file systems reach (a mounted folder, HDFS, S3, GCS)."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

from tabaudit.session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, as a URI or a path."""
    return scratch_path(spark, name)


class Store:
    """A folder of a file system. Files are made under a temporary name and
    committed by a rename, so that a name never stands for half a file, and
    an attempt that is run again replaces a file by an equal one."""

    def __init__(self, folder: str):
        from pyarrow import fs
        if folder.startswith("file:"):
            folder = "/" + folder[len("file:"):].lstrip("/")
        if "://" in folder:
            self.fs, self.root = fs.FileSystem.from_uri(folder)
        else:
            self.fs, self.root = fs.LocalFileSystem(), folder
        self.fs.create_dir(self.root, recursive=True)

    def _at(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def create(self, name: str):
        return self.fs.open_output_stream(self._at(name))

    def commit(self, temporary: str, final: str) -> None:
        self.fs.move(self._at(temporary), self._at(final))

    def open(self, name: str):
        return self.fs.open_input_file(self._at(name))


def open_store(folder: str) -> Store:
    return Store(folder)
