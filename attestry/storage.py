"""Small text files on any file system that Spark can reach."""

from __future__ import annotations

import fcntl
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Reads, replaces and lists small text files below ``root``, a URI or a local path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = (root if "://" in root else root if root.startswith("file:") else f"file://{root}").rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.root.removeprefix("file://") if self.root.startswith("file:") else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> str:
        try:
            s = self.fs.open(self._path(name))
        except Py4JJavaError as e:
            raise FileNotFoundError(name) from e
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def _put(self, path, text: str, overwrite: bool) -> None:
        out = self.fs.create(path, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, name: str, text: str) -> None:
        """The whole text or the former one is there, never a part: written beside and renamed over it."""
        temp, to = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        self._put(temp, text, False)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(temp, to, options)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    @contextmanager
    def locked(self, name: str, wait: float = 60.0, lease: float = 600.0):
        """Holds the lock ``name``: on a local disk the kernel's, elsewhere a file that only one can create.

        A lock file older than ``lease`` seconds belongs to a driver that is gone and is removed.
        """
        if self.local is not None:
            with open(f"{self.local}/{name}", "w") as f:
                fcntl.flock(f, fcntl.LOCK_EX)
                yield
            return
        path, until = self._path(name), time.time() + wait
        while True:
            try:
                self._put(path, str(time.time()), False)
                break
            except Py4JJavaError:
                if self.fs.exists(path) and time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 > lease:
                    self.fs.delete(path, False)
                elif time.time() > until:
                    raise TimeoutError(f"{name} is held") from None
                time.sleep(0.2)
        try:
            yield
        finally:
            self.fs.delete(path, False)
