"""Hadoop file system access: works for local paths and object stores alike."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The few file operations the stores need; only metadata passes through the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)))

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def write_text(self, path: str, text: str) -> None:
        """Write next to the target, then swap it in, so that readers never see half a file."""
        part = f"{path}.part"
        out = self._fs.create(self._path(part), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self._jvm.java.lang.Enum.valueOf(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
        fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(part), self._path(path), options)

    def create_text(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet, whole or not at all; False where another writer was first.

        The text is written aside and then linked (local files) or renamed without overwriting to its place, which one
        writer alone succeeds with; a store without such a rename can't be shared by several writers.
        """
        target = self._path(path)
        part = self._path(f"{path}.{uuid.uuid4().hex}.part")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                nio = self._jvm.java.nio.file
                one, other = (nio.Path.of(self._fs.makeQualified(p).toUri()) for p in (target, part))
                nio.Files.createLink(one, other)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                context.rename(part, target, self._jvm.java.lang.reflect.Array.newInstance(kind, 0))
            return True
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        finally:
            self._fs.delete(part, False)

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def head(self, path: str, n: int = 8) -> bytes:
        """The first bytes of a file (of the first data file of a folder)."""
        p = self._path(path)
        if self._fs.getFileStatus(p).isDirectory():
            inner = [x for x in self.names(path) if not x.startswith(("_", "."))]
            return self.head(f"{path.rstrip('/')}/{inner[0]}", n) if inner else b""
        stream = self._fs.open(p)
        try:
            out = []
            while len(out) < n and (b := stream.read()) >= 0:
                out.append(b)
            return bytes(out)
        finally:
            stream.close()
