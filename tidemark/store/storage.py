"""Small files beside the data, on any file system that Hadoop knows by its URI."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


class Storage:
    """A folder of one file system. Names are relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.fs: JavaObject = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root: str = self.fs.makeQualified(path).toString().rstrip("/")

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _path(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file that appears whole; it must not exist."""
        if self.exists(name):
            raise FileExistsError(self.uri(name))
        folder, _, base = name.rpartition("/")
        aside = f"{folder}/.{base}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self._path(aside), self._path(name)):
            raise FileExistsError(self.uri(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder in order, without hidden ones."""
        if not self.exists(folder):
            return []
        found = (status.getPath().getName() for status in self.fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith("."))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def relative(self, uri: str) -> str:
        return uri.removeprefix(self.root + "/")
