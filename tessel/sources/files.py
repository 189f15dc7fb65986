"""Small files on any file system that Spark's own Hadoop client reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        at = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def bytes(self, folder: str) -> tuple[int, int]:
        """The number of files below a folder and their size."""
        at = self._path(self.at(folder))
        if not self._fs.exists(at):
            return 0, 0
        s = self._fs.getContentSummary(at)
        return s.getFileCount(), s.getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publishes a new file whole or not at all; False if it exists. The text is written beside it
        and closed first, then takes the name: by a hard link on a local disk, else by a rename that
        does not overwrite."""
        at, beside = self._path(self.at(name)), self._path(self.at(f"{name}.{uuid.uuid4().hex}.tmp"))
        out = self._fs.create(beside, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(at), local(beside))
            else:
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                files.rename(beside, at, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if self._fs.exists(at):
                return False
            raise e
        finally:
            self._fs.delete(beside, False)
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
