"""Small files in a folder that driver and executors share, through Hadoop's file system interface."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFolder:
    """A folder on any file system that Spark reads: a local mount, HDFS or an object store.

    ``create`` puts a file in place only if there is none of its name, by a rename that
    doesn't overwrite, so that of two writers one fails. How far that is atomic is a
    matter of the file system: it is on HDFS and on local disks.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        """Names of the files, in order."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isFile())

    def folders(self) -> list[str]:
        """Names of the folders, in order."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory())

    def read(self, name: str) -> str | None:
        """The text of a file, none if there is no such file."""
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; raises FileExistsError if there is one of that name."""
        self._put(name, text, "NONE")

    def replace(self, name: str, text: str) -> None:
        """Write a file, in place of the one of that name."""
        self._put(name, text, "OVERWRITE")

    def _put(self, name: str, text: str, mode: str) -> None:
        temporary = self._path(f".{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        kinds = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        kinds[0] = self._jvm.java.lang.Enum.valueOf(kind, mode)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self._path(name)), kinds)
        except Exception as problem:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(problem):
                raise FileExistsError(f"{self.root}/{name}") from None
            raise
