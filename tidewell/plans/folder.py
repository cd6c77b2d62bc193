"""Small files of a store, in any file system that Spark reaches."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Folder:
    """A folder by path or URI. Without a session it is a local one."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path.rstrip("/"), spark
        if spark is not None:
            self._hadoop = spark._jvm.org.apache.hadoop.fs
            self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def _at(self, name: str):
        return self._hadoop.Path(self.at(name))

    def make(self) -> None:
        if self.spark is None:
            os.makedirs(self.path, exist_ok=True)
        else:
            self._fs.mkdirs(self._at(""))

    def exists(self, name: str) -> bool:
        return os.path.exists(self.at(name)) if self.spark is None else self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        if self.spark is None:
            return os.listdir(self.at(name))
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]

    def read(self, name: str) -> str:
        if self.spark is None:
            with open(self.at(name)) as f:
                return f.read()
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file in one step: a reader finds the old text or the new one."""
        self.make()
        if self.spark is None:
            with open(self.at(f"{name}.new"), "w") as f:
                f.write(text)
            os.replace(self.at(f"{name}.new"), self.at(name))
            return
        out = self._fs.create(self._at(f"{name}.new"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._at(f"{name}.new")), self._fs.makeQualified(self._at(name)), how)

    def remove(self, name: str) -> None:
        if self.spark is not None:
            self._fs.delete(self._at(name), True)
        elif os.path.isdir(self.at(name)):
            import shutil

            shutil.rmtree(self.at(name))
        elif os.path.exists(self.at(name)):
            os.remove(self.at(name))

    def create_once(self, name: str, text: str) -> bool:
        """Makes a file that doesn't exist yet; False if it does."""
        if self.exists(name):
            return False
        self.write(name, text)
        return True
