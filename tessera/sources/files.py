"""Files of a store that Spark can reach, through Hadoop's file systems."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


class Store:
    """Small files and folders under any path Spark can read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def fs(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs(path).exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.fs(path).open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes the file under another name and renames it over the old one."""
        other = path + ".next"
        stream = self.fs(other).create(self.path(other), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs(path).getUri(), self.conf)
        context.rename(self.path(other), self.path(path), options)

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs(path).listStatus(self.path(path)) if s.isDirectory())

    def make(self, path: str) -> None:
        self.fs(path).mkdirs(self.path(path))

    def delete(self, path: str) -> None:
        self.fs(path).delete(self.path(path), True)

    def size(self, path: str) -> int:
        return self.fs(path).getContentSummary(self.path(path)).getLength() if self.exists(path) else 0

    def copy(self, source: str, target: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs(source), self.path(source), self.fs(target), self.path(target), False, self.conf)
