"""Small files and directories on any file system that Hadoop reaches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def delete(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)

    def list(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))] if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def read_json(self, path: str) -> dict:
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes) -> None:
        """Write beside the target, then replace it in one rename."""
        staged = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs(staged).create(self._path(staged), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        qualify = lambda p: context.makeQualified(self._path(p))
        context.rename(qualify(staged), qualify(path), options)

    def write_json(self, path: str, value: dict) -> None:
        self.write_bytes(path, json.dumps(value, ensure_ascii=False, indent=1).encode())
