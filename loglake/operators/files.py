"""Small file operations through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Store:
    """Paths are relative to ``root``. Only catalog-sized objects pass through the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def full(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _at(self, path: str):
        return self._path(self.full(path))

    def read(self, path: str) -> bytes | None:
        if not self._fs.exists(self._at(path)):
            return None
        stream = self._fs.open(self._at(path))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Replaces the object: a new file is put in place of the old one."""
        temp = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(temp), True)
        stream.write(bytearray(data))
        stream.close()
        self._fs.delete(self._at(path), False)
        if not self._fs.rename(self._at(temp), self._at(path)):
            raise OSError(f"cannot write {path}")

    def create(self, path: str, data: bytes) -> bool:
        """Writes the object unless it exists; of concurrent creators exactly one succeeds."""
        if self.root.startswith("file:"):
            final = self.full(path).removeprefix("file://").removeprefix("file:")
            os.makedirs(os.path.dirname(final), exist_ok=True)
            temp = f"{final}.{uuid.uuid4().hex}"
            with open(temp, "wb") as f:
                f.write(data)
            try:
                os.link(temp, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        try:
            stream = self._fs.create(self._at(path), False)
        except Exception as e:  # py4j wraps the store's own exception
            if "Exist" in str(e):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def list(self, path: str) -> list[tuple[str, int]]:
        """(name, bytes) of the entries of a folder, none if it is absent."""
        if not self._fs.exists(self._at(path)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._at(path)))

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._at(target).getParent())
        if self._fs.exists(self._at(target)):
            self._fs.delete(self._at(source), False)
        elif not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def probe(self) -> bool:
        """Whether an object can be written, read back and deleted."""
        name, body = f"_loglake/probe-{uuid.uuid4().hex}", uuid.uuid4().hex.encode()
        self.write(name, body)
        try:
            return self.read(name) == body
        finally:
            self.delete(name)
