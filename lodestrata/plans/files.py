"""Small files and folders in any store that Spark writes to."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        """What is in a folder, in order; nothing if there is no such folder."""
        at = self._path(self.path(name) if name else self.root)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def sizes(self, name: str) -> dict[str, int]:
        """Bytes of every file below a folder, by its path from there; hidden files and markers are left out."""
        at = self._path(self.path(name))
        if not self._fs.exists(at):
            return {}
        top, out, files = self._fs.getFileStatus(at).getPath().toString(), {}, self._fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            inner = f.getPath().toString()[len(top) + 1 :]
            if not inner.rpartition("/")[2].startswith(("_", ".")):
                out[inner] = f.getLen()
        return out

    def claim(self, name: str, body: bytes, stale_ms: int) -> bool:
        """Create a small file that nobody else has created; one older than stale_ms counts as left by a dead writer."""
        path = self._path(self.path(name))
        if self._fs.exists(path) and int(time.time() * 1000) - self._fs.getFileStatus(path).getModificationTime() > stale_ms:
            self._fs.delete(path, False)
        try:
            if not self._fs.createNewFile(path):
                return False
        except Py4JJavaError:
            return False
        out = self._fs.create(path, True)
        out.write(bytearray(body))
        out.close()
        return True

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(self._bytes.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, body: bytes) -> None:
        """A new file that is there whole or not at all: written under another name, then renamed."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(self.path(draft)), True)
        out.write(bytearray(body))
        out.close()
        self.move(draft, name)

    def move(self, old: str, new: str) -> None:
        if "/" in new:
            self._fs.mkdirs(self._path(self.path(new.rpartition("/")[0])))
        if not self._fs.rename(self._path(self.path(old)), self._path(self.path(new))):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)
