"""Numbered commits of a folder: JSON files, each of which can be made once."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._strings, self._gateway = spark._jvm.org.apache.commons.io.IOUtils, spark.sparkContext._gateway

    def _at(self, name: str) -> tuple[Any, Any]:
        at = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self._conf), at

    def names(self, name: str = "") -> dict[str, int]:
        """What lies in a folder below, with the times of the last change in milliseconds; nothing if it isn't there."""
        store, at = self._at(name)
        return {s.getPath().getName(): s.getModificationTime() for s in store.listStatus(at)} if store.exists(at) else {}

    def size(self, name: str = "") -> int:
        """Bytes of all that lies below."""
        store, at = self._at(name)
        return store.getContentSummary(at).getLength() if store.exists(at) else 0

    def text(self, name: str) -> str:
        store, at = self._at(name)
        stream = store.open(at)
        try:
            return self._strings.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Makes a file, whole or not at all; False if there is one. It is written beside and renamed, which doesn't replace a file."""
        store, at = self._at(name)
        _, draft = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        stream = store.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        files = self._hadoop.FileContext.getFileContext(at.toUri(), self._conf)
        options = self._gateway.new_array(self._gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, at, options)
        except Exception as e:
            store.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        store, at = self._at(name)
        store.delete(at, True)


class Commits:
    """The versions of something in a folder: 1, 2, ... as files in `commits`."""

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def versions(self) -> dict[int, int]:
        """Number and time of all versions that are kept."""
        return {int(n[:-5]): t for n, t in self.folder.names("commits").items() if n.endswith(".json") and not n.startswith(".")}

    def read(self, version: int) -> dict[str, Any]:
        return json.loads(self.folder.text(f"commits/{version:012}.json"))

    def newest(self) -> tuple[int, dict[str, Any]]:
        """The last version and its content; 0 and nothing if there is none."""
        version = max(self.versions(), default=0)
        return version, self.read(version) if version else {}

    def add(self, version: int, content: dict[str, Any]) -> bool:
        """Commits a version; False if another writer has done so."""
        return self.folder.create(f"commits/{version:012}.json", json.dumps(content))

    def drop(self, version: int) -> None:
        self.folder.remove(f"commits/{version:012}.json")
