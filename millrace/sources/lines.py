"""A growing file of lines as a stream that can go on after a restart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 4 << 20
SPLIT = 64 << 20
SCHEMA = "line long, byte long, value string"


def opened(path: str) -> pa.NativeFile:
    """A file of any store that has a URI, or a local one."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(at)


@dataclass
class Range(InputPartition):
    """Whole lines from byte `start` to `end`; the first has number `line`."""

    start: int
    end: int
    line: int


class LineSource(DataSource):
    """Format json_lines_stream: the lines of a file with their numbers, from 1, and the bytes after them. Options: path, split (bytes in a partition), last (true: a last line without an end is a line)."""

    @classmethod
    def name(cls) -> str:
        return "json_lines_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("last", "false").lower() == "true")


class LineReader(DataSourceStreamReader):
    """An offset is the number of bytes and of lines before it and the SHA-256 of those bytes.

    The hash is one running sum, so the driver's side reads what is new once, in blocks, and notes
    where partitions may begin: at a line's start, with its number. Lines themselves are read by
    tasks. Where a query begins again, what it had read is hashed anew: a file that is shorter, or
    that has changed before the offset, is refused.
    """

    def __init__(self, path: str, split: int = SPLIT, last: bool = False) -> None:
        self.path, self.split, self.last = path, max(1, split), last
        self.hash, self.byte, self.line = hashlib.sha256(), 0, 0
        self.marks = [(0, 0)]
        self.known = {0: (0, self.hash.hexdigest())}

    def __getstate__(self) -> dict:
        """What tasks need; the running sum stays where it is."""
        return {"path": self.path}

    def initialOffset(self) -> dict:
        return {"byte": 0, "line": 0, "sha256": hashlib.sha256().hexdigest()}

    def _take(self, data: bytes) -> None:
        """Goes on over whole lines."""
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        for k, end in enumerate((self.byte + ends).tolist(), 1):
            if end - self.marks[-1][0] >= self.split:
                self.marks.append((end, self.line + k))
        self.hash.update(data)
        self.byte, self.line = self.byte + len(data), self.line + len(ends) + (not data.endswith(b"\n"))

    def _advance(self, to: int | None = None) -> None:
        """Reads on to the end of the last whole line, or to a byte."""
        with opened(self.path) as file:
            size = file.size()
            if size < (self.byte if to is None else to):
                raise ValueError(f"{self.path} is shorter than what was read before")
            stop = size if to is None else to
            file.seek(self.byte)
            rest, at = b"", self.byte
            while at < stop and (block := file.read(min(BLOCK, stop - at))):
                at += len(block)
                rest += block
                if cut := rest.rfind(b"\n") + 1:
                    self._take(rest[:cut])
                    rest = rest[cut:]
            if rest and (self.last or to is not None):
                self._take(rest)
        self.known[self.byte] = (self.line, self.hash.hexdigest())

    def latestOffset(self) -> dict:
        self._advance()
        line, digest = self.known[self.byte]
        return {"byte": self.byte, "line": line, "sha256": digest}

    def _held(self, offset: dict) -> None:
        """Checks that the file still begins with what an offset stands for."""
        at = offset["byte"]
        if at > self.byte:
            self._advance(at)
        elif at not in self.known:
            digest, left = hashlib.sha256(), at
            with opened(self.path) as file:
                while left and (block := file.read(min(BLOCK, left))):
                    digest.update(block)
                    left -= len(block)
            self.known[at] = (offset["line"], digest.hexdigest())
        if self.known[at] != (offset["line"], offset["sha256"]):
            raise ValueError(f"{self.path} has changed before byte {at}; what was read can't be continued")

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self._held(start)
        self._held(end)
        if start["byte"] == end["byte"]:
            return []
        cuts = [(start["byte"], start["line"]), *[m for m in self.marks if start["byte"] < m[0] < end["byte"]], (end["byte"], end["line"])]
        return [Range(a, b, line + 1) for (a, line), (b, _) in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at, line = partition.start, partition.line
        with opened(self.path) as file:
            file.seek(at)
            rest, read = b"", at
            while read < partition.end and (block := file.read(min(BLOCK, partition.end - read))):
                read += len(block)
                rest += block
                cut = len(rest) if read >= partition.end else rest.rfind(b"\n") + 1
                if not cut:
                    continue
                whole = rest[:cut].removesuffix(b"\n").split(b"\n")
                ends = np.minimum(at + np.cumsum([len(x) + 1 for x in whole]), at + cut)
                lines = [x.removesuffix(b"\r").decode() for x in whole]
                yield pa.RecordBatch.from_arrays([pa.array(range(line, line + len(lines)), pa.int64()), pa.array(ends, pa.int64()), pa.array(lines, pa.string())], ["line", "byte", "value"])
                at, line, rest = int(ends[-1]), line + len(lines), rest[cut:]


def line_stream(spark: SparkSession, path: str, split: int = SPLIT, last: bool = False) -> DataFrame:
    """The lines of a growing file as a stream: line, byte and value."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format(LineSource.name()).option("path", path).option("split", str(split)).option("last", str(last)).load()
