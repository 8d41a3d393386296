"""Files that grow, as a stream of lines.

The offset of the stream holds, for every file, how many bytes of it are read,
so lines appended to a file that was already read come exactly once, also after
a restart. A file is known by what does not change when it is renamed: its
first line, and on local disks its inode. A rotated file goes on where it was
under its new name, if the pattern covers that; a file that was emptied and
begins anew is a new file.
"""
from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, line_start bigint"
#: Bytes that one task reads, that are read at once, and of a first line that tell a file apart.
TASK, BLOCK, HEAD = 64 << 20, 4 << 20, 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _first_line(store: fs.FileSystem, path: str) -> bytes | None:
    """The first line, or None while it is not finished."""
    with store.open_input_file(path) as f:
        head = f.read(HEAD)
    end = head.find(b"\n")
    return head[:end] if end >= 0 else head if len(head) == HEAD else None


def identity(store: fs.FileSystem, path: str) -> str | None:
    """What a file is known by: its first line, and its inode where there is one; None if it has no whole line."""
    line = _first_line(store, path)
    if line is None:
        return None
    place = "{0.st_dev}-{0.st_ino}-".format(os.stat(path)) if isinstance(store, fs.LocalFileSystem) else ""
    return place + hashlib.sha256(line).hexdigest()[:32]


def last_line_end(store: fs.FileSystem, path: str, size: int) -> int:
    """Number of bytes up to the end of the last whole line."""
    with store.open_input_file(path) as f:
        at = size
        while at > 0:
            begin = max(0, at - (1 << 16))
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


@dataclass
class Piece(InputPartition):
    """Lines that begin in ``[begin, end)`` of the file known as ``name``; ``stop`` ends what this batch may read."""

    name: str
    path: str
    begin: int
    end: int
    first: int
    stop: int


class GrowingLines(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str, latest: bool, task_bytes: int):
        self.folder, self.glob, self.latest, self.task_bytes = folder, glob, latest, task_bytes

    def _files(self) -> dict[str, dict]:
        store, folder = _store(self.folder)
        found: dict[str, dict] = {}
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.glob):
                continue
            try:
                name = identity(store, info.path)
                end = last_line_end(store, info.path, info.size) if name else 0
            except FileNotFoundError:
                continue  # rotated away between the listing and now; it shows under its new name next time
            if end:
                # Only without inodes can two files begin alike; their paths tell them apart then.
                found[f"{name}:{info.path}" if name in found else name] = {"path": info.path, "end": end}
        return found

    def initialOffset(self) -> dict:
        return {"files": self._files() if self.latest else {}}

    def latestOffset(self) -> dict:
        return {"files": self._files()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, file in sorted(end["files"].items()):
            done = start["files"].get(name, {"end": 0})["end"]
            done = 0 if done > file["end"] else done  # emptied, and begun with the same line again
            for begin in range(done, file["end"], self.task_bytes):
                out.append(Piece(name, file["path"], begin, min(begin + self.task_bytes, file["end"]), done, file["end"]))
        return out

    def _place(self, store: fs.FileSystem, piece: Piece) -> str:
        """Where the file is now: a batch may be repeated after it was renamed."""
        known = piece.name.split(":")[0]
        try:
            if identity(store, piece.path) == known:
                return piece.path
        except FileNotFoundError:
            pass
        for info in store.get_file_info(fs.FileSelector(_store(self.folder)[1])):
            if info.type == fs.FileType.File and identity(store, info.path) == known:
                return info.path
        raise FileNotFoundError(f"{piece.path} is gone, and with it bytes {piece.begin} to {piece.end}")

    def read(self, partition: Piece):
        store = _store(self.folder)[0]
        path = self._place(store, partition)
        with store.open_input_file(path) as f:
            # A task begins behind the line that reaches into its piece, and ends with the line that leaves it.
            at = partition.begin
            if at > partition.first:
                f.seek(at - 1)
                while at <= partition.stop:
                    block = f.read(BLOCK)
                    found = block.find(b"\n")
                    if found >= 0 or not block:
                        at += found if found >= 0 else 0
                        break
                    at += len(block)
            rest, f_at = b"", at
            f.seek(at)
            while at < partition.end:
                block = f.read(min(BLOCK, partition.stop - f_at))
                if not block:
                    break
                f_at += len(block)
                data = rest + block
                lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
                starts = at + np.append(0, lines[:-1] + 1) if len(lines) else np.empty(0, np.int64)
                keep = int(np.searchsorted(starts, partition.end))
                if keep:
                    yield _batch(data, lines[:keep], starts[:keep], partition.path)
                if keep < len(lines):
                    return
                cut = int(lines[-1]) + 1 if len(lines) else 0
                rest, at = data[cut:], at + cut


def _batch(data: bytes, ends: np.ndarray, starts: np.ndarray, path: str) -> pa.RecordBatch:
    lines = data[:int(ends[-1])].decode("utf-8", "replace").split("\n")
    return pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\r") for x in lines], pa.string()), pa.array([path] * len(lines), pa.string()), pa.array(starts.astype(np.int64))], names=["value", "path", "line_start"])


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files")`` with the options ``path``, ``glob``, ``startingOffsets`` (earliest, latest) and ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLines:
        o = self.options
        return GrowingLines(o["path"], o.get("glob", "*"), o.get("startingOffsets", "earliest") == "latest", int(o.get("taskBytes", TASK)))


def follow_lines(spark: SparkSession, path: str, glob: str = "*", latest: bool = False, task_bytes: int = TASK) -> DataFrame:
    """Whole lines of the files in a folder, with the file and the byte at which each begins.

    A line without an end waits for it. Bytes that are no UTF-8 are replaced. A
    file that is gone is forgotten. The folder must be one that all executors
    see; local paths and the stores that Arrow reads (hdfs, s3, gs) are.
    """
    spark.dataSource.register(GrowingFiles)
    return (spark.readStream.format("growing_files").option("path", path).option("glob", glob).option("startingOffsets", "latest" if latest else "earliest")
            .option("taskBytes", str(task_bytes)).load())
