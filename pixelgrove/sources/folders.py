"""Folders of pictures as a Spark data source: walked in tasks, never opened; then heads of what a plan keeps.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder_tree").option("roots", json.dumps([...])).load()

The driver lists only the upper levels, until there are directories enough for the asked number of partitions; tasks walk
below them. Links are left out, hidden names too, and what cannot be walked is a row with a sentence in ``problem``.
Paths are those of a folder that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .headers import header_size

#: How deep a plan goes, and how much of a file's beginning it reads.
MOST_DEPTH, HEAD_BYTES = 8, 4096

_MOVED = "could not look at {}: it may have moved, or this device will not let the app read it"
_CLOSED = "could not open {}: {}"
_DEEP = "stopped {} levels down: it is deeper than any folder can usefully be, and the rest of it was not looked at"

_NAMELESS = "could not look at {}: its name is not text"

Row = tuple[str, str, int | None, int, str | None]


def clean(root: str) -> str:
    """A root as a plain path: without its scheme, absolute."""
    return os.path.abspath("/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root)


def look(path: str, level: int, most: int, listdir: Callable = os.scandir) -> tuple[Row | None, list[str]]:
    """One path: its row, or the entries below it. A link, a hidden or a special file is neither."""
    try:
        path.encode()
    except UnicodeEncodeError:
        shown = path.encode(errors="surrogateescape").decode(errors="replace")
        return (shown, os.path.basename(shown), None, level, _NAMELESS.format(shown)), []
    try:
        found = os.lstat(path)
    except OSError:
        return (path, os.path.basename(path), None, level, _MOVED.format(path)), []
    if stat.S_ISREG(found.st_mode):
        return (path, os.path.basename(path), found.st_size, level, None), []
    if not stat.S_ISDIR(found.st_mode):
        return None, []
    if level >= most:
        return (path, os.path.basename(path), None, level, _DEEP.format(most)), []
    try:
        with listdir(path) as entries:
            return None, sorted(e.path for e in entries if not e.name.startswith("."))
    except OSError as e:
        return (path, os.path.basename(path), None, level, _CLOSED.format(path, e.strerror)), []


def walk(paths: list[tuple[str, int]], most: int) -> Iterator[Row]:
    """All rows at and below the paths (each with its level), depth first; a task holds one branch at a time."""
    stack = list(reversed(paths))
    while stack:
        path, level = stack.pop()
        row, below = look(path, level, most)
        if row:
            yield row
        stack += [(p, level + 1) for p in reversed(below)]


@dataclass
class Branches(InputPartition):
    paths: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [(clean(r), 0) for r in json.loads(options["roots"])]
        self.most, self.parts = int(options.get("depth", MOST_DEPTH)), int(options.get("parts", 64))

    def partitions(self) -> list[InputPartition]:
        """Branches of the trees, dealt out; a level at a time, as long as there are fewer than partitions."""
        level, done = list(dict.fromkeys(self.roots)), []
        while level and len(level) + len(done) < self.parts:
            below = []
            for path, depth in level:
                row, inner = look(path, depth, self.most)
                if row or not inner:
                    done.append((path, depth))
                below += [(p, depth + 1) for p in inner]
            level = below
        branches = done + level
        return [Branches(branches[k :: self.parts]) for k in range(min(self.parts, len(branches)))] or [Branches([])]

    def read(self, partition: Branches) -> Iterator[Row]:
        yield from walk(partition.paths, self.most)


class FolderSource(DataSource):
    """path, name, bytes, depth of every file below the roots; a row with a problem for what cannot be walked."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, name string, bytes long, depth int, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def tree(spark: SparkSession, roots: str | list[str], *, depth: int = MOST_DEPTH, parts: int | None = None) -> DataFrame:
    """The rows of :class:`FolderSource`, each path once however the roots overlap."""
    spark.dataSource.register(FolderSource)
    roots = [roots] if isinstance(roots, str) else roots
    parts = parts or 2 * spark.sparkContext.defaultParallelism
    found = spark.read.format("folder_tree").option("roots", json.dumps(roots)).option("depth", str(depth)).option("parts", str(parts)).load()
    return found if len(roots) == 1 else found.dropDuplicates(["path"])


def _head(path: str) -> tuple[bytes | None, tuple[int, int] | None, int]:
    """The first bytes of a file, the size its header says, and how many bytes were read for both."""
    try:
        with open(path, "rb") as f:
            head = f.read(HEAD_BYTES)
            read, size = len(head), header_size(head)
            if size is None and head[:2] == b"\xff\xd8" and read == HEAD_BYTES:
                # A JPEG's size may stand behind long segments: they are stepped over, not read.
                at = 2
                while True:
                    f.seek(at)
                    segment = f.read(9)
                    read += len(segment)
                    if len(segment) < 9 or segment[0] != 0xFF or segment[1] == 0xDA:
                        break
                    if 0xC0 <= segment[1] <= 0xCF and segment[1] not in (0xC4, 0xC8, 0xCC):
                        size = int.from_bytes(segment[7:9], "big"), int.from_bytes(segment[5:7], "big")
                        break
                    length = int.from_bytes(segment[2:4], "big")
                    if length < 2:
                        break
                    at += 2 + length
            return head, size, read
    except OSError:
        return None, None, 0


def heads(files: DataFrame, wanted: Column) -> DataFrame:
    """files (with ``path``) and head, width, height, bytes_read of those that are wanted; the others are not opened.

    Of a file 4,096 bytes are read, and a few more where a JPEG hides its size. One that cannot be opened has a null head.
    """
    rows = files.withColumn("__open", F.coalesce(wanted, F.lit(False)))
    names = files.columns
    at, kinds = names.index("path"), {"head": pa.binary(), "width": pa.int64(), "height": pa.int64(), "bytes_read": pa.int64()}

    def run(batches):
        for b in batches:
            found = [_head(p.removeprefix("file:")) if w else (None, None, 0) for p, w in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            parts = ([h for h, _, _ in found], [s and s[0] for _, s, _ in found], [s and s[1] for _, s, _ in found], [n for _, _, n in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, t) for v, t in zip(parts, kinds.values(), strict=True))], [*names, *kinds])

    schema = StructType(files.schema.fields)
    for c, kind in (("head", "binary"), ("width", "long"), ("height", "long"), ("bytes_read", "long")):
        schema = schema.add(c, kind)
    return rows.mapInArrow(run, schema)
