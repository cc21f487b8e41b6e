"""Produced files written to a folder that all executors share, as a Spark data source.

    spark.dataSource.register(FileSink)
    unique_names(outcomes).filter("bytes IS NOT NULL").write.format("file_sink").mode("append").save(folder)

Each task attempt writes its own rows to a hidden staging folder beside the results; nothing passes through the
driver but the attempts' folders and counts. When all tasks are done, the committed attempts' files are moved under their
names; with the option ``manifest`` a hidden file then says what came of the job, a line for each file. A job that fails
leaves neither files nor staging; a task that ran twice leaves its files once.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


_LIST = ".names"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int
    part: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], manifest: bool = False):
        self.manifest = manifest
        self.folder, self.at = folder, (names.index("output_name"), names.index("bytes"))
        self.job = uuid.uuid4().hex
        self.staging = os.path.join(folder, f".staging-{self.job}")

    def write(self, iterator) -> Written:
        part = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(part)
        files = size = 0
        with open(os.path.join(part, _LIST), "w", encoding="utf-8") as listed:
            for row in iterator:
                name, data = (row[i] for i in self.at)
                if not name or name in (".", "..", _LIST) or "/" in name or "\\" in name or "\0" in name:
                    raise ValueError(f"not a file name: {name!r}")
                if data is None:
                    continue
                with open(os.path.join(part, name), "wb") as f:
                    f.write(data)
                listed.write(json.dumps([name, len(data)]) + "\n")
                files, size = files + 1, size + len(data)
        return Written(files, size, part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves what the committed attempts wrote; a manifest appears last, so that a folder with it is whole."""
        os.makedirs(self.folder, exist_ok=True)
        os.makedirs(self.staging, exist_ok=True)
        manifest = os.path.join(self.staging, "manifest")
        with open(manifest, "w", encoding="utf-8") as out:
            for m in filter(None, messages):
                with open(os.path.join(m.part, _LIST), encoding="utf-8") as listed:
                    shutil.copyfileobj(listed, out)
                os.remove(os.path.join(m.part, _LIST))
                with os.scandir(m.part) as entries:
                    for e in entries:
                        os.replace(e.path, os.path.join(self.folder, e.name))
        if self.manifest:
            os.replace(manifest, os.path.join(self.folder, f".manifest-{self.job}"))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FileSink(DataSource):
    """Writes ``bytes`` of each row to the file ``output_name`` of a folder; rows without bytes write nothing."""

    @classmethod
    def name(cls) -> str:
        return "file_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a folder is added to, not overwritten")
        return _Writer(self.options["path"].removeprefix("file://"), schema.fieldNames(), str(self.options.get("manifest", "false")).lower() == "true")


def unique_names(outcomes: DataFrame, name: str = "output_name", key: str = "path") -> DataFrame:
    """outcomes whose names differ, case aside: of equal ones the lowest key's stays, others get sixteen digits of their key's hash.

    The lowest key is found by an aggregate, which combines before the shuffle; bytes do not move if the names are few.
    """
    folded = F.lower(F.col(name))
    first = outcomes.filter(F.col(key).isNotNull()).groupBy(folded.alias("__folded")).agg(F.min(key).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    found = outcomes.join(first, folded == F.col("__folded"), "left")
    other = F.regexp_replace(F.col(name), r"(\.[^.]*)?$", "")
    digits = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16)
    named = F.concat(other, F.lit("-"), digits, F.regexp_extract(F.col(name), r"\.[^.]*$", 0))
    return found.withColumn(name, F.when(F.col("__first") < F.col(key), named).otherwise(F.col(name))).drop("__folded", "__first")
