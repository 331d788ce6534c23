"""A data source over checkpoint directories: each storage file's size and SHA-256, hashed in blocks, a task a file.

Spark's own file sources skip names that begin with a dot or an underscore, which storage files do, and hold a file's
content in one value; this one reads the files itself, so directories must be mounted where tasks run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of storage files (fixed values): the metadata, and shards by rank and number.
STORAGE = re.compile(r"\.metadata|__\d+_\d+\.distcp")
BLOCK = 1 << 20


class File(InputPartition):
    def __init__(self, checkpoint: str, path: str):
        self.checkpoint, self.path = checkpoint, path


class CheckpointReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        found = [File(d.name, str(f)) for d in sorted(Path(self.root).glob("checkpoint-*")) if d.is_dir() for f in sorted(d.iterdir()) if STORAGE.fullmatch(f.name) and f.is_file() and not f.is_symlink()]
        return found or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.path:
            digest, size = hashlib.sha256(), 0
            with open(partition.path, "rb") as f:
                while block := f.read(BLOCK):
                    digest.update(block)
                    size += len(block)
            yield partition.checkpoint, Path(partition.path).name, size, digest.hexdigest()


class CheckpointStorage(DataSource):
    """`spark.read.format("checkpoint_storage").option("path", root)`."""

    @classmethod
    def name(cls) -> str:
        return "checkpoint_storage"

    def schema(self) -> str:
        return "checkpoint string, path string, bytes bigint, sha256 string"

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options["path"].removeprefix("file:"))


def storage_files(spark: SparkSession, root: str) -> DataFrame:
    """(checkpoint, path, bytes, sha256) of all storage files under `root`'s checkpoint directories."""
    spark.dataSource.register(CheckpointStorage)
    return spark.read.format("checkpoint_storage").option("path", root).load()
