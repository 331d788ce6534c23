"""A data source over profiler exports in SQLite files, opened read-only; ranges of row ids are the partitions."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tables and columns of the export (fixed values): what is read of each, with Spark types.
TABLES = {
    "StringIds": "id long, value string",
    "CUPTI_ACTIVITY_KIND_KERNEL": "start long, end long, deviceId long, globalPid long, streamId long, demangledName long, shortName long",
    "CUPTI_ACTIVITY_KIND_MEMCPY": "start long, end long, deviceId long, globalPid long, streamId long",
    "CUPTI_ACTIVITY_KIND_MEMSET": "start long, end long, deviceId long, globalPid long, streamId long",
    "NVTX_EVENTS": "start long, end long, globalTid long, text string, textId long",
}
CATEGORY = {"CUPTI_ACTIVITY_KIND_KERNEL": "kernel", "CUPTI_ACTIVITY_KIND_MEMCPY": "gpu_memcpy", "CUPTI_ACTIVITY_KIND_MEMSET": "gpu_memset"}
REQUIRED = ("StringIds", "CUPTI_ACTIVITY_KIND_KERNEL", "NVTX_EVENTS")


class Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def tables(path: str) -> set[str]:
    with _open(path) as db:
        return {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}


class ProfilerReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], rows: int):
        self.path, self.table, self.names, self.rows = path, table, names, rows

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [Rows(a, a + self.rows) for a in range(lo, hi + 1, self.rows)] if lo is not None else [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with _open(self.path) as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            wanted = ", ".join(f'"{n}"' if n in have else f'NULL AS "{n}"' for n in self.names)
            yield from db.execute(f'SELECT {wanted} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.lo, partition.hi))


class ProfilerSqlite(DataSource):
    """`spark.read.format("profiler_sqlite").option("path", file).option("table", name)`."""

    @classmethod
    def name(cls) -> str:
        return "profiler_sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> ProfilerReader:
        return ProfilerReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("rows", 100_000)))


def read_profile(spark, path: str) -> dict:
    """DataFrames of an export's tables by name; a missing required table is an error, a missing optional one None."""
    there = tables(path)
    if lacking := [t for t in REQUIRED if t not in there]:
        raise ValueError(f"the export lacks {lacking}")
    spark.dataSource.register(ProfilerSqlite)
    load = lambda t: spark.read.format("profiler_sqlite").option("path", path).option("table", t).load()
    return {t: load(t) if t in there else None for t in TABLES}


def trace_events(spark, path: str, pid: int | None = None):
    """Events of an export, ready for analysis."""
    from ..operators import profiler

    profile = read_profile(spark, path)
    return profiler.trace_events({c: profile[t] for t, c in CATEGORY.items()}, profile["StringIds"], profile["NVTX_EVENTS"], pid)
