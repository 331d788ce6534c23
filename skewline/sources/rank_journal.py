"""Rank journals as a data source, for batch and streaming reads and writes, and their status.

A run's directory has for each rank `metrics-rank<r>.jsonl`, to which rows are appended, and `progress-rank<r>.json`, the
marker of what is committed: rows, bytes and their SHA-256. Bytes behind a marker don't count. `manifest.json` makes a run
complete: then each marker must be the manifest's, say so, and leave no bytes behind it; `attempt.json` tells of one that isn't.

    spark.read.format("rank_journal").option("path", "runs/*").load()              # committed rows, a task a journal or, of many, some
    spark.read.format("rank_journal_status").option("path", "runs/*").load()       # a row a journal, bad ones told
    spark.readStream.format("rank_journal").option("path", "runs/*").load()        # rows as markers come, each once
    spark.readStream.format("rank_journal_progress").option("path", "runs/*").load()  # a row for each marker that moved
    rows.writeStream.format("rank_journal").option("checkpointLocation", c).start("runs")

A journal is read in blocks and hashed on the way, so its size doesn't matter; its rows are the committed ones only if the read
ends well, and a changed byte, a row cut in two, too long or out of step fails it. A stream keeps bytes and rows of each journal as
its offset and reads from there, without hashing what lies before. Directories must be mounted where tasks run.

Writing appends behind the marker's bytes, whatever lies there, and the markers follow when all tasks have ended. Killed between the
two, a batch is written again over the same bytes; killed among the markers, the rows that a marker covers are told as those of
the batch before and left. A late attempt of a task finds its rows committed or out of step and can't change a journal. All
rows of a rank must be in one task of a batch (`by_rank`), follow its last step without gaps, and are sorted there.
"""

from __future__ import annotations

import fcntl
import glob
import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.resumable_sha256 import ResumableSha256
from ..guards import require
from ..operators.journals import MAX_ROW_BYTES
from ..schemas import RANK_METRICS
from .files import ATTEMPT_FILE, FAILURE_FILE, MANIFEST_FILE, MARKER_FILE, METRICS_FILE
from .sinks import journal_lines, marker_fields, write_json

BLOCK = 1 << 20
#: Up to so many journals have a task each; of more, a task reads up to `A_TASK`, since most of a short journal's time is its task's.
TASKS, A_TASK = 256, 64
#: Files that are made durable at a time.
THREADS = 16
_ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in RANK_METRICS.fields])
_ROWS = pa.schema([*_ARROW, ("run", pa.string())])


def of_rank(root: str | Path, name: str, rank: int) -> Path:
    return Path(root) / name.replace("*", str(rank))


def known_marker(root: str | Path, rank: int) -> dict | None:
    """A rank's marker, refused unless its fields fit each other; None if there is none."""
    path = of_rank(root, MARKER_FILE, rank)
    if not path.exists():
        return None
    marker = json.loads(path.read_text())
    require(marker["rank"] == rank and marker["schema_version"] == 1, "the marker is another rank's or of another version")
    counts = [marker[k] for k in ("bytes", "rows", "start_step")]
    require(all(type(n) is int and n >= 0 for n in counts), "the marker's numbers are bad")
    require(marker["last_step"] == marker["start_step"] + marker["rows"] - 1, "the marker's rows and steps don't fit")
    return marker


def stretch(path: Path, start: int, end: int) -> Iterator[bytes]:
    """Bytes from `start` to before `end`, in blocks; fewer are an error."""
    with path.open("rb") as f:
        f.seek(start)
        while start < end:
            block = f.read(min(BLOCK, end - start))
            require(bool(block), "the journal is shorter than its marker says")
            start += len(block)
            yield block


def whole_lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes, cut behind line ends."""
    rest = b""
    for block in blocks:
        cut = block.rfind(b"\n") + 1
        if cut:
            yield rest + block[:cut]
            rest = block[cut:]
        else:
            rest += block
        require(len(rest) < MAX_ROW_BYTES, "a row is too long")
    require(not rest, "the last row is cut off")


def parsed(lines: bytes, rank: int, first_step: int) -> pa.Table:
    """Rows of whole lines, which must be the rank's and follow from `first_step` on."""
    rows = lines.count(b"\n")
    ends = lines.split(b"\n")
    require(max(map(len, ends)) < MAX_ROW_BYTES, "a row is too long")
    options = pyarrow.json.ParseOptions(explicit_schema=_ARROW, unexpected_field_behavior="ignore")
    try:
        table = pyarrow.json.read_json(pa.BufferReader(lines), pyarrow.json.ReadOptions(use_threads=False, block_size=len(lines) + 1), options)
    except pa.ArrowInvalid as e:
        raise ValueError(f"a row can't be read: {e}") from e
    require(len(table) == rows, "a line is blank or holds more than a row")
    steps = pa.array(range(first_step, first_step + rows), pa.int64())
    in_order = pc.and_(pc.equal(table["rank"], rank), pc.equal(table["step"], pa.chunked_array([steps])))
    require(pc.all(pc.fill_null(in_order, False)).as_py(), "the journal's ranks or steps are out of order")
    return table


@dataclass
class Journal:
    """A rank's journal of a run, or its stretch of a stream; `recorded`: the manifest's marker if the run is complete."""

    root: str = ""
    rank: int = 0
    completed: bool = False
    recorded: dict | None = None
    start: int = 0
    end: int = 0
    first_step: int = 0
    rows: int = 0

    def tables(self) -> Iterator[pa.Table]:
        """Rows of the stretch."""
        step = self.first_step
        for lines in whole_lines(stretch(of_rank(self.root, METRICS_FILE, self.rank), self.start, self.end)):
            table = parsed(lines, self.rank, step)
            step += len(table)
            yield table
        require(step == self.first_step + self.rows, "the journal has other rows than its marker says")

    def committed(self) -> Iterator[pa.Table]:
        """Rows of the committed prefix, which is what its marker says if all of them can be read."""
        marker = known_marker(self.root, self.rank)
        if marker is None:
            require(not self.completed, "a complete run lacks a journal")
            return
        path = of_rank(self.root, METRICS_FILE, self.rank)
        if self.completed:
            require(self.recorded is not None and marker_fields(marker) == marker_fields(self.recorded), "the journal's marker isn't the manifest's")
            require(marker["complete"] and path.stat().st_size == marker["bytes"], "a complete run's journal isn't closed, or has bytes behind its marker")
        digest = hashlib.sha256()

        def hashed() -> Iterator[bytes]:
            for block in stretch(path, 0, marker["bytes"]):
                digest.update(block)
                yield block

        step = marker["start_step"]
        for lines in whole_lines(hashed()):
            table = parsed(lines, self.rank, step)
            step += len(table)
            yield table
        require(digest.hexdigest() == marker["sha256"], "the journal isn't what its marker says")
        require(step == marker["last_step"] + 1, "the journal has other rows than its marker says")

    def with_run(self, tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            yield from table.append_column("run", pa.array([self.root] * len(table), pa.string())).cast(_ROWS).to_batches()


@dataclass
class Journals(InputPartition):
    """Journals that one task reads, one after the other."""

    some: list[Journal]


def dealt(found: list[Journal]) -> list[Journals]:
    """All journals as tasks; an empty one if there are none."""
    tasks = min(len(found), max(TASKS, -(-len(found) // A_TASK)))
    return [Journals(found[i::tasks]) for i in range(tasks)] or [Journals([])]


def run_journals(pattern: str) -> list[Journal]:
    """Journals of the directories that fit a pattern: those of the ranks that the manifest or attempt tells, else those that are there."""
    out = []
    for root in sorted(glob.glob(pattern.removeprefix("file:").rstrip("/"))):
        told = next((p for p in (Path(root, MANIFEST_FILE), Path(root, ATTEMPT_FILE)) if p.is_file()), None)
        facts = json.loads(told.read_text()) if told else {}
        head, tail = MARKER_FILE.split("*")
        there = sorted(int(p.name[len(head) : -len(tail)]) for p in Path(root).glob(MARKER_FILE))
        completed = told is not None and told.name == MANIFEST_FILE
        recorded = {m.get("rank"): m for m in (facts.get("telemetry") or {}).get("rank_progress") or []}
        out += [Journal(root, rank, completed, recorded.get(rank)) for rank in (range(facts["world_size"]) if facts.get("world_size") else there)]
    return out


class RowReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> Sequence[InputPartition]:
        return dealt(run_journals(self.pattern))

    def read(self, partition: Journals) -> Iterator[pa.RecordBatch]:
        for journal in partition.some:
            yield from journal.with_run(journal.committed())


class StatusReader(RowReader):
    def read(self, partition: Journals) -> Iterator[tuple]:
        return map(self.told, partition.some)

    def told(self, journal: Journal) -> tuple:
        status, rows, marker, error = "no_committed_metrics", 0, {}, None
        try:
            marker = known_marker(journal.root, journal.rank) or {}
            rows = sum(len(t) for t in journal.committed())
            if marker:
                status = "complete" if marker["complete"] else "partial"
        except (ValueError, KeyError, TypeError, OSError) as e:
            status, rows, marker, error = "invalid", 0, {}, str(e)
        failure = of_rank(journal.root, FAILURE_FILE, journal.rank)
        return journal.root, journal.rank, status, rows, marker.get("start_step"), marker.get("last_step"), marker.get("bytes"), marker.get("flushes"), error, failure.read_text() if failure.exists() else None, journal.completed


class RowStream(DataSourceStreamReader):
    """Offsets: for each journal [bytes, rows, start step] of its marker."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for j in run_journals(self.pattern):
            if marker := known_marker(j.root, j.rank):
                out[f"{j.rank} {j.root}"] = [marker["bytes"], marker["rows"], marker["start_step"]]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for key, (size, rows, first) in end.items():
            rank, root = key.split(" ", 1)
            size_before, rows_before, first_before = start.get(key, [0, 0, first])
            require(first == first_before and size >= size_before and rows >= rows_before, f"{root}: the journal of rank {rank} was replaced")
            if rows > rows_before:
                out.append(Journal(root, int(rank), start=size_before, end=size, first_step=first + rows_before, rows=rows - rows_before))
        return dealt(out)

    def read(self, partition: Journals) -> Iterator[pa.RecordBatch]:
        for journal in partition.some:
            yield from journal.with_run(journal.tables())


def extend(root: str | Path, rank: int, rows: list[dict]) -> dict:
    """Write rows behind what is committed, and return the marker to publish: the known one if it covers them already."""
    data = of_rank(root, METRICS_FILE, rank)
    data.parent.mkdir(parents=True, exist_ok=True)
    rows = sorted(rows, key=lambda r: r["step"])
    with data.open("a+b") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)  # one attempt at a time
        known = known_marker(root, rank)
        require(known is None or not known["complete"], "the journal is complete")
        with data.open("r+b") as f:
            if known and rows[0]["step"] <= known["last_step"]:
                last = known.get("resume") or {}
                lines = journal_lines(rows, rank, known["start_step"] + last.get("rows", known["rows"]))
                f.seek(last["bytes"])
                require(f.read(known["bytes"] - last["bytes"]) == lines, "other rows of these steps are committed")
                return known
            start, n, size = (known["start_step"], known["rows"], known["bytes"]) if known else (rows[0]["step"], 0, 0)
            lines = journal_lines(rows, rank, start + n)
            require(data.stat().st_size >= size, "the journal is shorter than its marker says")
            state = (known.get("resume") or {}).get("state") if known else ""
            if state is None:  # another writer's journal: once
                digest = ResumableSha256()
                for block in stretch(data, 0, size):
                    digest.update(block)
            else:
                f.seek(size - size % 64)
                digest = ResumableSha256(state, size, f.read(size % 64))
            digest.update(lines)
            f.seek(size)
            f.write(lines)
            f.truncate()
            f.flush()
            os.fsync(f.fileno())
    marker = {"schema_version": 1, "rank": rank, "start_step": start, "last_step": start + n + len(rows) - 1, "rows": n + len(rows), "bytes": size + len(lines), "sha256": digest.hexdigest(), "flushes": (known["flushes"] if known else 0) + 1, "complete": False}
    return marker | {"resume": {"state": digest.state, "rows": n, "bytes": size}}


class ProgressStream(RowStream):
    """A row for each journal whose marker moved: what the marker says, and whether what it added can be read."""

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for j in run_journals(self.pattern):
            if marker := known_marker(j.root, j.rank):
                out[f"{j.rank} {j.root}"] = [marker["bytes"], marker["rows"], marker["start_step"], marker["complete"]]
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for key, (size, rows, first, complete) in end.items():
            rank, root = key.split(" ", 1)
            size_before, rows_before, first_before, _ = before = start.get(key, [0, 0, first, None])
            if before != [size, rows, first, complete]:
                same = first == first_before and size >= size_before and rows >= rows_before
                out.append(Journal(root, int(rank), complete, start=size_before if same else size, end=size, first_step=first + rows_before, rows=rows - rows_before))
        return dealt(out)

    def read(self, partition: Journals) -> Iterator[tuple]:
        return map(self.told, partition.some)

    def told(self, journal: Journal) -> tuple:
        error = None if journal.rows >= 0 else "the journal was replaced"
        try:
            for _ in journal.tables() if error is None else ():
                pass
        except (ValueError, OSError) as e:
            error = str(e)
        return journal.root, journal.rank, journal.first_step + journal.rows - 1, error is None, journal.completed, error


@dataclass
class Written(WriterCommitMessage):
    markers: list[tuple[str, dict]] = field(default_factory=list)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root.removeprefix("file:").rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """The task's rows are held as Arrow has them; only a few journals' at a time become Python's."""
        batches = [b for b in iterator if len(b)]
        if not batches:
            return Written()
        table = pa.Table.from_batches(batches).combine_chunks()
        del batches
        keys = [c for c in ("run", "rank") if c in table.column_names]
        table = table.sort_by([(c, "ascending") for c in keys])
        new = np.zeros(len(table) - 1, bool)
        for c in keys:
            codes = pc.fill_null(pc.dictionary_encode(table[c]).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
            new |= np.diff(codes) != 0
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]

        def extended(start: int, end: int) -> tuple[str, dict]:
            rows = table.slice(start, end - start)
            run, rank = rows["run"][0].as_py() if "run" in keys else None, rows["rank"][0].as_py()
            root = f"{self.root}/{run}" if run is not None else self.root
            dicts = (rows.drop_columns(["run"]) if "run" in keys else rows).to_pylist()
            return root, extend(root, rank, [{k: v for k, v in row.items() if v is not None} for row in dicts])

        with ThreadPoolExecutor(THREADS) as pool:
            return Written(list(pool.map(extended, ends[:-1], ends[1:])))

    def commit(self, messages: list) -> None:
        found = [x for m in messages if m is not None for x in m.markers]
        names = [(root, m["rank"]) for root, m in found]
        require(len(set(names)) == len(names), "rows of a rank were in more than one task; deal them by_rank")

        def publish(told: tuple[str, dict]) -> None:
            root, marker = told
            if known_marker(root, marker["rank"]) != marker:
                write_json(of_rank(root, MARKER_FILE, marker["rank"]), marker)

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(publish, found))

    def abort(self, messages: list) -> None:
        """Nothing to undo: bytes behind a marker don't count."""


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, root: str):
        self.batch = BatchWriter(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.batch.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.batch.commit(messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.batch.abort(messages)


class RankJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rank_journal"

    def schema(self) -> str:
        return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in RANK_METRICS.fields] + ["run string"])

    def reader(self, schema) -> RowReader:
        return RowReader(self.options["path"])

    def streamReader(self, schema) -> RowStream:  # noqa: N802
        return RowStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        require(not overwrite, "journals are only appended to")
        return BatchWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"])


class RankJournalProgress(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rank_journal_progress"

    def schema(self) -> str:
        return "run string, rank bigint, last_step bigint, intact boolean, complete boolean, error string"

    def streamReader(self, schema) -> ProgressStream:  # noqa: N802
        return ProgressStream(self.options["path"])


class RankJournalStatus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rank_journal_status"

    def schema(self) -> str:
        return "run string, rank bigint, status string, rows bigint, start_step bigint, last_step bigint, bytes bigint, flushes bigint, error string, failure string, completed boolean"

    def reader(self, schema) -> StatusReader:
        return StatusReader(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RankJournal)
    spark.dataSource.register(RankJournalStatus)
    spark.dataSource.register(RankJournalProgress)
    return spark


def committed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Committed rows of the runs that fit `path`; a bad journal fails the query."""
    return registered(spark).read.format("rank_journal").option("path", path).load()


def journal_status(spark: SparkSession, path: str) -> DataFrame:
    """(run, rank, status, rows, start_step, last_step, bytes, flushes, error, failure, completed) of each journal."""
    return registered(spark).read.format("rank_journal_status").option("path", path).load()


def stream_rows(spark: SparkSession, path: str) -> DataFrame:
    """Committed rows as their markers come."""
    return registered(spark).readStream.format("rank_journal").option("path", path).load()


def stream_progress(spark: SparkSession, path: str) -> DataFrame:
    """(run, rank, last_step, intact, complete, error) of a journal each time its marker has moved."""
    return registered(spark).readStream.format("rank_journal_progress").option("path", path).load()


def by_rank(rows: DataFrame) -> DataFrame:
    """Rows dealt as the sink asks for."""
    return rows.repartition(*[c for c in ("run", "rank") if c in rows.columns])


def write_rows(rows: DataFrame, path: str) -> None:
    """Append a batch to the journals under `path`."""
    registered(rows.sparkSession)
    by_rank(rows).write.format("rank_journal").mode("append").option("path", path).save()


def stream_to_journals(rows: DataFrame, path: str, checkpoint: str):
    """A writer of a stream's rows to the journals under `path`; start it with a trigger."""
    registered(rows.sparkSession)
    return by_rank(rows).writeStream.format("rank_journal").option("path", path).option("checkpointLocation", checkpoint)


def seal(pattern: str) -> int:
    """Mark the journals of runs as complete; the number of them."""
    found = run_journals(pattern)
    for j in found:
        marker = known_marker(j.root, j.rank)
        require(marker is not None, "a rank has no committed rows")
        write_json(of_rank(j.root, MARKER_FILE, j.rank), marker | {"complete": True})
    return len(found)
