"""Profiler tables to trace events: process choice, string dictionary, unit scaling, step annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..guards import require
from .traces import STEP_PATTERN


def resolve(rows: DataFrame, strings: DataFrame, column: str, out: str = "name") -> DataFrame:
    """The dictionary's text of an id, or the id itself. The planner broadcasts a small dictionary; a large one is a shuffle."""
    texts = strings.select(F.col("id").alias(column), F.col("value").alias("_text"))
    return rows.join(texts, column, "left").withColumn(out, F.coalesce("_text", F.col(column).cast("string"))).drop("_text")


def union_activity(tables: dict[str, DataFrame]) -> DataFrame:
    """Kernels, copies and sets as one table; absent tables are skipped, absent columns null."""
    kinds = [t.withColumn("cat", F.lit(cat)) for cat, t in tables.items() if t is not None]
    require(bool(kinds), "no activity tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)


def choose_process(activity: DataFrame, pid: int | None = None) -> int:
    pids = [r[0] for r in activity.select("globalPid").distinct().limit(1000).collect()]
    if pid is None:
        require(len(pids) == 1, "a profile of several processes needs a choice of one")
        return pids[0]
    require(pid in pids, "the chosen process is not in the profile")
    return pid


def annotations(marks: DataFrame, strings: DataFrame, pid: int, pattern: str = STEP_PATTERN) -> DataFrame:
    """Step annotations of a process: thread and process agree above the low 24 bits, and the range has an end."""
    own = marks.filter((F.shiftright("globalTid", 24) == (pid >> 24)) & F.col("end").isNotNull())
    named = own.join(strings.select(F.col("id").alias("textId"), "value"), "textId", "left").withColumn("name", F.coalesce("text", "value"))
    return named.filter(F.col("name").rlike(pattern)).select("name", "start", "end")


def trace_events(tables: dict[str, DataFrame], strings: DataFrame, marks: DataFrame, pid: int | None = None, pattern: str = STEP_PATTERN) -> DataFrame:
    """Events in microseconds, ready for `traces.analyze`."""
    activity = union_activity(tables)
    pid = choose_process(activity, pid)
    rows = activity.filter(F.col("globalPid") == pid)
    for c in ("demangledName", "shortName"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("long"))
    rows = resolve(rows.withColumn("_name", F.coalesce("demangledName", "shortName")), strings, "_name")
    event = lambda df, cat, device: df.select(F.lit("X").alias("ph"), F.coalesce("name", cat).alias("name"), cat.alias("cat"), (F.col("start") / 1000).alias("ts"), ((F.col("end") - F.col("start")) / 1000).alias("dur"), F.struct(device.cast("long").alias("device")).alias("args"))
    work = event(rows, F.col("cat"), F.col("deviceId"))
    steps = event(annotations(marks, strings, pid, pattern), F.lit("user_annotation"), F.lit(None))
    return work.unionByName(steps)


def trace_document(events: DataFrame) -> DataFrame:
    """One row with the trace as a JSON document; for a single profile, which is one file by nature."""
    return events.agg(F.to_json(F.struct(F.collect_list(F.struct(*events.columns)).alias("traceEvents"))).alias("value"))
