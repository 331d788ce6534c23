"""Execution traces: complete events, device work, classes, step windows, and time measures of each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..guards import Rules, not_finite, require, strict
from .intervals import window_measures

DEVICE_WORK = ("kernel", "gpu_memcpy", "gpu_memset")
STEP_PATTERN = r"\A[A-Za-z]+/step/(\d+)\z"


def complete_events(events: DataFrame) -> DataFrame:
    """Events of phase X with a finite start and a duration of 0 or more; absent times count as 0."""
    rows = events.filter("ph = 'X'").withColumns({"ts": F.coalesce("ts", F.lit(0.0)), "dur": F.coalesce("dur", F.lit(0.0))})
    return strict(rows, event_rules())


def event_rules() -> Rules:
    return {"start": not_finite("ts"), "duration": not_finite("dur") | (F.col("dur") < 0)}


def classify(events: DataFrame) -> DataFrame:
    """Device work with its kind: copies are transfers, kernels named after the collective library are collectives."""
    category = F.lower("cat")
    kind = F.when(category != "kernel", "transfer").when(F.lower("name").contains("nccl"), "collective").otherwise("compute")
    return events.filter(category.isin(*DEVICE_WORK)).withColumn("kind", kind)


def step_windows(events: DataFrame, pattern: str = STEP_PATTERN, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, step, s, e) of annotations of any category."""
    step = F.regexp_extract("name", pattern, 1)
    return events.filter(F.col("name").rlike(pattern)).select(*keys, step.cast("long").alias("step"), F.col("ts").alias("s"), (F.col("ts") + F.col("dur")).alias("e"))


def analyze(events: DataFrame, rank: int = 0, device: int | None = None, pattern: str = STEP_PATTERN) -> DataFrame:
    """(rank, step, compute, collective, transfer, overlap, exposed, busy, window, uncovered) in milliseconds."""
    rows = complete_events(events)
    work = classify(rows).withColumn("device", F.col("args.device"))
    devices = [r[0] for r in work.select("device").distinct().filter("device IS NOT NULL").limit(2).collect()]
    require(device is not None or len(devices) < 2, "a trace of several devices needs a choice of one")
    if device is not None:
        work = work.filter(F.col("device") == device)
    windows = step_windows(rows, pattern)
    clashes = windows.groupBy("step").count().filter("count > 1").limit(1).count()
    require(not clashes, "a step has several windows")
    require(not windows.isEmpty(), "the trace has no step windows")
    key = F.lit(rank).cast("long").alias("rank")
    spans = work.select(key, "kind", F.col("ts").alias("s"), (F.col("ts") + F.col("dur")).alias("e"))
    out = window_measures(spans, windows.select(key, "*"), ["rank"], "step")
    return out.select("rank", "step", *[(F.col(c) / 1000).alias(c) for c in out.columns if c not in ("rank", "step")]).orderBy("step")
